"""Shared plumbing: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


#: Folders of sessions without ``spark.checkpoint.dir``, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a local master (tests) gets a folder of its own;
    on a cluster that is an error, since no folder of one machine would do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="folio-")
    return _own[application]


class Scratch:
    """Tables written once and read back, which cuts lineage and survives lost executors; they go when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folio-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def path(self, name: str = "table") -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        return self._saved(df, df.write, name)

    def save_hashes(self, df: DataFrame, name: str = "table") -> DataFrame:
        """``save`` for tables of hashes: they hardly repeat a value, so a dictionary of them is work for nothing."""
        return self._saved(df, df.write.option("parquet.enable.dictionary", "false"), name)

    def save_texts(self, df: DataFrame, name: str = "table") -> DataFrame:
        """``save_hashes`` for tables with a text in every row: most of the folder's bytes, so they are packed more tightly."""
        return self._saved(df, df.write.option("parquet.enable.dictionary", "false").option("compression", "zstd"), name)

    def _saved(self, df: DataFrame, writer: DataFrameWriter, name: str) -> DataFrame:
        path = self.path(name)
        writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._folio_path = path
        return back

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of plans that are done with; it notices when the driver's garbage goes."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no returned plan reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._folio_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Gives memory that is done with back to the system: a worker that waits shouldn't hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_columns(df: DataFrame, *wanted: str) -> list[str]:
    """Names close to ``wanted`` that ``df`` doesn't use, for helper columns beside the caller's own."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names
