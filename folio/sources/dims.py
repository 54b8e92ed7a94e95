"""Dimension tables from CSV files: curated lists of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.places import Gazetteer
from folio.schemas import ALIAS, COUNTRY


def read_csv(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = None) -> DataFrame:
    options = {"header": True, "comment": comment} if comment else {"header": True}
    reader = spark.read.options(**options, escape='"', multiLine=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def populations(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(country, population); comment lines and rows without a whole number are left out."""
    rows = read_csv(spark, path, comment="#")
    return rows.select("country", F.col(column).try_cast("long").alias("population")).where("population is not null")


def ordered_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a small CSV file, whose columns are the schema's in order, with ``seq``, their number in the file."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line")).where("seq > 0 and trim(line) <> ''")
    return lines.select(F.from_csv("line", schema, {"escape": '"'}).alias("r"), "seq").select("r.*", "seq")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Institution aliases, numbered in the order of the file."""
    return ordered_csv(spark, path, ALIAS)


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(variant, canonical), variants in the form that keywords have when they are looked up."""
    from folio.functions.keywords import folded, tidy

    return read_csv(spark, path).select(tidy(folded(F.col("variant"))).alias("variant"), "canonical")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, author_id, institution, ...); several rows for one author are several institutions."""
    return read_csv(spark, path)


def manual_decisions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "pmid string, decision string, reason string, screened_by string, date string").where("pmid is not null")


def author_group(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).select("author_id")


def gazetteer(spark: SparkSession, path: str) -> Gazetteer:
    """Countries with their spellings and hints; the class checks the bound."""
    return Gazetteer([tuple(r) for r in read_csv(spark, path, COUNTRY).limit(1001).collect()])


def benchmark_counts(queries: DataFrame, cached: DataFrame) -> DataFrame:
    """Counts by query text from a cache; null where a query was never asked."""
    return queries.join(cached.select("query", "n"), "query", "left")


def gazetteer_table(spark: SparkSession, known: Gazetteer) -> DataFrame:
    """(spelling, country, kind) of all that stands for a country: the table that goes with a paper."""
    rows = [(v, c, "name") for v, c in known.names.items()] + [(v, c, "hint") for v, c in known.hints.items()]
    return spark.createDataFrame(rows, "spelling string, country string, kind string")
