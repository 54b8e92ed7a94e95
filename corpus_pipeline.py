"""Documents to packed sequences: the stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.decontam import without_contaminated
from folio.llm.langid import identify, learn_profiles
from folio.llm.lines import dedup_lines
from folio.llm.minhash import keep_one
from folio.llm.packing import pack
from folio.llm.runtime import Scratch
from folio.llm.tokens import token_pieces


#: Cosine from which a language is found. Of 4,802 whole texts of sf0.1 with 200 letters or more the lowest had 0.27; texts in
#: an unlearned script stay below 0.12, random Latin letters mostly below 0.2. A text of fewer letters than TELLING says too
#: little for that: any cosine above 0 will do.
FOUND, TELLING = 0.2, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no learned language is found go: no letters, or a cosine as low as chance gives (below FOUND).

    Of those that stay the rows without a language get the one that was found.
    """
    named = identify(docs, learn_profiles(docs))
    letters = F.length(F.regexp_replace("record.text", r"\P{L}+", ""))
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") > 0) & ((F.col("score") >= FOUND) | (letters < TELLING)))
    return kept.select(*[F.coalesce(F.col("record")[c], F.col("lang_pred")).alias(c) if c == "lang" else F.col("record")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents all of whose words were in lines that go. n_chars follows the text."""
    out = dedup_lines(docs)
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.where(~emptied | F.col("text").isNull()).select(*[changed[c].alias(c) if c in changed else F.col("record")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, a similarity of 0.8 or more)."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, with the sequence of at most 2048 tokens and the place that they have there."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces, 2048).select("record.*", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained profiles, SimHash groups and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
