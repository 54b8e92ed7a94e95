"""Author keywords: one normal form for each concept."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.rules import KEYWORD_FAMILIES, KEYWORD_REWRITES, SINGULAR_EXCEPTIONS

DASHES = str.maketrans(dict.fromkeys("‐‑‒–—―−­﹣－", "-"))


@F.pandas_udf(T.StringType())
def folded(term: pd.Series) -> pd.Series:
    """Compatibility forms and dashes unified, accents dropped, case folded: Unicode work that Spark has no function for."""

    def one(t: str | None) -> str:
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t or "").translate(DASHES))
        return "".join(c for c in t if not unicodedata.combining(c)).casefold()

    return term.map(one)


def tidy(term: Column) -> Column:
    """Blanks and punctuation trimmed, no blanks around hyphens and slashes."""
    term = F.trim(F.regexp_replace(term, r"(?U)\s+", " "))
    term = F.btrim(term, F.lit(" .,;:!?\"'"))
    return F.regexp_replace(F.regexp_replace(term, r"\s*-\s*", "-"), r"\s*/\s*", "/")


def singular(term: Column) -> Column:
    """The last word without its plural ending; listed words and short ones keep theirs."""
    last = F.substring_index(term, " ", -1)
    end = lambda *xs: F.rlike(last, F.lit("(" + "|".join(xs) + ")$"))
    cut = lambda n: F.left(term, F.length(term) - n)
    keep = last.isin(SINGULAR_EXCEPTIONS) | (F.length(last) < 5) | end("ss", "us", "is", "ics")
    return (
        F.when(keep, term)
        .when(end("lenses"), cut(2))
        .when(end("analyses"), F.concat(cut(2), F.lit("is")))
        .when(end("ies"), F.concat(cut(3), F.lit("y")))
        .when(end("sses", "uses", "xes", "ches", "shes"), cut(2))
        .when(end("s"), cut(1))
        .otherwise(term)
    )


def java(pattern: str) -> str:
    return "(?U)" + pattern


def rewritten(term: Column) -> Column:
    for pattern, put in KEYWORD_REWRITES:
        term = F.regexp_replace(term, java(pattern), put.replace("\\1", "$1"))
    return F.regexp_replace(F.trim(F.regexp_replace(term, r"(?U)\s+", " ")), r"(?U)\b(\w+)( \1\b)+", "$1")


def family(term: Column) -> Column:
    """The first family whose pattern fits, else the term."""
    return F.coalesce(*[F.when(F.rlike(term, F.lit(java(p))), F.lit(name)) for p, name in KEYWORD_FAMILIES], term)


def normalised(terms: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """(column, normal) for each different value: synonyms before and after the singular, then families.

    Work is done once for each different term; ``synonyms`` is (variant, canonical).
    """
    lookup = lambda c: synonyms.select(F.col("variant").alias(c), F.col("canonical").alias(f"{c}_to"))
    once = terms.select(column).distinct().withColumn("a", rewritten(tidy(folded(F.col(column)))))
    once = once.withColumn("b", singular(F.col("a"))).join(lookup("a"), "a", "left").join(lookup("b"), "b", "left")
    normal = F.when(F.col("a") != "", F.coalesce("a_to", "b_to", family(F.col("b"))))
    return once.select(column, normal.alias("normal"))
