"""The library's functions by name in SQL, and a table function that resolves affiliations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import names as N
from folio.functions.keywords import folded
from folio.functions.places import Gazetteer
from folio.operators.joins import resolve_by_pattern
from folio.operators.stats import binomial_p


@F.pandas_udf(T.StringType())
def norm_last(last: pd.Series) -> pd.Series:
    """Surnames as they are compared; the column expression ``surname`` does the same within a plan."""
    fold = dict(zip(*map(list, N._plain_letters()), strict=True)) | N.SPELLED
    one = lambda t: "".join(c for c in "".join(fold.get(c, c) for c in t.strip().lower()) if c.isascii() and c not in " \t\n-'.")
    return last.map(lambda t: None if t is None else one(t))


def register(spark: SparkSession, gazetteer: Gazetteer | None = None) -> list[str]:
    """Registers ``norm_last``, ``kw_basic``, ``binom_two_sided`` and, with a gazetteer, ``extract_country``; their names."""
    functions = {"norm_last": norm_last, "kw_basic": folded, "binom_two_sided": binomial_p}
    if gazetteer is not None:
        names = {k: v for k, v in gazetteer.names.items()}

        @F.pandas_udf(T.StringType())
        def extract_country(affil: pd.Series) -> pd.Series:
            """The country whose name stands last in an affiliation; the operator for whole tables is ``Gazetteer.resolve``."""
            return affil.map(lambda t: max(((t.lower().rfind(n), len(n), c) for n, c in names.items() if t and n in t.lower()), default=(0, 0, "Unknown"))[2])

        functions["extract_country"] = extract_country
    for name, function in functions.items():
        spark.udf.register(name, function)
    return list(functions)


def resolve_affiliation(segments: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """(segment, canonical, parent, cluster, matched_by, tier): the table function behind institutions, over a table of segments."""
    found = resolve_by_pattern(segments, column, aliases)
    return found.select(column, "canonical", "parent", "cluster", F.when(F.col("canonical").isNotNull(), "alias").otherwise("unresolved").alias("matched_by"), "tier")
