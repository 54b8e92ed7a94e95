"""The library's facts from a star schema of orders: an order is a record, its lines are authorships.

The supplier is the author (and institution), the supplier's nation the country, the customer's
segment the journal, part types the keywords; every seventh order's citation count is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Facts:
    """Tables of one folder; each method is one plan, so only the columns used are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def records(self) -> DataFrame:
        """(key, cust, year, cites) of every order."""
        o = self.table("orders")
        cites = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") / 1000).cast("int"))
        return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"), cites.alias("cites"))

    def lines(self) -> DataFrame:
        """(key, pos, author, part): lines numbered from 0 in a total order."""
        li = self.table("lineitem")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return li.select(F.col("l_orderkey").alias("key"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("part"))

    def nations(self) -> DataFrame:
        """(author, country, region): a supplier's nation and region."""
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("author"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("s_name").alias("supplier"))

    def authorship(self) -> DataFrame:
        """Lines with their supplier's places and their order's year and citations."""
        return self.lines().join(self.nations(), "author").join(self.records(), "key")

    def journals(self) -> DataFrame:
        """Records with their journal, the customer's segment."""
        c = self.table("customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("journal"))
        return self.records().join(c, "cust", "left")

    def first_countries(self) -> DataFrame:
        """Records with the country of their first line; none without lines."""
        li = self.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("author"))
        return self.records().join(li.join(self.nations().select("author", "country"), "author"), "key", "left")

    def terms(self) -> DataFrame:
        """(key, term): the part types of an order."""
        p = self.table("part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("term"))
        li = self.table("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"))
        return li.join(p, "part").select("key", "term").distinct()

    def brands(self) -> DataFrame:
        """(key, term): the brands of an order's parts."""
        p = self.table("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("term"))
        li = self.table("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"))
        return li.join(p, "part").select("key", "term").distinct()

    def populations(self) -> DataFrame:
        """(country, population): customers of each nation."""
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("population"))
