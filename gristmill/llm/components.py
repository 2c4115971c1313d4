"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is an aggregation with partial sums and a join whose skewed side Spark can
split; no neighbour list is collected, and links never reach the driver.  A round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, shared_path


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node's smallest reachable node; links are (src long, dst long)."""
    spark = links.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "links"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def least(of: DataFrame) -> DataFrame:
        # Written, so that both sides of the join are plain exchanges and a hub's rows can be split.
        return kept(of.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))

    # Links point from the larger node u to the smaller v.
    now = kept(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u is linked to u's least neighbour.
        large = kept(both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its smaller neighbours are linked to the least of them.
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = kept(small.filter("u <> v").distinct())
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        for path in paths[:-1]:
            delete_path(spark, path)
        del paths[:-1]
        if state == (mark["n"], mark["x"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (mark["n"], mark["x"])
