"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import shuffled, stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) links that is not the least of its component.

    Alternates two rewrites of the links: a node hangs its larger neighbours under its least one,
    then a node and its smaller neighbours hang under the least of them.  Both keep the components
    and never add links; after a logarithmic number of rounds every component is a star.
    """
    def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(a) != F.col(b)).select(
            F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    now = stage(ordered(links, "a", "b"))
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = shuffled(both).join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = shuffled(large).join(down, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
                              F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        after = stage(ordered(small.select("e.x", "e.y"), "x", "y"))
        if after.count() == now.count() and shuffled(after).join(now, ["a", "b"], "left_anti").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
