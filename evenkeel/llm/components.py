"""Classes of linked items, wholly as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, stored


def classes(links: DataFrame) -> DataFrame:
    """(item, class): the smallest item reachable over ``links`` (a, b), for every item that has a link.

    Alternating stars: every item links its larger neighbours to its smallest one, then every item its smaller
    neighbours; each round is stored, so lineage stays short, and the rounds end when no link changes (about the
    logarithm of the longest path). A star of a third of all items is a counted minimum and one joined row an item,
    never one task's list.
    """
    edges, path = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "classes"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large, large_path = stored(large, "classes")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        new, new_path = stored(small, "classes")
        # A round that leaves the same links has reached stars around the smallest items.
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        done = edges.agg(*mark).first() == new.agg(*mark).first()
        forget(edges.sparkSession, path, large_path)
        edges, path = new, new_path
        if done:
            return edges.select(F.col("a").alias("item"), F.col("b").alias("class")).unionByName(
                edges.select(F.col("b").alias("item"), F.col("b").alias("class")).distinct()
            )
