"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's larger neighbours (large star), or its smaller ones and itself (small star), to the least of all.

    Minima are aggregated before the shuffle and joined back edge by edge, so a hub is never gathered.
    """
    if small:
        e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = e.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) reach, for each node of an edge. a and b differ."""
    edges = staged(edges.distinct(), "edges")
    state = None
    while True:
        edges = staged(_star(_star(edges, small=False), small=True), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
