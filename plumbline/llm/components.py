"""Connected components of a link table, by alternating star contractions.

Each round hangs a node's larger neighbours on its smallest one, then its smaller neighbours too;
after a logarithmic number of rounds every component is one star around its smallest id. Minima are
pre-aggregated before the shuffle and the join back is splittable, so a node with very many links is
no bottleneck. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_scratch, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hung.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (bigint). Returns id, component for every node that isn't its component's smallest."""
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        after = materialise(_small_star(_large_star(edges)), "stars")
        drop_scratch(edges)
        edges = after
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
