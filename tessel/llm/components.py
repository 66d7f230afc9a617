"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, spread_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return spread_join(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = spread_join(down, least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex; the component is its smallest vertex.

    `vertices` has one column of distinct values, `edges` the columns src and dst over them.  Each round reads
    and writes as many edges as there are at most; rounds end when the edges stay the same, which is when each
    vertex points at its component's smallest.  The driver sees a count and a checksum a round.
    """
    name = vertices.columns[0]
    work = cut(edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), "components")
    before = _state(work)
    while before[0]:
        work = cut(_small_star(_large_star(work)), "components")
        after = _state(work)
        if after == before:
            break
        before = after
    return vertices.join(work.select(F.col("a").alias(name), "b"), name, "left").select(
        name, F.coalesce("b", name).alias("component")
    )
