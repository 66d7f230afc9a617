"""Messages between ranks: the leading axis of an array is the rank, and a route table says who sends to whom."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.array import Array
from tessel.operators.reshaping import roll


class RouteError(ValueError):
    pass


@dataclass(frozen=True)
class Send:
    source: int
    target: int
    tag: Hashable = 0


@dataclass(frozen=True)
class Receive:
    """On rank `target`: what `source` sends under `tag`."""

    source: int
    target: int
    tag: Hashable = 0


def number_tags(*routes: Sequence[Send | Receive], base: int = 0) -> dict[Hashable, int]:
    """Symbolic tags as consecutive numbers, in the order in which they are first seen."""
    found: dict[Hashable, int] = {}
    for r in (x for part in routes for x in part):
        found.setdefault(r.tag, base + len(found))
    return found


def _table(spark: SparkSession, routes, tags: dict[Hashable, int]) -> DataFrame:
    return spark.createDataFrame([(r.source, r.target, tags[r.tag]) for r in routes], "source bigint, target bigint, tag int")


def verified_routes(spark: SparkSession, sends: Sequence[Send], receives: Sequence[Receive], ranks: int) -> DataFrame:
    """The route table, after checks that run on it: nothing goes to its own rank or beyond the ranks, nothing is
    sent or received twice, and each send has its receive."""
    tags = number_tags(sends, receives)
    out, into = _table(spark, sends, tags), _table(spark, receives, tags)
    if out.union(into).filter("source = target").limit(1).count():
        raise NotImplementedError("a rank can't send to itself")
    if out.union(into).filter(~F.col("source").between(0, ranks - 1) | ~F.col("target").between(0, ranks - 1)).limit(1).count():
        raise RouteError("a rank that doesn't exist")
    key = ["source", "target", "tag"]
    for name, table in (("sent", out), ("received", into)):
        if twice := table.groupBy(*key).count().filter("count > 1").limit(1).collect():
            raise RouteError(f"{tuple(twice[0])[:3]} is {name} twice")
    for name, x, y in (("received", out, into), ("sent", into, out)):
        if lone := x.join(y, key, "left_anti").limit(1).collect():
            raise RouteError(f"{tuple(lone[0])} is never {name}")
    return out


def exchange(a: Array, routes: DataFrame) -> dict[int, Array]:
    """By tag: an array that holds, at a receiver's rank, what its sender had; ranks that get nothing hold zeros.

    One equality join with the route table moves all messages.
    """
    from tessel.operators.sparse import _on_grid

    names = [f"i{k}" for k in range(1, a.ndim)]
    cells = a.df.select("i0", *names, a.value.alias("v"))
    moved = cells.join(routes, F.col("i0") == F.col("source"))  # broadcast by Spark where the table's size allows
    tags = [r.tag for r in routes.select("tag").distinct().orderBy("tag").collect()]
    out = {}
    for tag in tags:
        part = moved.filter(F.col("tag") == tag).select(F.col("target").alias("i0"), *names, "v")
        out[tag] = _on_grid(part, a.shape, a.dtype)
    return out


def ring(a: Array, step: int = 1) -> Array:
    """Every rank receives from the rank `step` above it: new coordinates, no join."""
    return roll(a, -step, 0)
