"""Shapes: broadcasting, axes, slices and grids of coordinates."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CannotBroadcastError(ValueError):
    pass


def normal_shape(shape) -> tuple[int, ...]:
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    out = tuple(operator.index(n) for n in shape)
    if any(n < 0 for n in out):
        raise ValueError(f"negative length in shape {out}")
    return out


def broadcast_shapes(*shapes: tuple[int, ...]) -> tuple[int, ...]:
    """Right-aligned; a length of 1 stretches."""
    out = []
    for lengths in zip(*[(1,) * (max(map(len, shapes), default=0) - len(s)) + s for s in shapes]):
        real = {n for n in lengths if n != 1}
        if len(real) > 1:
            raise CannotBroadcastError(f"shapes {shapes} don't go together")
        out.append(real.pop() if real else 1)
    return tuple(out)


def one_axis(axis: int, ndim: int) -> int:
    at = axis + ndim if axis < 0 else axis
    if not 0 <= at < ndim:
        raise ValueError(f"axis {axis} is out of range for {ndim} axes")
    return at


def reduced_axes(axis, ndim: int) -> tuple[int, ...]:
    """All axes for None; negative ones are rejected."""
    if axis is None:
        return tuple(range(ndim))
    axes = (axis,) if isinstance(axis, int) else tuple(axis)
    if any(not 0 <= a < ndim for a in axes):
        raise ValueError(f"axis {axis} is out of range for {ndim} axes")
    if len(set(axes)) < len(axes):
        raise ValueError(f"axis {axis} names one twice")
    return axes


def strides(shape: Sequence[int], order: str = "C") -> list[int]:
    if order not in "CF" or len(order) != 1:
        raise ValueError(f"order {order!r}")
    out, step = [], 1
    for n in shape if order == "F" else reversed(shape):
        out.append(step)
        step *= n
    return out if order == "F" else out[::-1]


def flat_index(coords: Iterable[Column], shape: Sequence[int], order: str = "C") -> Column:
    total = F.lit(0).cast("bigint")
    for c, s in zip(coords, strides(shape, order)):
        total = total + c * s
    return total


def unflatten(flat: Column, shape: Sequence[int], order: str = "C") -> list[Column]:
    return [
        F.call_function("div", flat, F.lit(s).cast("bigint")) % max(1, n) if n != 1 else F.lit(0).cast("bigint")
        for n, s in zip(shape, strides(shape, order))
    ]


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All coordinates of a box, without a shuffle."""
    at = F.col("id")
    names = [c.alias(f"i{k}") for k, c in enumerate(unflatten(at, shape))]
    return spark.range(math.prod(shape)).select(*names) if names else spark.range(1).select()


def slice_parts(s: slice, length: int) -> tuple[int, int, int]:
    """Start, step and number of elements; bounds beyond the axis are clamped."""
    start, stop, step = s.indices(length)
    return start, step, len(range(start, stop, step))
