"""Shape manipulation: mostly new coordinates for the same cells, which is a projection without a shuffle."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import functions as F

from tessel.functions.dtypes import literal, result_type, spark_type
from tessel.operators.array import Array, _converted, coord_names
from tessel.operators.shapes import CannotBroadcastError, broadcast_shapes, flat_index, grid, normal_shape, one_axis, unflatten


def _coords(a: Array):
    return [F.col(c) for c in coord_names(a.ndim)]


def transpose(a: Array, axes: Sequence[int] | None = None) -> Array:
    axes = tuple(range(a.ndim))[::-1] if axes is None else tuple(axes)
    if sorted(axes) != list(range(a.ndim)):
        raise ValueError(f"{axes} is no permutation of {a.ndim} axes")
    at = _coords(a)
    return a.with_coords([a.shape[k] for k in axes], [at[k] for k in axes], axis_tags=[a.axis_tags[k] for k in axes])


def reshape(a: Array, newshape, order: str = "C") -> Array:
    """One length may be -1; C or Fortran order."""
    shape = [newshape] if isinstance(newshape, int) else [operator.index(n) for n in newshape]
    if order not in ("C", "F"):
        raise ValueError(f"order {order!r}")
    if shape.count(-1) > 1 or any(n < -1 for n in shape):
        raise ValueError(f"shape {tuple(shape)}")
    if -1 in shape:
        rest = math.prod(n for n in shape if n != -1)
        if rest == 0 or a.size % rest:
            raise ValueError(f"{a.size} elements don't fit shape {tuple(shape)}")
        shape[shape.index(-1)] = a.size // rest
    if math.prod(shape) != a.size:
        raise ValueError(f"{a.size} elements don't fit shape {tuple(shape)}")
    if tuple(shape) == a.shape:
        return a
    flat = a.df.select(flat_index(_coords(a), a.shape, order).alias("flat"), a.value.alias("v"))
    names = [c.alias(f"i{k}") for k, c in enumerate(unflatten(F.col("flat"), shape, order))]
    return Array(flat.select(*names, "v"), shape, a.dtype, tags=a.tags)


def ravel(a: Array) -> Array:
    return reshape(a, (a.size,))


def expand_dims(a: Array, axis) -> Array:
    axes = (axis,) if isinstance(axis, int) else tuple(axis)
    n = a.ndim + len(axes)
    new = [one_axis(k, n) for k in axes]
    if len(set(new)) < len(new):
        raise ValueError(f"axis {axis} names one twice")
    old = iter(zip(_coords(a), a.shape, a.axis_tags))
    parts = [(F.lit(0), 1, frozenset()) if k in new else next(old) for k in range(n)]
    return a.with_coords([p[1] for p in parts], [p[0] for p in parts], axis_tags=[p[2] for p in parts])


def squeeze(a: Array, axis=None) -> Array:
    if axis is None:
        gone = {k for k, n in enumerate(a.shape) if n == 1}
    else:
        gone = {one_axis(k, a.ndim) for k in ((axis,) if isinstance(axis, int) else axis)}
    if any(a.shape[k] != 1 for k in gone):
        raise ValueError("only axes of length 1 can be squeezed")
    kept = [k for k in range(a.ndim) if k not in gone]
    at = _coords(a)
    return a.with_coords([a.shape[k] for k in kept], [at[k] for k in kept], axis_tags=[a.axis_tags[k] for k in kept])


def broadcast_to(a: Array, shape) -> Array:
    """Each cell once for every place of the axes that stretch: generated beside it, without a join."""
    shape = normal_shape(shape)
    if len(shape) < a.ndim or _broadcast(a.shape, shape) != shape:
        raise ValueError(f"{a.shape} doesn't broadcast to {shape}")
    lead = len(shape) - a.ndim
    stretched = [k for k, n in enumerate(shape) if n != 1 and (k < lead or a.shape[k - lead] == 1)]
    if any(shape[k] == 0 for k in stretched):
        return Array(grid(a.spark, shape), shape, a.dtype, literal(0, a.dtype))
    names = [F.lit(0).cast("bigint") if k < lead else F.col(f"i{k - lead}") for k in range(len(shape))]
    df = a.df.select(*[c.alias(f"j{k}") for k, c in enumerate(names)], a.value.alias("v"))
    for k in stretched:
        df = df.withColumn(f"j{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shape[k] - 1).cast("bigint"))))
    return Array(df.select(*[F.col(f"j{k}").alias(f"i{k}") for k in range(len(shape))], "v"), shape, a.dtype)


def _broadcast(*shapes):
    try:
        return broadcast_shapes(*shapes)
    except CannotBroadcastError:
        return None


def roll(a: Array, shift: int, axis: int | None = None) -> Array:
    if a.ndim == 0 or shift == 0:
        return a
    if axis is None:
        if a.ndim > 1:
            raise NotImplementedError("rolling over several axes at once")
        axis = 0
    if not 0 <= axis < a.ndim:
        raise ValueError(f"axis {axis} is out of range")
    n, at = a.shape[axis], _coords(a)
    if n == 0:
        return a
    at[axis] = (at[axis] + shift % n) % n
    return a.with_coords(a.shape, at, axis_tags=a.axis_tags)


def _united(arrays: Sequence[Array], coords, shape, dtype) -> Array:
    parts = []
    for k, a in enumerate(arrays):
        b = _converted(a, dtype)
        names = [c.cast("bigint").alias(f"i{j}") for j, c in enumerate(coords(k, a))]
        parts.append(b.df.select(*names, b.value.cast(spark_type(dtype)).alias("v")))
    return Array(fold(lambda x, y: x.unionByName(y), parts), shape, dtype)


def stack(arrays: Sequence[Array], axis: int = 0) -> Array:
    arrays = list(arrays)
    if not arrays:
        raise ValueError("nothing to stack")
    shape, n = arrays[0].shape, arrays[0].ndim
    if any(a.shape != shape for a in arrays):
        raise ValueError("stacked arrays must have one shape")
    if not 0 <= axis <= n:
        raise ValueError(f"axis {axis} is out of range")
    place = lambda k, a: [*_coords(a)[:axis], F.lit(k), *_coords(a)[axis:]]
    return _united(arrays, place, (*shape[:axis], len(arrays), *shape[axis:]), result_type(*[a.dtype for a in arrays]))


def concatenate(arrays: Sequence[Array], axis: int = 0) -> Array:
    arrays = list(arrays)
    if not arrays:
        raise ValueError("nothing to concatenate")
    n = arrays[0].ndim
    if not 0 <= axis < n:
        raise ValueError(f"axis {axis} is out of range")
    rest = lambda a: (*a.shape[:axis], *a.shape[axis + 1 :])
    if any(a.ndim != n or rest(a) != rest(arrays[0]) for a in arrays):
        raise ValueError("shapes may differ on the axis only")
    before = [0]
    for a in arrays:
        before.append(before[-1] + a.shape[axis])

    def place(k, a):
        at = _coords(a)
        at[axis] = at[axis] + before[k]
        return at

    shape = (*arrays[0].shape[:axis], before[-1], *arrays[0].shape[axis + 1 :])
    return _united(arrays, place, shape, result_type(*[a.dtype for a in arrays]))


def _pairs(given, n: int, what: str) -> list[tuple]:
    if not isinstance(given, (tuple, list)):
        return [(given, given)] * n
    if len(given) == 2 and not any(isinstance(x, (tuple, list)) for x in given):
        return [tuple(given)] * n
    if len(given) == n and all(isinstance(x, (tuple, list)) and len(x) == 2 for x in given):
        return [tuple(x) for x in given]
    raise ValueError(f"{what} must be a number, a pair, or a pair for each axis")


def pad(a: Array, pad_width, mode: str = "constant", constant_values=0, **kwargs) -> Array:
    """Constants around an array.  In corners the last axis that is outside decides."""
    if mode != "constant":
        raise NotImplementedError(f"padding mode {mode!r}")
    if kwargs:
        raise ValueError(f"unknown arguments {sorted(kwargs)}")
    widths = _pairs(pad_width, a.ndim, "pad_width")
    values = _pairs(constant_values, a.ndim, "constant_values")
    if any(w < 0 for pair in widths for w in pair):
        raise ValueError("negative width")
    shape = tuple(n + x + y for n, (x, y) in zip(a.shape, widths))
    if shape == a.shape:
        return a
    inside = a.df.select(*[(c + w[0]).alias(f"j{k}") for k, (c, w) in enumerate(zip(_coords(a), widths))], a.value.alias("v"))
    box = grid(a.spark, shape)
    outer = F.lit(None)
    for k, ((before, _), n, (low, high)) in enumerate(zip(widths, a.shape, values)):
        at = F.col(f"i{k}")
        outer = F.when(at < before, literal(low, a.dtype)).when(at >= before + n, literal(high, a.dtype)).otherwise(outer)
    frame = box.filter(fold(lambda x, y: x | y, [~F.col(f"i{k}").between(w[0], w[0] + n - 1) for k, (w, n) in enumerate(zip(widths, a.shape))]))
    # The margin and the moved array are apart, so they are united and nothing is joined.
    margin = frame.select(*coord_names(a.ndim), outer.cast(spark_type(a.dtype)).alias("v"))
    moved = inside.select(*[F.col(f"j{k}").alias(f"i{k}") for k in range(a.ndim)], "v")
    return Array(moved.unionByName(margin), shape, a.dtype)
