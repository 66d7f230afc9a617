"""Indexing: integers and slices filter and move coordinates; arrays of indices are joined from the index side."""

from __future__ import annotations

import operator
from functools import reduce as fold

import numpy as np
from pyspark.sql import functions as F

from tessel.operators.array import Array, align, from_numpy, is_scalar
from tessel.operators.shapes import slice_parts

#: Tag of an index array without negative entries: it is not wrapped.
NON_NEGATIVE = "non-negative"


def _full(index, ndim: int) -> list:
    index = list(index) if isinstance(index, tuple) else [index]
    dots = [k for k, x in enumerate(index) if x is Ellipsis]
    if len(dots) > 1:
        raise IndexError("more than one ellipsis")
    if any(x is None for x in index):
        raise NotImplementedError("new axes: use expand_dims")
    given = len(index) - len(dots)
    if given > ndim:
        raise IndexError(f"{given} indices for {ndim} axes")
    if dots:
        index[dots[0] : dots[0] + 1] = [slice(None)] * (ndim - given)
    return index + [slice(None)] * (ndim - len(index))


def index_into(a: Array, index) -> Array:
    index = _full(index, a.ndim)
    for k, x in enumerate(index):
        if isinstance(x, (list, np.ndarray)):
            index[k] = from_numpy(a.spark, np.asarray(x))
    if any(isinstance(x, Array) for x in index):
        return _gather(a, index)
    return _basic(a, index)


def _whole(x, n: int, k: int) -> int:
    x = operator.index(x)
    if not -n <= x < n:
        raise IndexError(f"index {x} is out of range for axis {k} of length {n}")
    return x % n


def _basic(a: Array, index: list) -> Array:
    shape, coords, where, tags = [], [], [], []
    for k, (x, n) in enumerate(zip(index, a.shape)):
        at = F.col(f"i{k}")
        if isinstance(x, slice):
            start, step, count = slice_parts(x, n)
            shape.append(count)
            tags.append(a.axis_tags[k])
            moved = at - start
            if step != 1:
                coords.append(F.call_function("div", moved, F.lit(step).cast("bigint")))
            else:
                coords.append(moved if start else at)
            if count < n:
                last = start + (count - 1) * step
                where.append(at.between(min(start, last), max(start, last)) if count else F.lit(False))
                if step not in (1, -1):
                    where.append(moved % abs(step) == 0)
        else:
            where.append(at == _whole(x, n, k))
    return a.with_coords(shape, coords, fold(operator.and_, where) if where else None, tags)


def _gather(a: Array, index: list) -> Array:
    """Integers beside arrays count as index arrays for the place of the result's axes, and are filters.  The block
    of index axes stands where the indexed axes were if they are next to each other, and in front else.  Entries
    count from the end if negative."""
    advanced = [k for k, x in enumerate(index) if not isinstance(x, slice)]
    cut = _basic(a, [x if isinstance(x, slice) else slice(None) for x in index])
    for k in advanced:
        if is_scalar(index[k]):
            cut = cut._copy(df=cut.df.filter(F.col(f"i{k}") == _whole(index[k], a.shape[k], k)))
    joined = [k for k in advanced if not is_scalar(index[k])]
    arrays = []
    for k in joined:
        x = index[k]
        if x.dtype.kind not in "iu":
            raise IndexError(f"indices must be integers, not {x.dtype}")
        if a.shape[k] == 0 and x.size:
            raise IndexError(f"axis {k} is empty")
        arrays.append(x)
    frame = align(arrays)
    m = len(frame.shape)
    keys = []
    for k, x, v in zip(joined, arrays, frame.values):
        n, v = max(1, a.shape[k]), v.cast("bigint")
        keys.append((v if NON_NEGATIVE in x.tags else (v % n + n) % n).alias(f"k{k}"))
    places = frame.df.select(*[F.col(f"i{d}").alias(f"b{d}") for d in range(m)], *keys)
    cells = cut.df.select(*[F.col(f"i{k}").alias(f"a{k}") for k in range(a.ndim)], cut.value.alias("v"))
    on = [F.col(f"k{k}") == F.col(f"a{k}") for k in joined]
    size = int(np.prod(frame.shape))
    if size * 8 * (m + len(on)) <= 8 << 20:
        places = F.broadcast(places)
    elif cut.small():
        cells = F.broadcast(cells)
    found = places.join(cells, on)
    rest = [k for k in range(a.ndim) if k not in advanced]
    block = [(F.col(f"b{d}"), frame.shape[d]) for d in range(m)]
    if advanced == list(range(advanced[0], advanced[-1] + 1)):
        before = [k for k in rest if k < advanced[0]]
    else:
        before = []
    parts = [(F.col(f"a{k}"), cut.shape[k]) for k in before]
    parts += block + [(F.col(f"a{k}"), cut.shape[k]) for k in rest if k not in before]
    names = [c.alias(f"i{j}") for j, (c, _) in enumerate(parts)]
    return Array(found.select(*names, "v"), [n for _, n in parts], a.dtype)


def checked_gather(a: Array, index) -> Array:
    """Indexing that runs a job first to see that no entry is beyond its axis."""
    for k, x in enumerate(_full(index, a.ndim)):
        if isinstance(x, Array):
            n = a.shape[k]
            if x.df.filter(~x.value.cast("bigint").between(-n, n - 1)).limit(1).count():
                raise IndexError(f"an index is out of range for axis {k} of length {n}")
    return index_into(a, index)
