"""Reductions over axes: partial and final aggregation by the axes that are kept."""

from __future__ import annotations

import builtins
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import scalar
from tessel.functions.dtypes import spark_type
from tessel.operators.array import Array, full
from tessel.operators.shapes import flat_index, reduced_axes

_MISSING = object()


def _neutral(name: str, dtype: np.dtype):
    if name in ("sum", "any"):
        return 0
    if name in ("prod", "all"):
        return 1
    if dtype.kind == "f":
        return -math.inf if name == "amax" else math.inf
    if dtype.kind in "iu":
        return (np.iinfo(dtype).min if name == "amax" else np.iinfo(dtype).max).item()
    raise TypeError(f"{name} has no neutral element in {dtype}")


def _aggregate(name: str, a: Array) -> Column:
    """An aggregate of column v, in the array's own type."""
    v, kind, to = F.col("v"), a.dtype.kind, spark_type(a.dtype)
    if name in ("all", "any"):
        found = (F.bool_and if name == "all" else F.bool_or)(scalar.truth(v, kind))
        return found if kind == "b" else found.cast("int").cast(to)
    if kind == "c":
        if name != "sum":
            raise NotImplementedError(f"{name} of complex values")
        return F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))
    if kind == "b":
        return {"sum": F.bool_or(v), "prod": F.bool_and(v), "amax": F.bool_or(v), "amin": F.bool_and(v)}[name]
    if name == "sum":
        return scalar.wrapped(F.sum(v), 8 * a.dtype.itemsize).cast(to) if kind == "u" else F.sum(v).cast(to)
    if name == "prod":
        return F.product(v).cast(to)
    if name == "amax":
        return F.max(v)  # NaN is Spark's greatest value, so it propagates
    if kind == "f":
        return F.when(F.bool_or(F.isnan(v)), scalar.NAN).otherwise(F.min(v)).cast(to)
    return F.min(v)


#: Factors that are multiplied at a time.
_FACTORS = 64


def _whole_products(rows, groups: list[Column], a: Array, axes: tuple[int, ...]):
    """Exact products of integers: in rounds, each over lists of `_FACTORS` cells, which the coordinates of the
    reduced axes number, so that no list grows with the array.  Signed overflow raises at the end, unless a factor
    is 0; unsigned products wrap."""
    n = math.prod(a.shape[k] for k in axes)
    flat = flat_index([F.col(f"i{k}") for k in axes], [a.shape[k] for k in axes])
    names = [f"i{j}" for j in range(len(groups))]
    wraps = a.dtype.kind == "u"
    v = F.col("v") if wraps else F.when(F.col("v") == 0, 1).otherwise(F.col("v")).cast("bigint")
    work = rows.select(*groups, flat.alias("at"), v.alias("p"), (F.col("v") == 0).alias("zero"))

    def times(x: Column, y: Column) -> Column:
        return scalar.unsigned_multiply(x, y, 8 * a.dtype.itemsize).cast(spark_type(a.dtype)) if wraps else F.try_multiply(x, y)

    while True:
        work = work.withColumn("at", F.call_function("div", F.col("at"), F.lit(_FACTORS).cast("bigint")))
        factors = F.collect_list(F.struct("p"))
        one = F.lit(1).cast(spark_type(a.dtype) if wraps else "bigint")
        product = F.aggregate(factors, one, lambda x, y: times(x, y["p"]))
        work = work.groupBy(*names, "at").agg(product.alias("p"), F.bool_or("zero").alias("zero"))
        n = -(-n // _FACTORS)
        if n == 1:
            break
    over = F.raise_error(F.lit("integer overflow in a product")).cast("bigint")
    whole = F.when(F.col("zero"), 0).when(F.col("p").isNull(), over).otherwise(F.col("p"))
    return work.select(*names, F.col("p").alias("v") if wraps else whole.cast(spark_type(a.dtype)).alias("v"))


def _reduce(name: str, a: Array, axis, initial=_MISSING) -> Array:
    axes = reduced_axes(axis, a.ndim)
    if initial is not _MISSING and initial is not None and initial != _neutral(name, a.dtype):
        raise ValueError(f"the initial value of {name} must be its neutral element")
    kept = [k for k in range(a.ndim) if k not in axes]
    shape = tuple(a.shape[k] for k in kept)
    if builtins.any(a.shape[k] == 0 for k in axes):
        if name in ("amax", "amin") and initial is _MISSING:
            raise ValueError(f"{name} over an empty axis needs an initial value")
        return full(a.spark, shape, _neutral(name, a.dtype), a.dtype)
    if not axes:
        return a
    rows = a.relation()
    groups = [F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)]
    if name == "prod" and a.dtype.kind in "iu":
        out = _whole_products(rows, groups, a, axes)
    else:
        out = rows.groupBy(*groups).agg(_aggregate(name, a).alias("v"))
    return Array(out, shape, a.dtype, tags=a.tags, axis_tags=[a.axis_tags[k] for k in kept])


def sum(a: Array, axis=None, initial=0) -> Array:
    return _reduce("sum", a, axis, initial)


def prod(a: Array, axis=None, initial=1) -> Array:
    """Integer products are exact; floating-point ones are aggregated in doubles."""
    return _reduce("prod", a, axis, initial)


def amax(a: Array, axis=None, initial=_MISSING) -> Array:
    return _reduce("amax", a, axis, initial)


def amin(a: Array, axis=None, initial=_MISSING) -> Array:
    return _reduce("amin", a, axis, initial)


def all(a: Array, axis=None) -> Array:
    """Whether all elements are true, in the array's own type."""
    return _reduce("all", a, axis)


def any(a: Array, axis=None) -> Array:
    return _reduce("any", a, axis)


__all__ = ["sum", "prod", "amax", "amin", "all", "any"]
