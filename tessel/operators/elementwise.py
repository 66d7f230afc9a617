"""Comparison, logic, selection and mathematical functions of every element."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessel.functions import scalar
from tessel.functions.dtypes import normal, spark_type
from tessel.operators.array import (
    Array,
    _converted,
    binary,
    common_type,
    elementwise,
    is_scalar,
    zeros_like,
)


def _compare(name: str, op: str):
    def f(a, b):
        return binary(name, lambda x, y, kind: scalar.compare(op, x, y, kind), a, b, out=bool)

    f.__name__, f.__doc__ = name, f"Elementwise {name}; comparisons with NaN are IEEE's."
    return f


equal, not_equal = _compare("equal", "eq"), _compare("not_equal", "ne")
less, less_equal = _compare("less", "lt"), _compare("less_equal", "le")
greater, greater_equal = _compare("greater", "gt"), _compare("greater_equal", "ge")


def _logical(name: str, f):
    def g(a, b):
        if is_scalar(a) and is_scalar(b):
            return getattr(np, name)(a, b)
        kinds = [x.dtype.kind if isinstance(x, Array) else np.asarray(x).dtype.kind for x in (a, b)]
        args = [x if isinstance(x, Array) else _converted(x, np.asarray(x).dtype) for x in (a, b)]
        return elementwise(lambda x, y: f(scalar.truth(x, kinds[0]), scalar.truth(y, kinds[1])), bool, *args)

    g.__name__ = name
    return g


logical_and = _logical("logical_and", lambda x, y: x & y)
logical_or = _logical("logical_or", lambda x, y: x | y)


def logical_not(a):
    if is_scalar(a):
        return np.logical_not(a)
    return elementwise(lambda x: ~scalar.truth(x, a.dtype.kind), bool, a)


def where(condition, x=None, y=None):
    """x where the condition is true, else y; all three broadcast."""
    if x is None or y is None:
        raise NotImplementedError("where needs both branches: shapes can't depend on data")
    if is_scalar(condition) and is_scalar(x) and is_scalar(y):
        return np.where(condition, x, y)[()]
    dtype = common_type(x, y)
    c = condition if isinstance(condition, Array) else F.lit(bool(condition))
    kind = c.dtype.kind if isinstance(c, Array) else "b"
    return elementwise(
        lambda p, a, b: F.when(scalar.truth(p, kind), a).otherwise(b), dtype, c, _converted(x, dtype), _converted(y, dtype)
    )


def maximum(a, b):
    return binary("maximum", lambda x, y, kind: scalar.extreme("max", x, y, kind), a, b)


def minimum(a, b):
    return binary("minimum", lambda x, y, kind: scalar.extreme("min", x, y, kind), a, b)


def _unary(name: str):
    def f(a):
        if is_scalar(a):
            return getattr(np, name)(a)
        if a.dtype.kind == "c":
            return elementwise(lambda x: scalar.complex_unary(name, x), a.dtype, a)
        if a.dtype.kind != "f":
            raise ValueError(f"{name} takes floating-point arrays, not {a.dtype}")
        return elementwise(lambda x: scalar.UNARY[name](x).cast(spark_type(a.dtype)), a.dtype, a)

    f.__name__ = name
    return f


sqrt, exp, log, log10 = map(_unary, ("sqrt", "exp", "log", "log10"))
sin, cos, tan, arcsin, arccos, arctan = map(_unary, ("sin", "cos", "tan", "arcsin", "arccos", "arctan"))
sinh, cosh, tanh = map(_unary, ("sinh", "cosh", "tanh"))


def arctan2(y, x):
    if is_scalar(y) and is_scalar(x):
        return np.arctan2(y, x)
    dtype = common_type(y, x)
    if dtype.kind != "f":
        raise ValueError("arctan2 takes floating-point arrays")
    if isinstance(y, Array) and isinstance(x, Array) and y.shape != x.shape:
        raise ValueError(f"shapes {y.shape} and {x.shape} differ")
    f = lambda a, b: F.atan2(a, b).cast(spark_type(dtype))
    return elementwise(f, dtype, _converted(y, dtype), _converted(x, dtype))


def abs(a):
    if is_scalar(a):
        return np.abs(a)
    if a.dtype.kind == "c":
        out = normal("float32" if a.dtype == np.complex64 else "float64")
        return elementwise(lambda x: F.hypot(x["re"], x["im"]).cast(spark_type(out)), out, a)
    return a if a.dtype.kind in "ub" else elementwise(F.abs, a.dtype, a)


def isnan(a):
    """int32, 1 for NaN."""
    if is_scalar(a):
        return np.int32(np.isnan(a))
    if a.dtype.kind == "c":
        return elementwise(lambda x: (F.isnan(x["re"]) | F.isnan(x["im"])).cast("int"), "int32", a)
    return elementwise(lambda x: F.isnan(x).cast("int"), "int32", a)


def _part_type(a: Array):
    return normal("float32" if a.dtype == np.complex64 else "float64")


def real(a):
    if is_scalar(a):
        return np.real(a)
    return elementwise(lambda x: x["re"].cast(spark_type(_part_type(a))), _part_type(a), a) if a.dtype.kind == "c" else a


def imag(a):
    if is_scalar(a):
        return np.imag(a)
    if a.dtype.kind != "c":
        return zeros_like(a)
    return elementwise(lambda x: x["im"].cast(spark_type(_part_type(a))), _part_type(a), a)


def conj(a):
    if is_scalar(a):
        return np.conj(a)
    if a.dtype.kind != "c":
        return a
    return elementwise(lambda x: F.struct(x["re"].alias("re"), (-x["im"]).alias("im")), a.dtype, a)


