"""Column expressions with NumPy's meaning, safe under ANSI mode.

Spark raises on division by zero, truncates integer quotients, orders NaN above all numbers and gives null for
logarithms outside their range.  All of that is settled here and nowhere else.  Signed overflow and integer
division by zero raise; unsigned types wrap, as C and NumPy have it.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _parts(x: Column) -> tuple[Column, Column]:
    return x["re"], x["im"]


def to_dtype(x: Column, old, new) -> Column:
    """A change of element type; real to complex adds a zero imaginary part."""
    from tessel.functions.dtypes import spark_type

    old, new = np.dtype(old), np.dtype(new)
    if new.kind == "c":
        return x if old.kind == "c" else _complex(x.cast("double"), F.lit(0.0))
    if old.kind == "c":
        raise NotImplementedError("complex values have no real counterpart: take real or imag")
    if old.kind == "f" and new.kind in "iu":
        raise NotImplementedError("floating point to integer")
    if new.kind == "u" and old.kind in "iu":
        return wrapped(x, 8 * new.itemsize).cast(spark_type(new))
    return x.cast(spark_type(new))


def add(a: Column, b: Column, kind: str) -> Column:
    if kind == "c":
        (p, q), (r, s) = _parts(a), _parts(b)
        return _complex(p + r, q + s)
    return a | b if kind == "b" else a + b


def subtract(a: Column, b: Column, kind: str) -> Column:
    if kind == "c":
        (p, q), (r, s) = _parts(a), _parts(b)
        return _complex(p - r, q - s)
    return a - b


def multiply(a: Column, b: Column, kind: str) -> Column:
    if kind == "c":
        (p, q), (r, s) = _parts(a), _parts(b)
        return _complex(p * r - q * s, p * s + q * r)
    return a & b if kind == "b" else a * b


def divide(a: Column, b: Column, kind: str = "f") -> Column:
    if kind == "c":
        return _complex_divide(a, b)
    # Zeros are equal; only their text tells the negative one.
    below = (a < 0) != b.cast("string").startswith("-")
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(below, -INF).otherwise(INF)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1).cast("double")).otherwise(b))


def _complex_divide(a: Column, b: Column) -> Column:
    """By the larger part of the divisor, so that its square can't overflow."""
    (p, q), (r, s) = _parts(a), _parts(b)
    wide = F.abs(r) >= F.abs(s)
    large, small = F.when(wide, r).otherwise(s), F.when(wide, s).otherwise(r)
    ratio = F.when(large == 0, 0.0).otherwise(divide(small, large))
    scale = large + small * ratio
    re = F.when(wide, p + q * ratio).otherwise(p * ratio + q)
    im = F.when(wide, q - p * ratio).otherwise(q * ratio - p)
    return _complex(divide(re, scale), divide(im, scale))


def _remainder(a: Column, b: Column) -> Column:
    """Of the truncated quotient, exact; not a number where there is none."""
    none = (b == 0) | F.isnan(b) | F.isnan(a) | a.isin(INF, -INF)
    return F.when(none, NAN).otherwise(a % F.when(none, F.lit(1).cast("double")).otherwise(b))


def _apart(r: Column, b: Column) -> Column:
    """A remainder that has the other sign than the divisor."""
    return (r != 0) & ((r < 0) != (b < 0))


def floor_divide(a: Column, b: Column, kind: str) -> Column:
    if kind == "f":
        r = _remainder(a, b)
        whole = (a - r) / F.when(b == 0, F.lit(1).cast("double")).otherwise(b) - F.when(_apart(r, b), 1.0).otherwise(0.0)
        odd = F.isnan(whole) | (F.abs(whole) >= 2.0**52)
        # The quotient of what is divisible may be off by its rounding.
        near = F.round(F.when(odd, 0.0).otherwise(whole)).cast("double")
        return F.when(b == 0, divide(a, b)).when(odd, whole).otherwise(near)
    if kind == "u":
        # Exact: what is divided is a multiple of the divisor.
        return ((a - a % b) / b).cast("decimal(20,0)")
    a, b = a.cast("bigint"), b.cast("bigint")
    whole = F.call_function("div", a, b)
    return whole - _apart(a % b, b).cast("bigint")


def modulo(a: Column, b: Column, kind: str) -> Column:
    """The remainder has the divisor's sign."""
    r = _remainder(a, b) if kind == "f" else a % b
    if kind == "f":
        r = F.when(r == 0, F.when(b < 0, F.lit(-0.0)).otherwise(0.0)).otherwise(r)
    return F.when(_apart(r, b), r + b).otherwise(r)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def whole_power(a: Column, b: Column, times) -> Column:
    """An exact power of integers by repeated squares; `times` multiplies.  Negative exponents raise."""
    out, square = F.lit(1), a
    for k in range(6):
        bit = F.shiftright(b, k) % 2 == 1
        out = F.when(bit, times(out, square)).otherwise(out)
        # No square beyond the last that counts: it might overflow for nothing.
        square = F.when(F.shiftright(b, k + 1) > 0, times(square, square)).otherwise(F.lit(1))
    bad = F.raise_error(F.lit("integers to negative integer powers"))
    # From 64 on only 0, 1 and -1 have powers in 64 bits.
    far = F.when(F.abs(a) <= 1, F.when(b % 2 == 0, a * a).otherwise(a)).otherwise(F.raise_error(F.lit("integer overflow")).cast("bigint"))
    return F.when(b < 0, bad.cast("bigint")).when(b >= 64, far).otherwise(out)


def wrapped(x: Column, bits: int) -> Column:
    """A whole number modulo 2**bits, as unsigned types of 8, 16 and 32 bits (bigint) and 64 (decimal) hold it."""
    if bits < 64:
        return x.cast("bigint").bitwiseAND((1 << bits) - 1)
    return F.pmod(x.cast("decimal(38,0)"), F.lit(Decimal(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def as_signed(x: Column) -> Column:
    """The bits of an unsigned number of 64 bits as a bigint."""
    over = x >= F.lit(Decimal(1 << 63))
    return F.when(over, x - F.lit(Decimal(1 << 64))).otherwise(x).cast("bigint")


def unsigned_multiply(a: Column, b: Column, bits: int) -> Column:
    """The product modulo 2**bits, whose steps fit into a bigint or a decimal."""
    if bits < 32:
        return wrapped(a.cast("bigint") * b.cast("bigint"), bits)
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    if bits == 32:
        return (a * b % F.lit(Decimal(1 << 32)).cast("decimal(20,0)")).cast("bigint")
    half = F.lit(Decimal(1 << 32)).cast("decimal(20,0)")
    low = (a % half).cast("decimal(10,0)")
    high = ((a - low) / half).cast("decimal(10,0)")
    upper = (high * (b % half).cast("decimal(10,0)") % half).cast("decimal(10,0)")
    return wrapped(upper.cast("decimal(20,0)") * half.cast("decimal(11,0)") + low * b, 64)


def bitwise(op: str, a: Column, b: Column, kind: str) -> Column:
    if kind == "b":
        return {"and": a & b, "or": a | b, "xor": a != b}[op]
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}[op]


def compare(op: str, a: Column, b: Column, kind: str) -> Column:
    """IEEE comparison: NaN is unequal to everything, itself too."""
    if kind == "c":
        same = (a["re"] == b["re"]) & (a["im"] == b["im"])
        return {"eq": same, "ne": ~same}[op]
    out = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    if kind != "f":
        return out
    nan = F.isnan(a) | F.isnan(b)
    return (out | nan) if op == "ne" else (out & ~nan)


def truth(a: Column, kind: str) -> Column:
    """Whether an element counts as true: NaN does, zero does not."""
    if kind == "b":
        return a
    if kind == "c":
        return (a["re"] != 0) | (a["im"] != 0)
    return a != 0


def extreme(op: str, a: Column, b: Column, kind: str) -> Column:
    """maximum or minimum; NaN propagates."""
    out = F.greatest(a, b) if op == "max" else F.least(a, b)
    return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(out) if kind == "f" else out


def _log(x: Column, f) -> Column:
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(f(F.when(x > 0, x).otherwise(1.0)))


#: Functions of a floating-point element.
UNARY = {
    "sqrt": F.sqrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "exp": F.exp,
    "log": lambda x: _log(x, F.ln),
    "log10": lambda x: _log(x, F.log10),
}


def complex_unary(name: str, x: Column) -> Column:
    a, b = _parts(x)
    size, angle = F.hypot(a, b), F.atan2(b, a)
    if name == "exp":
        return _complex(F.exp(a) * F.cos(b), F.exp(a) * F.sin(b))
    if name == "log":
        return _complex(_log(size, F.ln), angle)
    if name == "sqrt":
        return _complex(F.sqrt(size) * F.cos(angle / 2), F.sqrt(size) * F.sin(angle / 2))
    if name in ("sin", "cos"):
        s, c = (F.sin(a), F.cos(a)) if name == "sin" else (F.cos(a), -F.sin(a))
        return _complex(s * F.cosh(b), c * F.sinh(b))
    if name in ("sinh", "cosh"):
        s, c = (F.sinh(a), F.cosh(a)) if name == "sinh" else (F.cosh(a), F.sinh(a))
        return _complex(s * F.cos(b), c * F.sin(b))
    if name in ("tan", "tanh"):
        top, below = ("sin", "cos") if name == "tan" else ("sinh", "cosh")
        return divide(complex_unary(top, x), complex_unary(below, x), "c")
    raise NotImplementedError(f"{name} of complex values")
