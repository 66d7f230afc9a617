"""Functions over arrays: traced ones are ordinary Python, kernels are vectorised functions of Spark's."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import scalar
from tessel.functions.dtypes import normal, spark_type
from tessel.operators.array import Array, align


def trace_call(f: Callable, *args, **kwargs):
    """f of the arrays.  Building is lazy, so calling is inlining; the result must be arrays, alone or in a tuple
    or dict."""
    for name in kwargs:
        if re.fullmatch(r"_in\d+", name):
            raise ValueError(f"{name} is a reserved name")
    found = f(*args, **kwargs)
    parts = found.values() if isinstance(found, dict) else found if isinstance(found, tuple) else (found,)
    if not all(isinstance(x, Array) for x in parts):
        raise TypeError("a traced function returns arrays")
    return found


def map_kernel(f: Callable[..., np.ndarray], dtype, *args: Array) -> Array:
    """A NumPy function of elements, for what Column expressions can't say: batches of the broadcast arguments
    come as arrays, and one array of as many elements goes back."""
    frame, dtype = align(args), normal(dtype)
    kernel = F.pandas_udf(lambda *xs: pd.Series(f(*[x.to_numpy() for x in xs])), spark_type(dtype))
    return Array(frame.df, frame.shape, dtype, kernel(*frame.values))


def call_kernel(f: Callable[..., dict], outputs: dict[str, tuple], *args: Array) -> dict[str, Array]:
    """A foreign kernel of whole rows: f gets the arguments' rows along their first axis, which they share, as
    NumPy arrays, and gives back one array for each output, named with (row shape, dtype).

    Rows are independent groups: each is gathered in one task, so a row has to fit into memory; the first axis
    is what is distributed.  Values keep their types, whole numbers of 64 bits and complex ones too.  A length of a
    row shape may be (argument, axis): that of an argument.
    """
    n = args[0].shape[0]
    if any(not a.ndim or a.shape[0] != n for a in args):
        raise ValueError("the arguments share their first axis")
    specs = {k: (tuple(_length(n, args) for n in s), normal(t)) for k, (s, t) in outputs.items()}
    parts = [
        a.df.select(
            F.col("i0"),
            F.lit(k).alias("arg"),
            F.array(*[F.col(f"i{d}") for d in range(1, a.ndim)]).cast("array<bigint>").alias("at"),
            *_typed(a.value, a.dtype),
        )
        for k, a in enumerate(args)
    ]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)

    def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        given = []
        for k, (a_shape, dtype) in enumerate(zip(shapes, dtypes)):
            own = pdf[pdf["arg"] == k]
            x, values = np.zeros(a_shape, dtype), _values(own, dtype)
            if a_shape:
                x[tuple(np.stack(own["at"].to_list()).T)] = values
            else:
                x[()] = values[0]
            given.append(x)
        found = f(*given)
        out = []
        for name, (shape, dtype) in specs.items():
            value = np.broadcast_to(np.asarray(found[name]).astype(dtype), shape).ravel()
            at = [list(map(int, i)) for i in np.ndindex(*shape)]
            columns = {c: None for c in _TYPED} | _columns(value)
            out.append(pd.DataFrame({"name": name, "i0": key[0], "at": at, **columns}))
        return pd.concat(out).astype({"whole": "Int64", "re": float, "im": float})

    shapes, dtypes = [a.shape[1:] for a in args], [a.dtype for a in args]
    done = cells.groupBy("i0").applyInPandas(rows, "name string, i0 bigint, at array<bigint>, whole bigint, re double, im double")
    result = {}
    for name, (shape, dtype) in specs.items():
        own = done.filter(F.col("name") == name)
        names = [F.get("at", F.lit(k)).alias(f"i{k + 1}") for k in range(len(shape))]
        result[name] = Array(own.select("i0", *names, _untyped(dtype).alias("v")), (n, *shape), dtype)
    return result


#: A cell on its way through a kernel: whole numbers in one column, others in one or two, so that nothing is rounded.
_TYPED = ("whole", "re", "im")


def _typed(v: Column, dtype: np.dtype) -> list[Column]:
    none = F.lit(None)
    if dtype.kind == "c":
        held = none.cast("bigint"), v["re"], v["im"]
    elif dtype.kind == "f":
        held = none.cast("bigint"), v.cast("double"), none.cast("double")
    else:
        whole = scalar.as_signed(v) if dtype == np.uint64 else v.cast("int").cast("bigint") if dtype.kind == "b" else v.cast("bigint")
        held = whole, none.cast("double"), none.cast("double")
    return [c.alias(n) for c, n in zip(held, _TYPED)]


def _untyped(dtype: np.dtype) -> Column:
    if dtype.kind == "c":
        return F.struct("re", "im")
    if dtype.kind == "f":
        return F.col("re").cast(spark_type(dtype))
    if dtype == np.uint64:
        return scalar.wrapped(F.col("whole"), 64)
    return F.col("whole").cast(spark_type(dtype))


def _values(cells: pd.DataFrame, dtype: np.dtype) -> np.ndarray:
    if dtype.kind == "c":
        return cells["re"].to_numpy() + 1j * cells["im"].to_numpy()
    if dtype.kind == "f":
        return cells["re"].to_numpy(float).astype(dtype)
    # Beside cells without a whole number pandas would make these doubles; as Arrow's nullable type they stay whole.
    return np.array(cells["whole"].tolist(), np.int64).astype(dtype)


def _columns(value: np.ndarray) -> dict:
    if value.dtype.kind == "c":
        return {"re": value.real, "im": value.imag}
    if value.dtype.kind == "f":
        return {"re": value.astype(float)}
    return {"whole": value.astype(np.int64)}


def _length(n: int | tuple[int, int], args: Sequence[Array]) -> int:
    """A length of an output's rows: a number, or (argument, axis) for the length that an argument has there."""
    return operator.index(n) if not isinstance(n, tuple) else args[n[0]].shape[n[1]]


def row_batches(f: Callable[[np.ndarray], np.ndarray], vectors, column: str, width: int, dtype="float64") -> Array:
    """A NumPy function of many row vectors at a time (as a matrix), for tables that hold a row in one array:
    the rows stream through the tasks in batches, without a shuffle."""
    dtype = normal(dtype)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = np.asarray(f(np.stack(b["xs"].to_list())), dtype)
                yield pd.DataFrame({"i0": b["i0"], "vs": list(found)})

    rows = vectors.select(F.col(vectors.columns[0]).cast("bigint").alias("i0"), F.col(column).cast("array<double>").alias("xs"))
    n = rows.count()
    done = rows.mapInPandas(kernel, f"i0 bigint, vs array<{spark_type(dtype)}>")
    df = done.select("i0", F.posexplode("vs").alias("i1", "v")).select("i0", F.col("i1").cast("bigint").alias("i1"), "v")
    return Array(df, (n, width), dtype)
