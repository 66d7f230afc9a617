"""Element types: NumPy dtypes and the Spark types that hold them."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unsigned types are held one step wider; uint64 as a decimal.
SPARK_TYPES = {
    "bool": "boolean",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float32": "float",
    "float64": "double",
    "complex64": "struct<re:double,im:double>",
    "complex128": "struct<re:double,im:double>",
}


def normal(dtype) -> np.dtype:
    dtype = np.dtype(dtype)
    if dtype.name not in SPARK_TYPES:
        raise TypeError(f"no Spark type holds {dtype}")
    return dtype


def spark_type(dtype) -> str:
    return SPARK_TYPES[normal(dtype).name]


def result_type(*args) -> np.dtype:
    """NumPy's promotion; Python scalars take part as scalars."""
    return normal(np.result_type(*[np.dtype(a) if isinstance(a, (str, type, np.dtype)) else a for a in args]))


def cast(column: Column, dtype) -> Column:
    """To the Spark type of `dtype`; numbers become booleans by being different from zero."""
    return column.cast(spark_type(dtype))


def literal(value, dtype) -> Column:
    dtype = normal(dtype)
    if dtype.kind == "c":
        value = complex(value)
        return F.struct(F.lit(value.real).cast("double").alias("re"), F.lit(value.imag).cast("double").alias("im"))
    return F.lit(item(dtype.type(value), dtype)).cast(spark_type(dtype))


def item(value, dtype):
    """A NumPy scalar as the Python value that Spark takes for its type."""
    return Decimal(value.item()) if dtype == np.uint64 else value.item()
