"""Tables as arrays.  A table with a dense key is a vector; others are aggregated to unique coordinates first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.dtypes import literal, spark_type
from tessel.operators.array import Array, coord_names, from_relation
from tessel.operators.shapes import grid
from tessel.operators.sparse import CSRMatrix


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_key(df: DataFrame, key: str) -> None:
    """One aggregate that raises where a key is not 0 .. n-1, each once."""
    n, least, most, kinds = df.agg(F.count("*"), F.min(key), F.max(key), F.count_distinct(key)).first()
    if n and (least, most, kinds) != (0, n - 1, n):
        raise ValueError(f"{key} has {kinds} values from {least} to {most} in {n} rows")


def vector(df: DataFrame, key: str, value: Column | str, dtype, check: bool = False) -> Array:
    """A column by its dense key 0 .. n-1; n is the number of rows, counted from the files' footers."""
    if check:
        check_key(df, key)
    value = F.col(value) if isinstance(value, str) else value
    return from_relation(df.select(F.col(key).alias("i0"), value.alias("v")), (df.count(),), dtype)


def matrix(df: DataFrame, key: str, rows: str, width: int, dtype, check: bool = False) -> Array:
    """Row arrays of one length by a dense key."""
    if check:
        check_key(df, key)
        if df.filter(F.size(rows) != width).limit(1).count():
            raise ValueError(f"rows of {rows} that are not {width} long")
    cells = df.select(F.col(key).alias("i0"), F.posexplode(rows).alias("i1", "v"))
    return from_relation(cells, (df.count(), width), dtype)


def aggregated(df: DataFrame, coords: list[Column], value: Column, shape: tuple[int, ...], dtype) -> Array:
    """An aggregate by computed coordinates, with zeros where the table has nothing."""
    names = coord_names(len(shape))
    cells = df.groupBy(*[c.cast("bigint").alias(n) for c, n in zip(coords, names)]).agg(value.alias("v"))
    filled = grid(df.sparkSession, shape).join(cells, names, "left")
    v = F.coalesce(F.col("v").cast(spark_type(dtype)), literal(0, dtype))
    return Array(filled.select(*names, v.alias("v")), shape, dtype)


def sparse(df: DataFrame, row: str, column: str, value: Column, shape: tuple[int, int], dtype) -> CSRMatrix:
    cells = df.groupBy(F.col(row).alias("i0"), F.col(column).alias("i1")).agg(value.alias("v"))
    return CSRMatrix(cells, shape, dtype)


def write(a: Array, path: str, partition_by: str | None = None) -> None:
    """An array as parquet, a row a cell; slices of a partition coordinate then skip the other files."""
    out = a.relation().write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def load(spark: SparkSession, path: str, shape, dtype) -> Array:
    return from_relation(spark.read.parquet(path), shape, dtype)
