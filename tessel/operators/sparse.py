"""Sparse matrices in compressed rows, and their products with dense arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import scalar
from tessel.functions.dtypes import literal, normal, result_type, spark_type
from tessel.operators.array import Array, _converted, is_scalar
from tessel.operators.shapes import grid, normal_shape


class CSRMatrix:
    """A relation (i0, i1, v) with some of the cells; those without a row are zero."""

    def __init__(self, df: DataFrame, shape, dtype):
        self.shape, self.dtype = normal_shape(shape), normal(dtype)
        if len(self.shape) != 2:
            raise ValueError("a sparse matrix has two axes")
        cells = [F.col(c).cast("bigint").alias(c) for c in ("i0", "i1")]
        self.df = df.select(*cells, F.col("v").cast(spark_type(dtype)).alias("v"))

    def __matmul__(self, x: Array) -> Array:
        return sparse_matmul(self, x)

    def dense(self) -> Array:
        return _on_grid(self.df, self.shape, self.dtype)


def make_csr_matrix(shape, elem_values: Array, elem_col_indices: Array, row_starts: Array) -> CSRMatrix:
    """From its three flat arrays.  Each entry's row is found by the row starts before it."""
    shape = normal_shape(shape)
    if len(shape) != 2:
        raise ValueError("a sparse matrix has two axes")
    if any(a.ndim != 1 for a in (elem_values, elem_col_indices, row_starts)):
        raise ValueError("values, columns and row starts have one axis")
    if elem_values.shape != elem_col_indices.shape:
        raise ValueError("as many values as columns")
    if row_starts.shape != (shape[0] + 1,):
        raise ValueError("row starts: one a row and one more")
    start = row_starts.relation().select(F.col("i0").alias("row"), F.col("v").cast("bigint").alias("start"))
    stop = start.select((F.col("row") - 1).alias("row"), F.col("start").alias("stop"))
    # Rows name the entries that they hold, and each entry is fetched by its place: an equality join.
    entries = start.join(stop, "row").filter("start < stop").select(
        F.col("row").alias("i0"), F.explode(F.expr("sequence(start, stop - 1)")).alias("at")
    )
    values = elem_values.relation().select(F.col("i0").alias("at"), "v")
    columns = elem_col_indices.relation().select(F.col("i0").alias("at"), F.col("v").alias("i1"))
    return CSRMatrix(entries.join(values.join(columns, "at"), "at").select("i0", "i1", "v"), shape, elem_values.dtype)


def from_coordinates(df: DataFrame, shape, dtype) -> CSRMatrix:
    """From a relation (i0, i1, v) with distinct coordinates."""
    return CSRMatrix(df, shape, dtype)


def to_csr(a: CSRMatrix) -> tuple[DataFrame, DataFrame]:
    """(at, i1, v) and (row, start): entries in row order, counted row by row and never in one task.  Both are kept
    once computed, as the three arrays of the format read them several times."""
    counts = grid(a.df.sparkSession, (a.shape[0],)).join(a.df.groupBy("i0").agg(F.count("*").alias("n")), "i0", "left")
    counts = counts.select("i0", F.coalesce("n", F.lit(0)).alias("n"))
    starts = _prefix_sums(counts, a.shape[0]).select(F.col("i0").alias("row"), "start").persist()
    rank = F.row_number().over(Window.partitionBy("i0").orderBy("i1")) - 1
    entries = a.df.withColumn("k", rank).join(starts, F.col("i0") == F.col("row"))
    return entries.select((F.col("start") + F.col("k")).alias("at"), "i1", "v").persist(), starts


#: Rows whose counts one task adds up in order.
_RUN = 4096


def _prefix_sums(counts: DataFrame, length: int) -> DataFrame:
    """(i0, start) of (i0, n) over 0 .. length - 1: within runs of `_RUN` rows, over their sums, and so on."""
    if length <= _RUN:
        ahead = Window.orderBy("i0").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("i0", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    counts = counts.withColumn("run", F.call_function("div", F.col("i0"), F.lit(_RUN).cast("bigint")))
    runs = counts.groupBy(F.col("run").alias("i0")).agg(F.sum("n").alias("n"))
    bases = _prefix_sums(runs, -(-length // _RUN)).select(F.col("i0").alias("run"), F.col("start").alias("base"))
    within = Window.partitionBy("run").orderBy("i0").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return own.join(bases, "run").select("i0", (F.col("base") + F.col("own")).alias("start"))


def _on_grid(df: DataFrame, shape, dtype) -> Array:
    """All cells of a box: those without a row are zero."""
    names = [f"i{k}" for k in range(len(shape))]
    box = grid(df.sparkSession, shape)
    filled = box.join(df, names, "left") if names else box.crossJoin(df)
    return Array(filled.select(*names, F.coalesce("v", literal(0, dtype)).alias("v")), shape, dtype)


def sparse_matmul(a: CSRMatrix, x: Array) -> Array:
    """Rows join the dense array on the inner coordinate; rows of the matrix without entries give zeros."""
    if is_scalar(x) or not x.ndim:
        raise ValueError("a sparse product takes no scalars")
    if a.shape[1] != x.shape[0]:
        raise ValueError(f"shapes {a.shape} and {x.shape} don't go together")
    dtype = result_type(a.dtype, x.dtype)
    x = _converted(x, dtype)
    left = a.df.select(F.col("i0").alias("row"), F.col("i1").alias("inner"), F.col("v").cast(spark_type(dtype)).alias("p"))
    rest = list(range(1, x.ndim))
    right = x.df.select(F.col("i0").alias("at"), *[F.col(f"i{k}").alias(f"x{k}") for k in rest], x.value.alias("q"))
    if x.small():
        right = F.broadcast(right)
    both = left.join(right, F.col("inner") == F.col("at"))
    total = F.sum(scalar.multiply(F.col("p"), F.col("q"), dtype.kind)).cast(spark_type(dtype))
    groups = [F.col("row").alias("i0"), *[F.col(f"x{k}").alias(f"i{k}") for k in rest]]
    return _on_grid(both.groupBy(*groups).agg(total.alias("v")), (a.shape[0], *x.shape[1:]), dtype)
