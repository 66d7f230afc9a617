"""Arrays over streams: a program for every micro-batch, and reductions that are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.functions.dtypes import spark_type
from tessel.operators.array import Array
from tessel.plans.program import Program


def run_on_batches(
    stream: DataFrame,
    program: Program,
    to_array: Callable[[DataFrame], Array],
    name: str,
    sink: Callable[[dict[str, DataFrame], int], None],
    checkpoint: str,
    **fixed,
) -> StreamingQuery:
    """The program on each micro-batch, bound to input `name`; `sink` gets its outputs and the batch's number,
    and has to take a batch that comes again after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            sink(program(**{name: to_array(held)}, **fixed), number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(result: DataFrame, path: str) -> DataFrame:
    """Everything that a stream gives for the input there is now, written to a table under `path` and read back."""
    out = result.writeStream.format("parquet").outputMode("append").option("path", f"{path}/cells")
    out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/cells")


def windowed_sums(
    stream: DataFrame, time: str, late: str, window: str, coords: dict[str, Column], value: Column, dtype, start: str | None = None
) -> DataFrame:
    """Sums by tumbling event-time window and coordinates: a window's cells come out once, when the watermark
    has passed it; rows later than `late` are left out.  `start` shifts all windows."""
    keys = [F.window(time, window, window, start).alias("w"), *[c.cast("bigint").alias(n) for n, c in coords.items()]]
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    sums = timed.withWatermark(time, late).groupBy(*keys).agg(F.sum(value).cast(spark_type(dtype)).alias("v"))
    return sums.select(F.col("w.start").alias("start"), *coords, "v")
