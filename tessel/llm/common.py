"""Helpers that the corpus operators share: reading tables, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI under `spark.checkpoint.dir`, which driver and executors share.

    Only where the session names no such folder and runs on one machine (tests) a temporary one takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster's session has to name a shared folder in spark.checkpoint.dir")
        top = _own_dir()
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Writes `df` to a table in the shared folder and reads it back: the lineage ends there.

    A lost executor then costs a re-read, not the stages before.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_remembered: list[dict] = []


def remembered(found: dict) -> dict:
    """A dict that an operator keeps in a worker from task to task, until `forget`."""
    _remembered.append(found)
    return found


def forget() -> None:
    """Gives back the memory of what other operators' tasks have left in this worker."""
    if any(_remembered):
        for found in _remembered:
            found.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


#: Rows of one key that a task may well read; a key with more is dealt over several tasks.
HOT_ROWS = 200_000


def spread_join(
    big: DataFrame, small: DataFrame, key: str | list[str], n: str = "n", how: str = "inner", hot: int | None = None
) -> DataFrame:
    """big joined with small on `key`, where keys that hold many rows of `big` are dealt over several tasks.

    `small` has distinct keys, and in `n` (which goes) how many rows of `big` have each.  Keys of over `hot` rows are
    few, rows of `big` by `hot` at most; they are broadcast, which the caller's bound on rows proves small, and each
    has as many copies in `small` as tasks.  `big` is read from a table, so that a task run anew deals as before.
    """
    hot, keys = hot or HOT_ROWS, [key] if isinstance(key, str) else key
    parts = small.filter(F.col(n) > hot).select(
        *[F.col(k).alias(f"hot_{k}") for k in keys], F.ceil(F.col(n) / hot).cast("int").alias("salts")
    )
    dealt = big.join(F.broadcast(parts), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    dealt = dealt.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int"))
    last = F.greatest(F.ceil(F.col(n) / hot) - 1, F.lit(0)).cast("int")
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop(n)
    return dealt.drop("salts", *[f"hot_{k}" for k in keys]).join(copies, [*keys, "salt"], how).drop("salt")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
