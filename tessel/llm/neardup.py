"""Groups of texts whose sets of five-word shingles are similar, for the pipeline.

Candidates are the SimHash links of `simhash.py`, over these shingles, and texts that agree in a band of minimum
hashes: 20 bands of 5 find a pair of similarity 0.8 with a chance of 0.9996, and closer ones with a higher one.
Every candidate is verified on the sets of shingle hashes, so that no pair under the similarity is a link.

Members of a band are compared with its member of the fewest shingles: where members share a core and differ in
what stands around it, no other one is as similar to all of them.  Of bands that this leaves in several groups, those
of up to `bucket` members are compared pair by pair, and larger ones are joined by prefixes: with shingles in the
order of how many of these texts hold them, two sets of that similarity share one of the rarest fifth of either.  So
passages that many texts quote make no pairs, and a family of near copies takes work in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm import simhash
from tessel.llm.common import cut, forget, spread_join
from tessel.llm.components import connected

BANDS, ROWS = 20, 5
_CHUNK = 1 << 12
_RANDOM = np.random.default_rng(simhash.SEED)
_TIMES = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words and short texts are as in `simhash`."""
    return np.unique(simhash.shingle_hashes(text, shingle).astype("<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        # The product's upper half decides, in which all bits of the hash count.
        mixed = (hashes[k : k + _CHUNK, None] ^ (hashes[k : k + _CHUNK, None] >> np.uint64(32))) * _TIMES + _PLUS
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(rows)]


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            fps, sizes, found = [], [], []
            for text in batch["text"]:
                hashes = simhash.shingle_hashes(text, shingle)
                own = np.unique(hashes.astype("<u8"))
                fps.append(simhash.fingerprint_of(hashes))
                sizes.append(len(own))
                found.append(bands(own))
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "fp": signed, "size": sizes, "bands": found})

    return texts.mapInPandas(kernel, "doc_id long, key long, fp long, size int, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "held": [shingle_set(t, shingle).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(kernel, "key long, held binary")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst) whose sets have a Jaccard similarity of `least` or more."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            kept = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch["a"], batch["b"])):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(a), len(b)) >= least * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    kept[k] = both >= least * (len(a) + len(b) - both)
            yield batch.loc[kept, ["src", "dst"]]

    found = pairs.join(sets.select(F.col("key").alias("src"), F.col("held").alias("a")), "src")
    found = found.join(sets.select(F.col("key").alias("dst"), F.col("held").alias("b")), "dst")
    return cut(found.select("src", "dst", "a", "b").mapInPandas(kernel, "src long, dst long"), "similar-pairs")


def _rarest(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(shingle, key) for the prefix of each member's set: its rarest shingles, of which similar sets share one."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            for key, held in zip(batch["key"], batch["held"]):
                own = np.frombuffer(held, "<i8")
                for k in range(0, len(own), 100_000):
                    yield pd.DataFrame({"key": key, "size": len(own), "shingle": own[k : k + 100_000]})

    each = cut(sets.join(members, "key").select("key", "held").mapInPandas(kernel, "key long, size int, shingle long"), "prefixes")
    held = each.groupBy("shingle").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "shingle"))
    prefix = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    ranked = spread_join(each, held.withColumn("m", F.col("n")), "shingle", "m").withColumn("place", place)
    return ranked.filter((F.col("place") <= prefix) & (F.col("n") > 1)).select("shingle", "key", "size")


def _met(members: DataFrame, at: str) -> DataFrame:
    """The pairs of members at one place, with their components and, if they are known, sizes."""
    sized = "size" in members.columns
    a, b = (
        members.select(at, F.col("component").alias(f"c{x}"), F.col("key").alias(x), *([F.col("size").alias(y)] if sized else []))
        for x, y in (("a", "x"), ("b", "y"))
    )
    return a.join(b, at).drop(at)


def groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, bucket: int = 64) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the group) for each row of `docs` (doc_id, text).

    Groups are connected by pairs of texts of similarity `least`.  Texts without words are equal to each other.
    Rows with one doc_id keep a result row each.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    sketches = cut(_sketches(texts, shingle), "sketches")
    of_text = [F.first(c).alias(c) for c in ("fp", "size", "bands")]
    firsts = sketches.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), *of_text)
    firsts = cut(firsts, "texts")
    # Fingerprints' links, as pairs of the least texts that have them; texts with one fingerprint are a star.
    heads = cut(firsts.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "heads")
    near = simhash.links(heads.select("fp"))
    near = near.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src")
    near = near.join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    equal = spread_join(firsts.select("fp", "key"), heads, "fp").select(F.col("key").alias("a"), F.col("head").alias("b"))
    members = cut(firsts.select("key", "size", F.explode("bands").alias("band")), "bands")
    centre = F.min(F.struct("size", "key"))["key"].alias("b")
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), centre).filter("n > 1")
    shared = cut(spread_join(members, sizes, "band").drop("size"), "bands")

    def pairs(found: DataFrame) -> DataFrame:
        return found.filter("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()

    stars = pairs(near.select("a", "b").unionByName(equal).unionByName(shared.select(F.col("key").alias("a"), "b")))
    stars = cut(stars, "candidates")
    taken = shared.select("key").unionByName(stars.select(F.col("src").alias("key"))).unionByName(
        stars.select(F.col("dst").alias("key"))
    )
    # Equal texts are one text, of which a task hands on one.
    held = texts.select("key", "text").join(taken.distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = cut(_sets(held, shingle), "shingles")
    linked = _similar(stars, sets, least)
    first = cut(connected(firsts.select("key"), linked), "first-groups")

    placed = shared.select("band", "key").join(first, "key")
    apart = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = cut(placed.join(apart.filter("lo <> hi").select("band", "n"), "band"), "apart")
    few = open_.filter(F.col("n") <= bucket)
    many = open_.filter(F.col("n") > bucket).select("key", "component").distinct()
    rare = cut(_rarest(many.select("key"), sets, least).join(many, "key"), "prefixes")
    close = (F.col("ca") < F.col("cb")) & (F.least("x", "y") >= least * F.greatest("x", "y"))
    rest = cut(pairs(_met(few, "band").filter("ca < cb").unionByName(_met(rare, "shingle").filter(close).drop("x", "y"))), "candidates")
    final = connected(firsts.select("key"), linked.unionByName(_similar(rest, sets, least)))
    joined = cut(final.join(firsts.select("key", "first", "rows"), "key"), "text-groups")
    ids = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    found = joined.join(ids, "component").select("key", "component_id", F.col("rows").alias("n"))
    return spread_join(sketches.select("doc_id", "key"), found, "key").select("doc_id", "component_id")
