"""SimHash near-duplicate groups by deletion-variant signatures.

Fingerprints are 64 bits over word shingles.  Two that differ in at most three bits agree, in one of their two
32-bit segments, in all but at most one bit; so every segment is indexed under its 32 variants with one bit
wiped, equal variants are joined and the pairs verified on all 64 bits.

Buckets of a variant that hold more than `bucket` fingerprints are not paired up as they are.  A family of near
copies is first linked in work proportional to its members: everything at most one bit from a point is within two
bits of each other, so a star from one member to the others of the point loses no connection.  Where that leaves a
bucket in several groups, the bits that its variant does not fix are cut in the same way again, into halves of 16
and quarters of 8 bits: of at most three differing bits, one half and one quarter has at most one, and members that
agree in it up to a wiped bit are paired and verified.  A bucket of the last step leaves eleven bits open and so
holds 2048 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import cut, spread_join
from tessel.llm.components import connected

SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """The hash of each of a text's shingles, repeats included, as big-endian numbers.

    A-Z fold to a-z, words are runs of anything but ASCII white space; a text of fewer words than a shingle has
    one shingle of all its words, and one without words (or a null) has none.
    """
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, SEED) for g in grams]), ">u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it; without any the fingerprint is 0."""
    total, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, total, _CHUNK):
        part = hashes[k : k + _CHUNK].view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    udf = F.pandas_udf(kernel, T.LongType())
    return docs.select(F.col(id_col).alias("doc_id"), udf(F.col(text_col)).alias("fp"))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint; `key` packs the wiped bit's place and the segment without that bit."""
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        "fp",
        F.expr(
            "shiftleft(cast(p as bigint), 32) | ("
            "(CASE WHEN p < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
            " & ~shiftleft(1L, p % 32))"
        ).alias("key"),
    )


def _points(fps: DataFrame) -> DataFrame:
    """(fp, point): fp itself and the 64 points that differ from it in one bit."""
    flips = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("p"))
    return flips.select("fp", F.expr("CASE WHEN p < 0 THEN fp ELSE fp ^ shiftleft(1L, p) END").alias("point"))


def _stars(points: DataFrame) -> DataFrame:
    """An edge from each member of a point to the point's smallest member."""
    least = points.groupBy("point").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return points.join(least, "point").filter("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


#: True for a close pair in one only of the buckets that hold both, so that nothing is emitted twice: in the low
#: segment's if that segment is near enough, in the high one's else, and of 32 equal variants in the first.
_FIRST_MEETING = """
    src < dst AND bit_count(src ^ dst) <= 3
    AND (CASE WHEN shiftright(key, 32) < 32 THEN (src ^ dst) & 4294967295L <> 0L OR shiftright(key, 32) = 0
         ELSE bit_count((src ^ dst) & 4294967295L) > 1
              AND (shiftrightunsigned(src ^ dst, 32) <> 0L OR shiftright(key, 32) = 32) END)
"""


def _several(members: DataFrame, keys: list[str]) -> DataFrame:
    """The members of buckets that hold more than one component, and n, how many they hold."""
    of = members.groupBy(*keys).agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return members.join(of.filter("lo <> hi").select(*keys, "n"), keys)


def _apart(members: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs (src, dst) at most three bits apart of one bucket and different components."""
    a = members.select(*keys, F.col("fp").alias("src"), F.col("component").alias("a"))
    b = members.select(*keys, F.col("fp").alias("dst"), F.col("component").alias("b"))
    close = a.join(b, keys).filter("src < dst AND a <> b AND bit_count(src ^ dst) <= 3")
    return close.select("src", "dst")


def _narrowed(members: DataFrame, bucket: int) -> DataFrame:
    """The pairs of `_apart` in buckets of any size; `members` has key, fp and component."""
    keys = ["key", "half"]
    open_ = "CASE WHEN shiftright(key, 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    halves = members.select("key", "fp", "component", F.expr(open_).alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("q"))
    halves = halves.select(
        "key",
        F.expr("shiftleft(q, 16) | (cast(shiftright(rest, IF(q < 16, 0, 16)) & 65535L AS int) & ~shiftleft(1, q % 16))").alias("half"),
        "fp",
        "component",
        F.expr("cast(shiftright(rest, IF(q < 16, 16, 0)) & 65535L AS int)").alias("rest"),
    )
    halves = cut(_several(halves, keys), "simhash-halves")
    few = halves.filter(F.col("n") <= bucket)
    quarters = halves.filter(F.col("n") > bucket).drop("n").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(15))))
    quarter = "shiftleft(q, 8) | (shiftright(rest, IF(q < 8, 0, 8)) & 255 & ~shiftleft(1, q % 8))"
    quarters = _several(quarters.withColumn("quarter", F.expr(quarter)), [*keys, "quarter"])
    return _apart(few, keys).unionByName(_apart(quarters, [*keys, "quarter"])).distinct()


def links(fps: DataFrame, bucket: int = 128) -> DataFrame:
    """Edges (src, dst) over distinct fingerprints whose components are those of "at most 3 bits differ".

    `fps` has one column fp of distinct values.
    """
    # Spread before they become 64 rows each: by their size alone they would come to a few tasks.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = _variants(fps)
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(spread_join(variants, sizes.withColumn("m", F.col("n")), "key", "m"), "simhash-buckets")
    small = shared.filter(F.col("n") <= bucket)
    a = small.select("key", F.col("fp").alias("src"))
    b = small.select(F.col("key").alias("other"), F.col("fp").alias("dst"))
    pairs = a.join(b, (F.col("key") == F.col("other")) & F.expr(_FIRST_MEETING)).select("src", "dst")
    large = shared.filter(F.col("n") > bucket)
    hot = large.select("fp").distinct()
    near = cut(_stars(_points(hot)), "simhash-near")
    # A link of three bits matters only between components that the shorter ones leave apart.
    groups = cut(connected(hot, near), "simhash-hot")
    placed = cut(large.join(groups, "fp").select("key", "fp", "component"), "simhash-large")
    far = cut(_narrowed(_several(placed, ["key"]).drop("n"), bucket), "simhash-far")
    return pairs.unionByName(near).unionByName(far)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, bucket: int = 128, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the group) for each row.

    Null and empty texts have fingerprint zero and link like any other; very long texts count whole; a bit that
    exactly half of the shingles have is not set.  Rows with one doc_id are one document in the groups and keep a
    result row each; rows with a null doc_id get the group's smallest id that is not null.  An empty table gives an
    empty result.  Other columns of `docs` are not read.
    """
    prints = cut(with_fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-firsts")
    groups = connected(firsts.select("fp"), links(firsts.select("fp"), bucket))
    # One document may hold several rows and so several fingerprints; the id is the smallest of the group's.
    joined = cut(groups.join(firsts, "fp"), "simhash-groups")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    found = joined.join(least, "component").select("fp", "component_id", "n")
    return spread_join(prints, found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
