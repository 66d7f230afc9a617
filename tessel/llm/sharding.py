"""Shards by fixed virtual slots: records hash into thousands of slots, and a versioned map sends slots to shards.

The number of slots never changes, so a record's slot never does.  The map is small (a row for each slot) and
is edited, not recomputed: a rebalance moves only as many slots as even out the bytes, and every version is
kept with the edits that led to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class SlotMap:
    """Slot -> shard.  `edits` are the (version, slot, from, to) that made this version from the first."""

    shards: int
    owner: list[int]
    version: int = 0
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def first(cls, slots: int, shards: int) -> SlotMap:
        """Version 0: equal ranges of slots."""
        return cls(shards, [s * shards // slots for s in range(slots)])

    def rebalanced(self, weight: dict[int, int]) -> SlotMap:
        """The next version: slots move (or trade places) between the fullest and the emptiest shard, each time
        by what comes nearest to half their difference, until no such step brings them closer."""
        owner, edits, version = list(self.owner), list(self.edits), self.version + 1
        load, held = [0] * self.shards, [set() for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            if w := weight.get(slot, 0):
                load[shard] += w
                held[shard].add(slot)

        def move(slot: int, to: int) -> None:
            at, w = owner[slot], weight[slot]
            held[at].discard(slot)
            held[to].add(slot)
            load[at] -= w
            load[to] += w
            owner[slot] = to
            edits.append((version, slot, at, to))

        while True:
            high, low = (f(range(self.shards), key=lambda s: (load[s], s)) for f in (max, min))
            gap = load[high] - load[low]
            steps = [(abs(gap - 2 * weight[a]), a, -1) for a in held[high] if weight[a] < gap]
            if not steps:
                steps = [
                    (abs(gap - 2 * (weight[a] - weight[b])), a, b)
                    for a in held[high]
                    for b in held[low]
                    if 0 < weight[a] - weight[b] < gap
                ]
            if not steps:
                return SlotMap(self.shards, owner, version, edits)
            _, a, b = min(steps)
            move(a, low)
            if b >= 0:
                move(b, high)

    def grown(self, weight: dict[int, int]) -> SlotMap:
        """The next version, with one more shard: it takes slots from the fullest of the others, the largest that it
        has room for, up to an even share.  No slot moves between the others."""
        owner, edits, version = list(self.owner), list(self.edits), self.version + 1
        load, held = [0] * self.shards, [set() for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            load[shard] += weight.get(slot, 0)
            held[shard].add(slot)
        room = sum(load) // (self.shards + 1)
        while True:
            for shard in sorted(range(self.shards), key=lambda s: (-load[s], s)):
                fits = [s for s in held[shard] if 0 < weight.get(s, 0) <= room]
                if fits:
                    break
            else:
                return SlotMap(self.shards + 1, owner, version, edits)
            slot = max(fits, key=lambda s: (weight[s], -s))
            held[shard].discard(slot)
            load[shard] -= weight[slot]
            room -= weight[slot]
            owner[slot] = self.shards
            edits.append((version, slot, shard, self.shards))

    def rows(self) -> list[tuple[int, int, int]]:
        return [(self.version, slot, shard) for slot, shard in enumerate(self.owner)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Puts this version into the store: its map and the edits that led to it.  Saved again it replaces itself."""
        rows = [r[1:] for r in self.rows()]
        spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/map/version={self.version}"
        )
        new = [e[1:] for e in self.edits if e[0] == self.version]
        spark.createDataFrame(new, "slot int, from_shard int, to_shard int").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/edits/version={self.version}"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, shards: int, version: int) -> SlotMap:
        """A stored version; it has a row a slot, whatever the corpus."""
        kept = spark.read.parquet(f"{path}/map/version={version}").orderBy("slot").collect()
        edits = spark.read.schema("slot int, from_shard int, to_shard int, version int").parquet(f"{path}/edits")
        edits = edits.filter(F.col("version") <= version).select("version", "slot", "from_shard", "to_shard").collect()
        return cls(shards, [r.shard for r in kept], version, sorted(map(tuple, edits)))


def sized(docs: DataFrame, slots: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row.

    The slot hashes the id and the text's checksum, so that rows that share an id (or have none) still spread.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_weights(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Slot -> (bytes, rows): as many entries as slots at most, whatever the corpus."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in found}


def assign(rows: DataFrame, slot_map: SlotMap, count: dict[int, int]) -> DataFrame:
    """Adds shard, slot (the row's place in its shard, from 0 without gaps) and map_version to `sized` rows.

    A place is the rows of the shard's earlier virtual slots plus the rank within the row's own; ranks are
    counted slot by slot, never over a whole shard at once.
    """
    spark, before, table = rows.sparkSession, [0] * slot_map.shards, []
    for version, slot, shard in slot_map.rows():
        table.append((slot, shard, before[shard], version))
        before[shard] += count.get(slot, 0)
    lookup = spark.createDataFrame(table, "virtual_slot int, shard int, ahead long, map_version int")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(lookup), "virtual_slot")  # a row for each slot: bounded by the parameter
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("ahead") + F.col("place") - 1).alias("slot"),
            "virtual_slot",
            "map_version",
        )
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    slots: int = 4096,
    store: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot, map_version for each row; sizes are near equal.

    A size is the text's UTF-8 bytes plus 1.  The map starts with equal ranges of slots and is rebalanced once by
    the bytes of each slot; with `store`, both versions and the edits are written there.  Null texts count as
    empty and null ids hash like a value; repeated rows land in one slot and get a place each.  A record larger
    than an even share, as a very long text may be, stays whole.  Of slots that even out bytes equally well the first
    moves.  An empty table gives an empty result; other columns are not read.
    """
    rows = sized(docs, slots, id_col, text_col)
    weights = slot_weights(rows)
    first = SlotMap.first(slots, shards)
    final = first.rebalanced({s: b for s, (b, _) in weights.items()})
    if store:
        first.save(docs.sparkSession, store)
        final.save(docs.sparkSession, store)
    return assign(rows, final, {s: n for s, (_, n) in weights.items()})


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents in folders shard=N, each once; `placed` is the assignment of their rows.

    Rows are found by id and text, with null ids and repeated rows too: where rows are alike, so are their shards.
    """
    where = placed.select(F.col("doc_id").alias("at_id"), F.col("text_crc32").alias("at_crc"), "shard", "virtual_slot").distinct()
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    joined = docs.join(where, F.col(id_col).eqNullSafe(F.col("at_id")) & (crc == F.col("at_crc")))
    joined.drop("at_id", "at_crc").repartition("virtual_slot").drop("virtual_slot").write.partitionBy("shard").parquet(path)
