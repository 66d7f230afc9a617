"""A modified Kneser-Ney model of word pairs, counted by Spark and kept in sorted hash arrays.

A word is a 32-bit hash, a pair a 64-bit key (the later word above the earlier one), and 0 stands before a text's
first word.  Tasks combine the pairs of their texts before the one large shuffle, in which keys travel as packed
differences of a sorted list.  Pairs of one language are dealt over a grid by both of their words, so that a
word as common as "the" never comes to one task; each square of the grid merges its counts and writes the pairs
that the model keeps, as sorted arrays of its own.  A word's unigram and continuation counts are merged likewise.

A text is scored without what it and its exact copies added to the counts.  With `few` 0 the model is whole: every
pair counts, with the discount of its count.  A pair seen once has no row of its own, for the only text that has it
is scored without it; it is in the sums of its words.  So the model is one for scoring the texts that it counted.

With a larger `few` pairs seen `few` + 1 times or less are pruned, and one seen `few` times or less elsewhere says
nothing, so that a few near copies do not predict themselves.  Their share goes to the lower order, which counts in
how many distinct contexts a word was seen.  Below that all words of the language and one more are equal.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut
from tessel.llm.tokenfiles import open_array

FEW = 3
#: Words of the corpus for each square of the grid, and what a task holds before it counts and hands over.
PART_WORDS, _PENDING, _HELD = 4_000_000, 1 << 19, 4_000_000
_KNOWN = 300_000
_MASK = np.uint64(0xFFFFFFFF)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh32_intdigest(word)
        return found


class Hashes:
    """Remembered hashes of words."""

    def __init__(self):
        self.known = _Known()

    def pairs(self, words: list[bytes]) -> np.ndarray:
        """The key of each word with the word before it."""
        known = self.known
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out = ids << np.uint64(32)
        out[1:] |= ids[:-1]
        if len(known) > _KNOWN:
            known.clear()
        return out


def _new(key: np.ndarray) -> np.ndarray:
    """Which of sorted keys differ from the one before."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return new


def pack(key: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted distinct keys, with counts: the distinct upper and lower halves and the keys' places in the table of
    both as differences, the bytes of one weight together, compressed."""
    upper = key >> np.uint64(32)
    new = _new(upper)
    lower, low = np.unique((key & _MASK).astype("<u4"), return_inverse=True)
    place = (np.cumsum(new) - 1).astype("<u8") * np.uint64(len(lower)) + low.astype("<u8")
    lists = [upper[new].astype("<u4"), lower, place]
    planes = [np.array([len(x) for x in lists], "<u8").view("u1")]
    planes += [np.diff(x, prepend=x.dtype.type(0)).view("u1").reshape(-1, x.itemsize).T for x in lists]
    planes += [n.astype("<u4").view("u1").reshape(-1, 4).T for n in counts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(data: bytes, counts: int) -> list[np.ndarray]:
    raw, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1"), 24
    sizes = raw[:at].view("<u8").tolist()

    def values(n: int, kind: str) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        at += n * width
        return np.ascontiguousarray(raw[at - n * width : at].reshape(width, n).T).view(kind).ravel()

    upper, lower, place = (np.cumsum(values(n, k), dtype=np.uint64) for n, k in zip(sizes, ("<u4", "<u4", "<u8")))
    high, low = np.divmod(place, np.uint64(max(1, len(lower))))
    key = (upper[high] << np.uint64(32)) | lower[low]
    return [key, *[values(sizes[2], "<u4").astype(np.int64) for _ in range(counts)]]


def summed(key: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and their counts added up."""
    return _added(key, np.argsort(key), *counts)


def _added(key: np.ndarray, order: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    key = key[order]
    first = np.flatnonzero(_new(key))
    return [key[first], *[np.add.reduceat(n[order].astype(np.int64, copy=False), first) for n in counts]]


def _merged(blobs: list[bytes], counts: int) -> list[np.ndarray]:
    found = [unpack(b, counts) for b in blobs]
    return summed(*map(np.concatenate, zip(*found)))


def _squares(key: np.ndarray, side: int) -> np.ndarray:
    n = np.uint64(side)
    return ((key >> np.uint64(32)) % n * n + (key & _MASK) % n).astype(np.int64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places that it has, in order."""
    if len(part):
        order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True])
        for a, b in zip(cuts, cuts[1:]):
            yield int(part[order[a]]), order[a:b]


def _dealt(lang: str, kind: str, part: np.ndarray, key: np.ndarray, *counts: np.ndarray) -> Iterator[tuple]:
    """A row for each part: its keys stay in order."""
    for p, own in _by_part(part):
        yield lang, kind, p, pack(key[own], *[n[own] for n in counts])


_ROWS = "lang string, kind string, part int, data binary"
_COLUMNS = ["lang", "kind", "part", "data"]


def _counted(rows: DataFrame, side: int) -> DataFrame:
    """(lang, kind, part, data): each task's pairs by square (kind `pair`) and words (kind `word`) with their counts."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, pending = Hashes(), defaultdict(list)
        held: dict[str, list[np.ndarray]] = {}

        def fold() -> None:
            for lang, parts in pending.items():
                key = np.sort(np.concatenate(parts))
                first = np.flatnonzero(_new(key))
                found = [key[first], np.diff(first, append=len(key))]
                if lang in held:
                    key, n = map(np.concatenate, zip(held[lang], found))
                    found = _added(key, np.argsort(key, kind="stable"), n)  # two runs are merged
                held[lang] = found
            pending.clear()

        def hand_over() -> Iterator[pd.DataFrame]:
            for lang, (key, n) in held.items():
                word, total = summed(key >> np.uint64(32), n)
                for row in _dealt(lang, "pair", _squares(key, side), key, n):
                    yield pd.DataFrame([row], columns=_COLUMNS)
                out = list(_dealt(lang, "word", (word % np.uint64(side)).astype(np.int64), word, total))
                yield pd.DataFrame(out, columns=_COLUMNS)
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if words := text.encode().split():
                    pending[lang].append(hashes.pairs(words))
                    size += len(words)
                if size > _PENDING:
                    fold()
                    size = 0
                    if sum(len(k) for k, _ in held.values()) > _HELD:
                        yield from hand_over()
        fold()
        yield from hand_over()

    return rows.mapInPandas(kernel, _ROWS)


class _Files:
    """Flat arrays of one part, under a stem that no other attempt has."""

    def __init__(self, path: str):
        self.fs, self.top = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.top, recursive=True)
        self.stem = f"part-{uuid.uuid4().hex}"

    def write(self, **arrays: np.ndarray) -> str:
        for name, values in arrays.items():
            with self.fs.open_output_stream(f"{self.top}/{self.stem}.{name}") as f:
                f.write(values.astype("<u8" if name == "key" else "<f4").tobytes())
        return self.stem


_COUNTS = [f"c{k}" for k in (1, 2, 3, 4)]
_PART = f"{_ROWS}, stem string, {', '.join(f'{c} long' for c in _COUNTS)}, total long"
_PART_NAMES = [*_COLUMNS, "stem", *_COUNTS, "total"]


def _of_counts(n: np.ndarray) -> tuple[int, int, int, int]:
    return tuple(int((n == k).sum()) for k in (1, 2, 3, 4))


def _squared(counted: DataFrame, path: str, side: int, few: int) -> DataFrame:
    """Merges each square of pairs: its pairs seen over `few` + 1 times go to files, its counts of counts and its
    words' continuation counts (kind `tail`) and pairs that the model has (kind `head`: those seen once, twice and
    more often, and their sum) go on; the tasks' words are merged.  With `few` 0 the model has all pairs."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lang, kind, part = key
        word, n = _merged(group["data"].tolist(), 1)
        if kind == "word":
            return pd.DataFrame([(lang, kind, part, pack(word, n), None, 0, 0, 0, 0, 0)], columns=_PART_NAMES)
        stored = n > few + 1
        kept = stored if few else np.ones(len(n), bool)
        stem = _Files(path).write(key=word[stored], n=n[stored]) if stored.any() else None
        rows = [(lang, "pair", part, None, stem, *_of_counts(n), int(n.sum()))]
        tail, before = summed(word >> np.uint64(32), np.ones(len(word), np.int64))
        own = n[kept]
        head, *sums = summed(word[kept] & _MASK, own == 1, own == 2, own > 2, own)
        for name, ids, counts in (("tail", tail, (before,)), ("head", head, sums)):
            for row in _dealt(lang, name, (ids % np.uint64(side)).astype(np.int64), ids, *counts):
                rows.append((*row, None, 0, 0, 0, 0, 0))
        return pd.DataFrame(rows, columns=_PART_NAMES)

    return counted.groupBy("lang", "kind", "part").applyInPandas(merge, _PART)


#: A word's pairs as the earlier word: how many were seen once, twice and more often, and the sum of their counts.
_HEADS = ["ones", "twos", "many", "kept"]


def _words(merged: DataFrame, path: str) -> DataFrame:
    """Each part of a language's words as files: total, before and the columns of `_HEADS`; words seen once only
    count, for the only text that has one is scored without it.

    Gives lang, part, stem, the counts of counts of `before`, its total, and the number of words.
    """

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lang, part = key
        kinds = {k: rows["data"].tolist() for k, rows in group.groupby("kind")}
        word, total = _merged(kinds["word"], 1)
        out = {}
        for kind, names in (("tail", ["before"]), ("head", _HEADS)):
            for name in names:
                out[name] = np.zeros(len(word), np.int64)
            if kind in kinds:
                ids, *counts = _merged(kinds[kind], len(names))
                # The start of texts is a head and no word.
                at = np.minimum(np.searchsorted(word, ids), len(word) - 1)
                there = word[at] == ids
                for name, n in zip(names, counts):
                    out[name][at[there]] = n[there]
        seen = total > 1
        stem = _Files(path).write(key=word[seen], total=total[seen], **{k: v[seen] for k, v in out.items()}) if seen.any() else None
        return pd.DataFrame(
            [(lang, "word", part, None, stem, *_of_counts(out["before"]), int(out["before"].sum()), len(word))],
            columns=[*_PART_NAMES, "words"],
        )

    return merged.filter("kind <> 'pair'").groupBy("lang", "part").applyInPandas(merge, f"{_PART}, words long")


def discounts(c: list[int]) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; where those are too few or odd to say anything, plain ones."""
    y = c[0] / (c[0] + 2 * c[1]) if c[0] + c[1] else 0.5
    found = [j - (j + 1) * y * c[j] / c[j - 1] if c[j - 1] else -1 for j in (1, 2, 3)]
    return [d if 0.01 <= d <= j else 0.5 * j for j, d in zip((1, 2, 3), found)]


def costs(n: np.ndarray, d: list[float]) -> np.ndarray:
    """What the discounts take off counts; never more than the count."""
    return np.minimum(np.array([0.0, *d])[np.clip(n, 0, 3).astype(np.int64)], n)


def store(rows: DataFrame, path: str) -> list[tuple[int, str]]:
    """Writes key (a long) and n (a count) as flat arrays sorted by key, a task for each range of keys.

    Gives the manifest: each part's first key and the stem of its files, in order.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, fs, top = None, *pafs.FileSystem.from_uri(path)
        stem, files = f"part-{uuid.uuid4().hex}", []
        for batch in batches:
            if first is None and len(batch):
                first = int(batch["key"].iloc[0])
                fs.create_dir(top, recursive=True)
                files = [fs.open_output_stream(f"{top}/{stem}.{c}") for c in ("key", "n")]
            for f, values in zip(files, (batch["key"].to_numpy("<i8"), batch["n"].to_numpy("<f4"))):
                f.write(values.tobytes())
        for f in files:
            f.close()
        if first is not None:
            yield pd.DataFrame({"first": [first], "stem": [stem]})

    parts = rows.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(kernel, "first long, stem string")
    return sorted((r.first, f"{path}/{r.stem}") for r in cut(parts, "manifest").toPandas().itertuples(index=False))


def build(rows: DataFrame, path: str, few: int = FEW, part_words: int = PART_WORDS) -> dict:
    """Counts the texts of `rows` (lang, text) and stores the model under `path`; gives its manifest.

    The driver gets a row for each part and language.
    """
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = max(1, round((words / 6 / part_words) ** 0.5))
    merged = cut(_squared(_counted(rows, side), f"{path}/pairs", side, few), "word-counts")
    by_word = cut(_words(merged, f"{path}/words"), "word-parts")
    model: dict = {"side": side, "few": few, "langs": {}, "pairs": {}, "words": {}}
    sums = [F.sum(c).alias(c) for c in [*_COUNTS, "total"]]
    pairs = {r.lang: r for r in merged.filter("kind = 'pair'").groupBy("lang").agg(*sums).collect()}
    for r in by_word.groupBy("lang").agg(*sums, F.sum("words").alias("words")).collect():
        d1, d2 = discounts([r[c] for c in _COUNTS]), discounts([pairs[r.lang][c] for c in _COUNTS])
        rest = r.words - r.c1 - r.c2
        left = (d1[0] * r.c1 + d1[1] * r.c2 + d1[2] * rest) / r.total
        model["langs"][r.lang] = {"d1": d1, "d2": d2, "contexts": r.total, "left": left, "words": r.words}
    for name, parts in (("pairs", merged), ("words", by_word)):
        for r in parts.filter("stem IS NOT NULL").select("lang", "part", "stem").collect():
            model[name].setdefault(r.lang, {})[r.part] = f"{path}/{name}/{r.stem}"
    return model


class _Part:
    """Sorted arrays, memory-mapped."""

    def __init__(self, stem: str, columns: list[str], key_type: str = "<u8"):
        self.key = open_array(f"{stem}.key", key_type)
        self.values = [open_array(f"{stem}.{c}", "<f4") for c in columns]

    def find(self, wanted: np.ndarray) -> list[np.ndarray]:
        """The columns for sorted keys; zeros for those that are not there."""
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        there = self.key[at] == wanted
        return [np.where(there, v[at], 0.0) for v in self.values]


class Lookup:
    """Counts by ranges of keys, as `store` wrote them."""

    def __init__(self, parts: list[tuple[int, str]]):
        self.firsts = np.array([first for first, _ in parts], np.int64)
        self.parts = [_Part(stem, ["n"], "<i8") for _, stem in parts]

    def find(self, keys: np.ndarray) -> np.ndarray:
        wanted, where = np.unique(keys.astype(np.int64), return_inverse=True)
        out = np.zeros(len(wanted))
        cuts = np.r_[0, np.searchsorted(wanted, self.firsts[1:]), len(wanted)]
        for part, lo, hi in zip(self.parts, cuts, cuts[1:]):
            if lo < hi:
                out[lo:hi] = part.find(wanted[lo:hi])[0]
        return out[where]


class WordModel:
    def __init__(self, model: dict):
        self.model, self.hashes, self.open = model, Hashes(), {}

    def _find(self, table: str, lang: str, part: np.ndarray, keys: np.ndarray, columns: list[str]) -> list[np.ndarray]:
        out = [np.zeros(len(keys)) for _ in columns]
        stems = self.model[table].get(lang, {})
        for p, own in _by_part(part):
            if p not in stems:
                continue
            if (table, lang, p) not in self.open:
                self.open[table, lang, p] = _Part(stems[p], columns)
            for o, v in zip(out, self.open[table, lang, p].find(keys[own])):
                o[own] = v
        return out

    def scores(self, lang: str, lists: list[list[bytes]], copies: np.ndarray) -> np.ndarray:
        """The log-probability of each list of words; `copies` says how many rows have each list's text."""
        lens = np.array([len(x) for x in lists], np.int64)
        out = np.zeros(len(lists))
        if not lens.sum():
            return out
        side, few, of = np.uint64(self.model["side"]), self.model["few"], self.model["langs"][lang]
        code = np.concatenate([self.hashes.pairs(x) for x in lists if x])
        pair, inv = np.unique(code, return_inverse=True)
        # From here on a row for each text and pair of it.
        each, own = np.unique(np.repeat(np.arange(len(lists)), lens) * len(pair) + inv, return_counts=True)
        doc, which = each // len(pair), each % len(pair)
        n = self._find("pairs", lang, _squares(pair, int(side)), pair, ["n"])[0][which]
        gone = own * copies[doc]
        if not few:  # what these texts hold and no file has was seen once
            n = np.where((n == 0) & (gone > 0), 1, n)
        rest = np.where(n - gone > few, n - gone, 0)
        head, tail = pair & _MASK, pair >> np.uint64(32)
        known = np.unique(np.concatenate([head, tail]))
        total, before, *heads = self._find(
            "words", lang, (known % side).astype(np.int64), known, ["total", "before", *_HEADS]
        )
        h, t = np.searchsorted(known, head)[which], np.searchsorted(known, tail)[which]
        # The rows of one text and earlier or later word; those of a later word are next to one another.
        by_h = np.unique(doc * len(known) + h, return_inverse=True)[1]
        by_t = np.cumsum(_new(doc * len(known) + t)) - 1

        def by(group: np.ndarray, what: np.ndarray) -> np.ndarray:
            """The sum over the rows of one group, for each row."""
            return np.bincount(group, what)[group]

        d2 = of["d2"]
        *many, kept = heads
        whole = kept - sum(d * x for d, x in zip(d2, many))
        worth = rest - costs(rest, d2)
        # What the pairs of the earlier word hold, without this text's part in them.
        held = whole[h] - by(by_h, n - costs(n, d2) - worth)
        total = total[h] - by(by_h, gone)
        lost = (rest == 0).astype(np.float64)
        before = np.maximum(before[t] - by(by_t, lost), 0)
        contexts = of["contexts"] - np.bincount(doc, lost)[doc]
        share = 1.0 / (of["words"] + 1)
        word = (before - costs(before, of["d1"])) / np.maximum(contexts, 1) + of["left"] * share
        seen = total > 0.5
        base = np.where(seen, total, 1)
        left = np.clip(1 - np.maximum(held, 0) / base, 0, 1)
        chance = np.where(seen, worth / base + left * word, word)
        return np.bincount(doc, np.log(np.maximum(chance, 1e-300)) * own, len(lists))
