"""Benchmark decontamination: BM25 retrieval of test items for every training passage, then an overlap check.

Test items are cut into pieces of at most half a passage.  Spark counts in how many pieces of the whole benchmark
each term stands, and how long they are; with that the pieces are put into inverted indexes of bounded size, whose
weights are the same however many there are.  A piece's BM25 weights are divided by its score against itself, so
one threshold holds for all pieces.

A training passage is a window over the words of the text, each overlapping the next by half.  Passages walk the
indexes by block-max WAND: each term has a cursor over the blocks of consecutive pieces that hold it; cursors in
order of their blocks add up the terms' largest weights to the pivot, before which no piece can reach the
threshold; the pivot's block is scored only if the block maxima there reach it too, and the cursors go on behind
it.  All pieces at or over the threshold are retrieved, without a cap.  Many passages take a step at a time.

An item that has a piece retrieved counts as leaked where the text around the passage holds enough of the
question's word shingles and of the answer's words.
"""

from __future__ import annotations

import pickle
import re
import string
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, shared_dir
from tessel.llm.tokenfiles import slices

_FOLD = bytearray(range(256))
for _c in string.ascii_uppercase:
    _FOLD[ord(_c)] = ord(_c.lower())
for _c in string.punctuation:
    _FOLD[ord(_c)] = 32
_FOLD = bytes(_FOLD)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[bytes]:
    """Words with A-Z folded; ASCII marks and white space part them."""
    return (text or "").encode().translate(_FOLD).split()


def shingles(ws: list[bytes], size: int) -> set[bytes]:
    """Runs of `size` words; the whole if it has fewer, none if it has none."""
    if len(ws) <= size:
        return {b" ".join(ws)} if ws else set()
    return set(map(b" ".join, zip(*(ws[k:] for k in range(size)))))


@dataclass
class Item:
    question: set[bytes]
    answer: Counter
    length: int
    shingle: int


def parse_item(text: str | None, shingle: int) -> Item:
    """Question and answer of an item: its last sentence is the answer if there are more than one."""
    parts = [p for p in map(words, _SENTENCE.split(text or "")) if p]
    question = [w for p in (parts[:-1] or parts) for w in p]
    answer = parts[-1] if len(parts) > 1 else []
    size = min(shingle, len(question)) or 1
    return Item(shingles(question, size), Counter(answer), len(question) + len(answer), size)


def pieces_of(ws: list[bytes], half: int) -> list[list[bytes]]:
    """An item's words in pieces of equal length, `half` words at most."""
    n = -(-len(ws) // half)
    return [ws[k * len(ws) // n : (k + 1) * len(ws) // n] for k in range(n)]


def weights(f, length, held, pieces: int, mean: float, k1: float, b: float):
    """BM25 weights of terms that stand f times in a piece and in `held` pieces of all."""
    return np.log(1 + (pieces - held + 0.5) / (held + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean))


class Index:
    """The inverted index of some of the items: memory is in proportion to its postings.

    `postings` has a row for each piece and term: the piece (items in their order, numbered through), the term and
    its normalised weight.
    """

    def __init__(self, names: list[int], items: list[Item], owner: np.ndarray, postings: pd.DataFrame, window: int, block: int):
        self.names, self.items, self.owner = names, items, owner
        self.window, self.half, self.block = window, window // 2, block
        codes, held = pd.factorize(postings["term"], sort=True)
        self.terms = {w: k for k, w in enumerate(held.tolist())}
        piece, value = postings["piece"].to_numpy(np.int64), postings["weight"].to_numpy(np.float64)
        order = np.lexsort((piece, codes))
        codes, self.where, self.value = codes[order].astype(np.int64), piece[order], value[order]
        self.blocks = int(piece.max(initial=-1)) // block + 1
        #: A term's blocks, as term * blocks + block in order, their largest weights, and where their postings begin.
        self.place, first = np.unique(codes * max(1, self.blocks) + self.where // block, return_index=True)
        self.begin = np.r_[first, len(codes)]
        self.most = np.maximum.reduceat(self.value, first) if len(codes) else np.zeros(0)
        self.first = np.searchsorted(self.place, np.arange(len(self.terms) + 1) * max(1, self.blocks))
        self.top = np.maximum.reduceat(self.most, self.first[:-1]) if len(codes) else np.zeros(0)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, piece, score) at or over the threshold, for distinct (passage, term) in the passages' order."""
        found: list[tuple[np.ndarray, ...]] = []
        least = threshold * (1 - 1e-6)  # sums may be off by their rounding
        at = self.first[term]
        while len(passage):
            now = self.place[at] - term * self.blocks
            order = np.argsort(passage * self.blocks + now, kind="stable")
            passage, term, at, now = passage[order], term[order], at[order], now[order]
            heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            many = np.diff(np.r_[heads, len(passage)])
            total = np.cumsum(self.top[term])
            total -= np.repeat(total[heads] - self.top[term[heads]], many)
            # The pivot: the first cursor at which what the terms can give together reaches the threshold.
            over = np.flatnonzero(total >= least)
            pivots = over[np.flatnonzero(np.r_[True, passage[over][1:] != passage[over][:-1]])] if len(over) else over
            if not len(pivots):
                break
            live = np.zeros(len(heads), bool)
            live[np.searchsorted(heads, pivots, "right") - 1] = True
            pivot, many, live = now[pivots], many[live], np.repeat(live, many)
            passage, term, at, now = passage[live], term[live], at[live], now[live]
            pivot = np.repeat(pivot, many)
            # Cursors before the pivot's block go on to it, or beyond where the term is not in it.
            behind = np.flatnonzero(now < pivot)
            at[behind] = np.searchsorted(self.place, term[behind] * self.blocks + pivot[behind])
            there = np.flatnonzero((at < self.first[term + 1]) & (self.place[np.minimum(at, len(self.place) - 1)] == term * self.blocks + pivot))
            own = np.repeat(np.arange(len(many)), many)
            bound = np.bincount(own[there], self.most[at[there]], len(many))
            scored = there[bound[own[there]] >= least]
            if len(scored):
                found.append(self._score(passage[scored], at[scored], threshold))
            at[there] += 1
            left = at < self.first[term + 1]
            passage, term, at = passage[left], term[left], at[left]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _score(self, passage: np.ndarray, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of all pieces of the cursors' blocks."""
        low = self.begin[at]
        many = self.begin[at + 1] - low
        each = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        pieces = self.blocks * self.block
        key, where = np.unique(np.repeat(passage, many) * pieces + self.where[each], return_inverse=True)
        score = np.round(np.bincount(where, self.value[each]), 9)
        good = score >= threshold
        return key[good] // pieces, key[good] % pieces, score[good]

    def passages(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (passage, term) of the lists of words, passages numbered through, and each list's first passage."""
        lens = np.array([len(x) for x in lists], np.int64)
        firsts = np.cumsum(np.r_[0, np.maximum(1, -(-lens // self.half) - 1)])
        get = self.terms.get
        ids = np.fromiter(map(get, chain.from_iterable(lists), repeat(-1)), np.int64, lens.sum())
        at = np.flatnonzero(ids >= 0)
        own = np.repeat(np.arange(len(lists)), lens)[at]
        part = (at - (np.cumsum(lens) - lens)[own]) // self.half
        count = np.diff(firsts)[own]
        n = max(1, len(self.terms))
        keys = [(firsts[own] + p)[ok] * n + ids[at][ok] for p, ok in ((part, part < count), (part - 1, (part > 0) & (part - 1 < count)))]
        key = np.unique(np.concatenate(keys))
        return key // n, key % n, firsts[:-1]

    def leaks(self, texts: list[list[bytes]], threshold: float, question: float, answer: float) -> list[tuple]:
        """(text, item's name, score, question overlap, answer overlap) of the items that texts give away."""
        best: dict[tuple[int, int], float] = {}
        places = defaultdict(set)
        # A stretch goes on into the next for half a passage, so that no passage is missed between them.
        stretches = [(k, lo) for k, ws in enumerate(texts) for lo in range(0, max(1, len(ws)), _STRETCH * self.half)]
        size, group = 0, []
        for place, (k, lo) in enumerate(stretches):
            group.append((k, lo, texts[k][lo : lo + _STRETCH * self.half + self.half]))
            size += len(group[-1][2])
            if size < _WORDS and place < len(stretches) - 1:
                continue
            passage, term, firsts = self.passages([ws for _, _, ws in group])
            for p, piece, score in zip(*(x.tolist() for x in self.retrieve(passage, term, threshold))):
                which = int(np.searchsorted(firsts, p, "right")) - 1
                text, start, _ = group[which]
                key = text, int(self.owner[piece])
                best[key] = max(best.get(key, 0.0), score)
                places[key].add(start + (p - int(firsts[which])) * self.half)
            size, group = 0, []
        out = []
        for text, item in sorted(places):
            it, q, a = self.items[item], 0.0, 0.0
            for start in sorted(places[text, item]):
                near = texts[text][max(0, start - it.length) : start + self.window + it.length]
                x = len(it.question & shingles(near, it.shingle)) / max(1, len(it.question))
                y = sum((it.answer & Counter(near)).values()) / it.answer.total() if it.answer else 1.0
                q, a = max((q, a), (x, y), key=lambda z: (z[0] >= question and z[1] >= answer, z))
            if q >= question and a >= answer:
                out.append((text, self.names[item], best[text, item], q, a))
        return out


#: Half passages of a long text that are looked at in one go, and words of texts that are.
_STRETCH, _WORDS = 2048, 1 << 18
_loaded: dict[str, tuple[int, Index]] = {}


def _index(path: str, most: int = 1 << 26) -> Index:
    """An index from the shared folder; a worker keeps those that were read last, up to `most` bytes of files."""
    if path not in _loaded:
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            data = f.read()
        while _loaded and sum(n for n, _ in _loaded.values()) + len(data) > most:
            del _loaded[next(iter(_loaded))]
        _loaded[path] = len(data), pickle.loads(data)
    return _loaded[path][1]


def build_indexes(
    items: DataFrame, window: int, shingle: int, block: int, index_words: int, k1: float = 1.2, b: float = 0.75
) -> list[str]:
    """The files of the indexes of `items` (i, t: distinct rows): one for about `index_words` words.

    In how many pieces a term stands and how long pieces are is counted over all items.
    """
    spark, half = items.sparkSession, window // 2
    total = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    parts = max(1, -(-int(total) // index_words))
    mine = items.withColumns({"h": F.xxhash64("t"), "part": F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int")})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, i, h, t in zip(batch["part"], batch["i"], batch["h"], batch["t"]):
                for k, piece in enumerate(pieces_of(words(t), half)):
                    out.append((part, i, h, k, None, 0, len(piece)))
                    out += [(part, i, h, k, w, f, len(piece)) for w, f in Counter(piece).items()]
            yield pd.DataFrame(out, columns=["part", "i", "h", "k", "term", "f", "length"])

    rows = cut(mine.mapInPandas(split, "part int, i long, h long, k int, term binary, f int, length int"), "pieces")
    pieces, mean = rows.filter("term IS NULL").agg(F.count("*"), F.avg("length")).first()
    if not pieces:
        return []
    held = rows.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("held"))
    postings = rows.join(held, "term")
    path = shared_dir(spark, "test-items")

    def write(key: tuple, own: pd.DataFrame, tests: pd.DataFrame) -> pd.DataFrame:
        tests = tests.sort_values(["i", "h"]).reset_index(drop=True)
        own = own.sort_values(["i", "h", "k", "term"]).reset_index(drop=True)
        own["weight"] = weights(own["f"], own["length"], own["held"], pieces, mean, k1, b)
        each = own.groupby(["i", "h", "k"], sort=False)
        own["weight"] /= each["weight"].transform("sum")
        own["piece"] = each.ngroup()
        at = {x: k for k, x in enumerate(zip(tests["i"], tests["h"]))}
        owner = np.array([at[i, h] for i, h, _ in each.groups], np.int64)
        index = Index(tests["i"].tolist(), [parse_item(t, shingle) for t in tests["t"]], owner, own, window, block)
        fs, top = pafs.FileSystem.from_uri(path)
        fs.create_dir(top, recursive=True)
        name = f"index-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(pickle.dumps(index))
        return pd.DataFrame({"name": [f"{path}/{name}"]})

    done = postings.groupBy("part").cogroup(mine.groupBy("part")).applyInPandas(write, "name string")
    return sorted(r.name for r in cut(done, "indexes").collect())


def contamination(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    question: float = 0.8,
    answer: float = 0.8,
    window: int = 64,
    shingle: int = 5,
    block: int = 4,
    index_words: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and item it gives away.

    Statistics are those of all items; the items are then dealt into indexes of about `index_words` words, files in
    the shared folder of which a task holds some at a time, and all are tried in one pass over the documents.  Only
    passages decide, so very long texts are looked at whole.  Items without an id or without words match nothing;
    items with one id and different texts are told apart by the text that matches, equal ones are one.  Scores
    equal to the threshold count.  Null and empty documents give nothing away; a repeated document gives its rows
    again; empty tables give an empty result; other columns are not read.
    """
    tests = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    files = build_indexes(tests.filter("i IS NOT NULL").distinct(), window, shingle, block, index_words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text <> ''")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for texts in slices(batch["text"], _SLICE) if files else ():
                ids = batch["doc_id"].iloc[at : at + len(texts)].tolist()
                at += len(texts)
                lists = [words(t) for t in texts]
                out = [(ids[k], *rest) for f in files for k, *rest in _index(f).leaks(lists, threshold, question, answer)]
                yield pd.DataFrame(out, columns=_LEAK_NAMES).astype({"doc_id": "Int64"})

    return rows.mapInPandas(kernel, _LEAK)


_SLICE = 1 << 22
_LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_LEAK_NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
