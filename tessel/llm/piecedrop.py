"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Symbols start as characters; an agenda holds the neighbouring pairs whose concatenation is a piece, best score
first and leftmost among equals.  A candidate that comes up is skipped for good if its keyed hash falls under
the dropout rate.  The key is the seed, the document, the place of the word in it and the candidate's place in
the word: every occurrence of a word draws for itself, and a run can be repeated exactly on any cluster.  With
rate 0 the ids are the library's own.

No piece goes over the start of white space, so a text is cut into units there.  What no draw can change is
remembered: the merges that a unit goes through, in order, when given ones of its candidates are skipped.  An
occurrence draws for these merges; the first that it skips leads on to the merges without that candidate.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import remembered
from tessel.llm.tokenfiles import slices

_SPACE = "▁"
#: Stands for a space sign that is in the text itself, which goes to bytes so that decoding gives it back.
_LITERAL = "\ud800"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Units that a worker remembers the plain merges of, and courses with skipped candidates; a larger set is
#: forgotten and learnt again.
CACHE_UNITS, CACHE_COURSES = 400_000, 200_000
#: Characters of texts that are cut into units at a time, and the longest units whose agendas advance together.
_SLICE, _SHORT = 1 << 21, 64
_NEVER, _MASK, _ODD = 1 << 30, (1 << 64) - 1, 0x9E3779B97F4A7C15
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


_A, _B, _C = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, _ODD


def _mixed(x: int) -> int:
    """64 bits that depend on all bits of a number."""
    x &= _MASK
    x = ((x ^ (x >> 30)) * _A) & _MASK
    x = ((x ^ (x >> 27)) * _B) & _MASK
    return x ^ (x >> 31)


def _mixed_many(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_B)
    return x ^ (x >> np.uint64(31))


def _code(start, mid, stop):
    """A candidate merge of a short unit as one number."""
    return start << 14 | mid << 7 | stop


def _spread(code: np.ndarray) -> np.ndarray:
    """What a candidate adds to an occurrence's key."""
    code = code.astype(np.uint64)
    parts = code >> np.uint64(14), code >> np.uint64(7) & np.uint64(127), code & np.uint64(127)
    return parts[0] * np.uint64(_A) + parts[1] * np.uint64(_B) + parts[2] * np.uint64(_C)


class Courses:
    """Remembered courses of agendas: the merges done in order, what ids they lead to, what was skipped.

    Merges and ids lie end to end in one array each, in which those of a course start at its `first`, `id_first`."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.units: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.first = self.id_first = np.zeros(1, np.int64)
        self.codes = self.ids = np.zeros(0, np.int32)
        self.spread = np.zeros(0, np.uint64)  # of the codes
        self.known: dict = {}

    def extend(self, names: list, units: list[str], skips: list, found: tuple[np.ndarray, ...]) -> None:
        ids, times, codes, n_ids = found
        self.known.update(zip(names, range(len(self.units), len(self.units) + len(units))))
        self.units += units
        self.skips += skips
        self.id_first = np.concatenate([self.id_first, self.id_first[-1] + np.cumsum(n_ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(times)])
        self.codes = np.concatenate([self.codes, codes])
        self.spread = np.concatenate([self.spread, _spread(codes)])

    def skipped(self, course: np.ndarray, done: np.ndarray, key: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences (with a course, merges drawn for already, and a key) that skip a merge, and the first."""
        low = self.first[course] + done
        many = self.first[course + 1] - low
        each = np.repeat(np.arange(len(course)), many)
        at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        draws = _mixed_many(key[each] + self.spread[low[each] + at])
        hit = np.flatnonzero(draws < np.uint64(rate))
        who, k = np.unique(each[hit], return_index=True)
        return who, done[who] + at[hit[k]]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as n says, one after another."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _normal(text: str) -> str:
    if _SPACE in text:
        text = text.replace(_SPACE, _LITERAL)
    return _SPACE + text.replace(" ", _SPACE)


class PieceCoder:
    """One model's encoder and decoder."""

    def __init__(self, path: str, dropout: float = 0.1):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout = min(int(dropout * (1 << 64)), _MASK)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.of_byte = [model.unk_id()] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if m := _BYTE.match(piece):
                self.of_byte[int(m[1], 16)] = i
                self.bytes_of.append(bytes([int(m[1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (-model.get_score(i), i)
                self.bytes_of.append(piece.replace(_SPACE, " ").encode())
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)  # all pieces' bytes, and where each one's are
        self.flat_n = np.array(list(map(len, self.bytes_of)), np.int64)
        self.flat_first = np.cumsum(self.flat_n) - self.flat_n
        self.unit = self._units()
        self.plain, self.others = Courses(), Courses()
        self.rank: np.ndarray | None = None

    def _units(self) -> re.Pattern:
        """Units end where no piece of this vocabulary goes on; a vocabulary may rule out the finer cuts."""
        def none(pattern: str) -> bool:
            return not any(re.search(pattern, p) for p in self.pieces)

        if not none(f"[^{_SPACE}]{_SPACE}") or not none(".\n|\n."):
            return re.compile(r"(?s).+")
        word = f"{_SPACE}*[{_LETTER}]+(?=[{_SPACE}\n.,]|\\Z)|" if none(f"[{_LETTER}][.,]") else ""
        return re.compile(f"{word}{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")

    def _fallback(self, c: str) -> list[int]:
        return [self.of_byte[b] for b in (_SPACE if c == _LITERAL else c).encode()]

    def segment(self, unit: str, key: int = 0) -> list[int]:
        """The ids of one occurrence of a unit, straight from its agenda."""
        pieces, rate, n = self.pieces, self.dropout, len(unit)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts at a place
        agenda: list[tuple[float, int, int, int]] = []

        def propose(start: int, mid: int, stop: int) -> None:
            if found := pieces.get(unit[start:stop]):
                heapq.heappush(agenda, (found[0], start, mid, stop))

        for k in range(n - 1):
            propose(k, k + 1, k + 2)
        while agenda:
            _, start, mid, stop = heapq.heappop(agenda)
            if end[start] != mid or end[mid] != stop:
                continue  # one of the two has been merged since
            if rate and _mixed(key + start * _A + mid * _B + stop * _C) < rate:
                continue
            end[start], end[mid] = stop, -1
            if stop < n:
                before[stop] = start
                propose(start, stop, end[stop])
            if before[start] >= 0:
                propose(before[start], start, stop)
        ids, at = [], 0
        while at < n:
            found = pieces.get(unit[at : end[at]])
            ids += [found[1]] if found else self._fallback(unit[at])
            at = end[at]
        return ids

    def _tables(self) -> None:
        """For `segment_many`: a character's piece, and a pair's merged piece in an open hash table."""
        ids = {p: i for p, (_, i) in self.pieces.items()}
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = {
            (ids[p[:k]] << 32) | ids[p[k:]]: i
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        }
        order = {c: k for k, c in enumerate(sorted({c for c, _ in self.pieces.values()}))}
        self.rank = np.full(len(self.bytes_of), _NEVER, np.int64)
        for cost, i in self.pieces.values():
            self.rank[i] = order[cost]
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_key, self.pair_id = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, i in pairs.items():
            at = (key * _ODD & _MASK) >> (64 - bits)
            while self.pair_key[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.pair_key[at], self.pair_id[at] = key, i

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of pieces, or -1."""
        key = (left.astype(np.int64) << 32) | right
        at = ((key.view(np.uint64) * np.uint64(_ODD)) >> self.shift).astype(np.int64)
        out, open_ = np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(open_):
            there = self.pair_key[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.pair_id[at[open_[hit]]]
            open_ = open_[(there >= 0) & ~hit]
            at[open_] = (at[open_] + 1) & (len(self.pair_key) - 1)
        return out

    def courses(self, units: list[str], skips: list[tuple[int, ...]]) -> tuple[np.ndarray, ...]:
        """For short units of which the candidates `skips` are skipped: their ids one after another, how many merges each
        goes through, these one after another, and how many ids each has.

        All agendas advance together, by each one's best merge.  Symbols stay at the place of their first character;
        longer units come first, so that those that go on longest lie together."""
        if self.rank is None:
            self._tables()
        lens = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-lens, kind="stable")
        chars = np.frombuffer("".join(map(units.__getitem__, order.tolist())).encode("utf-32-le", "surrogatepass"), "<u4")
        last = np.cumsum(lens[order])  # where each unit ends
        first = last - lens[order]
        word = np.repeat(np.arange(len(units)), lens[order])
        sym = self.of_char[chars]
        after, before = np.arange(1, len(chars) + 1), np.arange(-1, len(chars) - 1)  # the next symbol's place, the one before's
        into = np.full(len(chars), -1, np.int32)
        # What the merge of each symbol with the next is worth: its rank, and the place in the unit among equals.
        worth, kept = np.full(len(chars), _NEVER, np.int64), np.ones(len(chars), bool)
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        out = np.sort(np.array([w << 21 | c for w, own in zip(place.tolist(), skips) for c in own], np.int64))

        def propose(at: np.ndarray) -> None:
            worth[at] = _NEVER
            mid, own = after[at], word[at]
            k = np.flatnonzero(mid < last[own])
            at, mid, own = at[k], mid[k], own[k]
            left, right = sym[at], sym[mid]
            k = np.flatnonzero((left >= 0) & (right >= 0))
            got = self._merged(left[k], right[k])
            k, got = k[got >= 0], got[got >= 0]
            if not len(k):
                return
            at, own = at[k], own[k]
            start = at - first[own]
            if len(out):
                code = own << 21 | _code(start, mid[k] - first[own], after[mid[k]] - first[own])
                k = np.flatnonzero(out[np.minimum(np.searchsorted(out, code), len(out) - 1)] != code)
                at, start, got = at[k], start[k], got[k]
            worth[at], into[at] = self.rank[got] << 7 | start, got

        propose(np.arange(len(chars)))
        merges: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(units))
        while len(live):
            best = np.minimum.reduceat(worth[: last[live[-1]]], first[: live[-1] + 1])
            live = np.flatnonzero(best < _NEVER)
            head = first[live]
            at = head + (best[live] & 127)
            mid = after[at]
            stop = after[mid]
            merges.append((order[live], _code(at - head, mid - head, stop - head)))
            sym[at], after[at], worth[mid], kept[mid] = into[at], stop, _NEVER, False
            inner = stop < last[live]
            before[stop[inner]] = at[inner]
            propose(np.concatenate([at, before[at[at > head]]]))
        where = np.flatnonzero(kept)
        ids, owner = sym[where], order[word[where]]
        if (ids < 0).any():
            # Characters without a piece become as many byte ids as they have bytes.
            codes = [self._fallback(chr(c)) for c in chars[where[ids < 0]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[ids < 0] = list(map(len, codes))
            fallen = np.repeat(ids < 0, times)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[fallen] = np.concatenate(codes)
        n_ids = np.bincount(owner, minlength=len(units))
        ids = ids[_ranges((np.cumsum(n_ids[order]) - n_ids[order])[place], n_ids)]
        # A unit goes on until it has no merge left, so that round k has its merge k.
        times = sum((np.bincount(own, minlength=len(units)) for own, _ in merges), np.zeros(len(units), np.int64))
        codes, base = np.zeros(times.sum(), np.int32), np.cumsum(times) - times
        for k, (own, code) in enumerate(merges):
            codes[base[own] + k] = code
        return ids, times, codes, n_ids

    def _learn(self, units: list[str]) -> np.ndarray:
        """The plain course of each short unit; -1 for a long one."""
        course = np.fromiter(map(self.plain.known.get, units, repeat(-1)), np.int64, len(units))
        rest = np.flatnonzero(course < 0)
        new = [u for u in dict.fromkeys(map(units.__getitem__, rest.tolist())) if len(u) <= _SHORT]
        if not new:
            return course
        if len(self.plain.units) + len(new) > CACHE_UNITS and self.plain.units:
            self.plain.clear()
            self.others.clear()  # whose names are courses of these
            return self._learn(units)
        skips: list[tuple[int, ...]] = [()] * len(new)
        self.plain.extend(new, new, skips, self.courses(new, skips))
        course[rest] = list(map(self.plain.known.get, map(units.__getitem__, rest.tolist()), repeat(-1)))
        return course

    def _turn(self, held: Courses, course: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The course that leaves each course by skipping its merge `at`."""
        step = int(held is self.others)
        each, where = np.unique(course << 8 | at << 1 | step, return_inverse=True)
        found = np.fromiter(map(self.others.known.get, each.tolist(), repeat(-1)), np.int64, len(each))
        new = np.flatnonzero(found < 0)
        if len(new):
            names = each[new]
            froms = names >> 8
            codes = held.codes[held.first[froms] + (names >> 1 & 127)].tolist()
            froms = froms.tolist()
            units = list(map(held.units.__getitem__, froms))
            skips = [(*own, code) for own, code in zip(map(held.skips.__getitem__, froms), codes)]
            found[new] = np.arange(len(self.others.units), len(self.others.units) + len(new))
            self.others.extend(names.tolist(), units, skips, self.courses(units, skips))
        return found[where]

    def _encode(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of each occurrence of a unit, given its key."""
        ids, n_ids = self._encode_all(units, keys)
        data, ends = ids.tobytes(), (np.cumsum(n_ids) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_all(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences of units one after another, given their keys, and how many each has."""
        course = self._learn(units)
        long = np.flatnonzero(course < 0)
        extra = [self.segment(units[k], int(keys[k])) for k in long.tolist()]
        who = np.flatnonzero(course >= 0)
        # Where the ids of each occurrence are: those of plain courses, of others, and of long units lie end to end.
        start, n_ids = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        own = course[who]
        start[who], n_ids[who] = self.plain.id_first[own], np.diff(self.plain.id_first)[own]
        held, course, done = self.plain, own, np.zeros(len(who), np.int64)
        while self.dropout and len(who):
            some, at = held.skipped(course, done, keys[who], self.dropout)
            who, course, done = who[some], self._turn(held, course[some], at), at
            held = self.others
            start[who] = len(self.plain.ids) + held.id_first[course]
            n_ids[who] = held.id_first[course + 1] - held.id_first[course]
        n_ids[long] = list(map(len, extra))
        start[long] = len(self.plain.ids) + len(self.others.ids) + np.cumsum(n_ids[long]) - n_ids[long]
        rest = np.fromiter(chain.from_iterable(extra), np.int32)
        ids = np.concatenate([self.plain.ids, self.others.ids, rest])[_ranges(start, n_ids)]
        if len(self.others.units) > CACHE_COURSES:
            self.others.clear()
        return ids, n_ids

    def encode(self, texts: list[str | None], salts: list[int]) -> list[np.ndarray]:
        """The ids of texts.  A text's salt and the place of a word in it are the key of the word's draws."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        ready: list[int] = []
        for k, text in enumerate(texts):
            if text and len(text) <= _SLICE:
                ready.append(k)
            elif text:
                units, at, parts = (m[0] for m in self.unit.finditer(_normal(text))), 0, []
                while part := list(islice(units, _SLICE // 4)):
                    parts.append(self._encode_all(part, _keys(salts[k], at, len(part)))[0])
                    at += len(part)
                out[k] = np.concatenate(parts)
        lists = [self.unit.findall(_normal(texts[k])) for k in ready]
        if lists:
            keys = np.concatenate([_keys(salts[k], 0, len(units)) for k, units in zip(ready, lists)])
            ids, n_ids = self._encode_all(list(chain.from_iterable(lists)), keys)
            ends = np.cumsum(n_ids)[np.cumsum(list(map(len, lists))) - 1].tolist()
            for k, a, b in zip(ready, [0, *ends], ends):
                out[k] = ids[a:b]
        return out

    def decode(self, ids) -> str:
        return self.decode_many([np.array(ids, np.int64)])[0]

    def decode_many(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids; the caller keeps their length within what memory holds."""
        ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        n = self.flat_n[ids]
        data = self.flat[_ranges(self.flat_first[ids], n)].tobytes()
        ends = np.r_[0, np.cumsum(n)][np.cumsum(list(map(len, lists)), dtype=np.int64)].tolist()
        # The first character is the space that encoding puts before the text.
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip([0, *ends], ends)]


_coders: dict[tuple, PieceCoder] = remembered({})


def coder(*how) -> PieceCoder:
    if how not in _coders:
        _coders[how] = PieceCoder(*how)
    return _coders[how]


def _keys(salt: int, first: int, n: int) -> np.ndarray:
    """The keys of a document's words from the place `first` on."""
    return _mixed_many(np.uint64(salt) + np.arange(first, first + n, dtype=np.uint64) * np.uint64(_ODD))


def _salt(seed: int, doc_id) -> int:
    return xxhash.xxh64_intdigest(repr(None if pd.isna(doc_id) else int(doc_id)), seed)


def encode_documents(
    docs: DataFrame,
    model: str,
    dropout: float = 0.1,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of little-endian signed 32-bit ids), lossless, text_crc32 for each row.

    `lossless` says whether decoding the ids gave the text back, byte for byte, and text_crc32 is of the decoded
    text.  Null and empty texts have no ids, and decode to the empty text; rows without an id draw alike, as do
    repeated rows, which get the same ids; very long texts are encoded whole, a stretch at a time; among equal
    scores the leftmost merge goes first; an empty table gives an empty result; other columns are not read.
    """
    names = ["doc_id", "ids", "n_tokens", "ids_crc32", "lossless", "text_crc32"]
    schema = "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, lossless boolean, text_crc32 long"

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model, dropout)
        for batch in batches:
            at = 0
            for texts in slices(batch["text"], _SLICE):
                own = batch["doc_id"].iloc[at : at + len(texts)]
                at += len(texts)
                out, encoded = [], c.encode(texts, [_salt(seed, i) for i in own])
                for i, text, ids, back in zip(own, texts, encoded, c.decode_many(encoded)):
                    out.append((i, ids, len(ids), zlib.crc32(ids.tobytes()), back == text, zlib.crc32(back.encode())))
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(kernel, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row's ids (null ids: the empty text)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(model, 0.0)
        for batch in batches:
            texts = [c.decode([] if ids is None else list(ids)) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(kernel, "doc_id long, text string")
