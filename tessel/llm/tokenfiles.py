"""Token ids as flat binary files.

A data set is a folder of parts and a manifest.  Part P has three flat little-endian arrays without headers:

    P.tok  the ids of its documents end to end, unsigned 16 bits if every id of the vocabulary fits, else 32
    P.off  64-bit unsigned offsets, one a document and one more: where each document's ids start in P.tok
    P.ids  64-bit document ids

Documents are in ascending order of their id over all parts (null ids first), and each ends with the end id.
The manifest (parquet) has a row a part with its documents, ids, and bases: prefix sums over the parts before
it, so that a base plus an offset is a place in the whole data set.  All three arrays can be memory-mapped.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import cut, shared_dir

#: Entries that a worker remembers.  Half of them are the newer ones; when they are full they become the older
#: half, and of what was the older half only units that have come up since are kept.
CACHE_ENTRIES = 1_200_000
#: Characters that are cut into units at a time.
_SLICE = 1 << 21
#: Letters for certain, so that a token never goes on from one of them to a full stop or comma.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_UNIT = re.compile(rf"[ \t\n\r]*[{_LETTER}]+(?=[ \t\n\r.,]|\Z)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
_PLAIN = re.compile(rf"[ \t\n\r]*[{_LETTER}]+\Z")
_WORD = re.compile(rf" ?[{_LETTER}]+\Z")
_MARK = "\0"
#: White space of any kind but these four: texts with such characters are not cut into units.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_ASCII = re.compile("[\x0b\x0c\x1c-\x1f]")
MANIFEST = "part int, stem string, n_null long, n_docs long, n_tokens long, width int"


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _cuts_into_units(config: dict) -> bool:
    """Whether a tokenizer is one whose ids are those of its units: byte-level, cut by the usual pattern, without a
    normalizer and without an added token that white space is in or may be taken with."""
    how = config.get("pre_tokenizer") or {}
    added = config.get("added_tokens") or []
    return (
        config.get("normalizer") is None
        and (how.get("type"), how.get("add_prefix_space"), how.get("use_regex", True)) == ("ByteLevel", False, True)
        and config["model"].get("type") == "BPE"
        and not config["model"].get("dropout")
        and not any(a["content"].split() != [a["content"]] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    )


class Encoder:
    """Texts to ids as bytes, with the tokenizers library.

    A byte-level BPE never merges over the start of white space, nor from a letter to a full stop or comma, so a
    text's ids are those of its units (white space and the word after it, or the mark after a word) end to end,
    and a unit's ids are looked up once and remembered, end to end in one array.  Texts are encoded whole if
    the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.by_unit = _cuts_into_units(json.loads(self.model.to_str()))
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        marks = self._ids(_MARK + " a" + _MARK)
        self.mark = marks[0] if marks[0] == marks[-1] and self._ids(_MARK) == marks[:1] else None
        # A word is one piece of text to the BPE itself, unless an added token may stand in it.
        added = json.loads(self.model.to_str()).get("added_tokens") or []
        self.letters, tries = _byte_letters(), [" the", "Stra\xdfe", " \xe9t\xe9"]
        self.direct = (
            self.by_unit
            and not any(_PLAIN.match(a["content"]) for a in added)
            and self._encode_words(tries) == self._encode(tries)
        )
        self.older: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # of a unit: a place in `first`, which says where its ids are in `ids`
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in done]

    def _encode_plain(self, units: list[str]) -> list[bytes]:
        """The ids of units of white space and letters, from one text in which a mark parts them: no token holds
        the mark and a letter or white space, so the ids between marks are the units' own."""
        ids = np.array(self._ids(_MARK.join(units)), self.dtype)
        cuts = (np.flatnonzero(ids == self.mark) * self.width).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *[c + self.width for c in cuts]], [*cuts, len(data)])]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, from the library's BPE without the steps that cut texts for it."""
        cut, letters = self.model.model.tokenize, self.letters
        ids = [[x.id for x in cut(w.encode().decode("latin-1").translate(letters))] for w in words]
        ends = (np.cumsum(list(map(len, ids))) * self.width).tolist()
        data = np.array(list(chain.from_iterable(ids)), self.dtype).tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, units: list[str]) -> list[bytes]:
        """The ids of each unit that is not known: older ones are still there, and the rest is encoded in one go."""
        found = dict.fromkeys(units, b"")
        words, plain, other = [], [], []
        for u in units:
            if (k := self.older.get(u)) is not None:
                found[u] = self.older_ids[self.older_first[k] : self.older_first[k + 1]].tobytes()
            elif self.direct and _WORD.match(u):
                words.append(u)
            else:
                (plain if self.mark is not None and _PLAIN.match(u) else other).append(u)
        for new, encode in ((words, self._encode_words), (plain, self._encode_plain), (other, self._encode)):
            for k in range(0, len(new), 1024):
                found.update(zip(new[k : k + 1024], encode(new[k : k + 1024])))
        return list(found.values())

    def _join(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of units."""
        units = list(chain.from_iterable(lists))
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        rest = np.flatnonzero(at < 0)
        if len(rest):
            unknown = list(map(units.__getitem__, rest.tolist()))
            new = list(dict.fromkeys(unknown))
            data = self._learn(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            n = np.fromiter(map(len, data), np.int64, len(data)) // self.width
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(data), self.dtype)])
            at[rest] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        start, ends = self.first[at], np.cumsum(self.first[at + 1] - self.first[at])
        n = np.diff(ends, prepend=0)
        ids = self.ids[np.arange(n.sum()) + np.repeat(start - ends + n, n)].tobytes()
        cuts = (np.r_[0, ends][np.cumsum([0, *map(len, lists)])] * self.width).tolist()
        if len(self.known) > CACHE_ENTRIES // 2:
            self.older, self.older_first, self.older_ids = self.known, self.first, self.ids
            self._forget()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; the caller keeps a list's characters within what memory holds."""
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            odd = _ODD_ASCII if text.isascii() else _ODD
            if not self.by_unit or odd.search(text):
                out[k] = self._encode([text])[0]
            elif len(text) > _SLICE:
                units = (m[0] for m in _UNIT.finditer(text))
                out[k] = b"".join(self._join([part])[0] for part in iter(lambda: list(islice(units, 1 << 18)), []))
            else:
                plain.append(k)
        for k, ids in zip(plain, self._join([_UNIT.findall(texts[k]) for k in plain])):
            out[k] = ids
        return out


def slices(texts: Iterable[str], most: int = _SLICE) -> Iterator[list[str]]:
    """The texts in lists of `most` characters or so."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the data set to `path`, a URI that all executors can write; returns the manifest with its bases.

    Null texts count as empty: their documents hold the end id alone.  Repeated ids stay as so many documents,
    in the order of their texts; rows without an id come first.  Very long texts are encoded whole, a stretch at a
    time.  An empty table gives no parts; other columns are not read.  A task that runs again writes files of its
    own; the manifest names those of the attempt that counted.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        store, top = pafs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        stem, out, offsets, ids, n_null = f"{part:06d}-{uuid.uuid4().hex}", None, [0], [], 0
        for batch in batches:
            out = out or store.open_output_stream(f"{top}/{stem}.tok")
            for i in batch["doc_id"]:
                n_null += bool(pd.isna(i))
                ids.append(0 if pd.isna(i) else int(i))
            for texts in slices(batch["text"]):
                for data in enc.encode(texts):
                    out.write(data + end)
                    offsets.append(offsets[-1] + len(data) // enc.width + 1)
        if out:
            out.close()
            for kind, values in (("off", np.array(offsets, "<u8")), ("ids", np.array(ids, "<i8"))):
                with store.open_output_stream(f"{top}/{stem}.{kind}") as f:
                    f.write(values.tobytes())
            yield pd.DataFrame([[part, stem, n_null, len(ids), offsets[-1], enc.width]], columns=_MANIFEST_NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    parts = cut(dealt.mapInPandas(kernel, MANIFEST), "token-parts")
    # A row a part: the sums over the parts before it run over a list as long as the number of partitions.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "*",
        F.coalesce(F.sum("n_docs").over(ahead), F.lit(0)).alias("base_docs"),
        F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("base_tokens"),
    )
    bases.write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(bases.schema).parquet(f"{path}/manifest")


_MANIFEST_NAMES = [c.split()[0] for c in MANIFEST.split(", ")]


def open_array(uri: str, dtype: str) -> np.ndarray:
    """A flat array of a part: memory-mapped where the store is a file system, else read."""
    store, name = pafs.FileSystem.from_uri(uri)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (its place in the whole data set), n_tokens, ids_crc32
    (of its ids as little-endian unsigned 32-bit integers)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                tokens = open_array(f"{path}/{p.stem}.tok", f"<u{p.width}")
                offsets, ids = open_array(f"{path}/{p.stem}.off", "<u8"), open_array(f"{path}/{p.stem}.ids", "<i8")
                for k in range(0, len(ids), 4096):
                    off = offsets[k : k + 4097].astype(np.int64)
                    own = pd.Series(ids[k : k + 4096], dtype="Int64")
                    own[: max(0, p.n_null - k)] = pd.NA
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(off, off[1:])]
                    yield pd.DataFrame(
                        {"doc_id": own, "start": off[:-1] + p.base_tokens, "n_tokens": np.diff(off), "ids_crc32": crc}
                    )

    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n).mapInPandas(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes a data set under the shared folder and reads it back, document by document."""
    path = shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, end_id), path)
