"""Quality rules with the perplexity of a modified Kneser-Ney model.

Spark counts the pairs of neighbouring words of the corpus by language (`wordmodel.py`); tasks memory-map the
sorted arrays of the model and score every text by it.  Every language has a band of log-perplexities, from the
corpus's own quartiles; documents outside it are rejected: above it are texts whose words, or whose order of
words, the language does not have, below it texts that say what everybody says.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import wordmodel
from tessel.llm.common import cut, shared_dir, spread_join
from tessel.llm.tokenfiles import slices

_SYMBOLS = "#*$%&|<>"
#: Characters that a task scores at a time.
_SLICE = 1 << 20


def base_metrics(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    n = len(words)
    raw = text.encode()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = Counter(x for x in raw.split(b"\n") if x.split()) if n else Counter()
    dup = lines.total() - len(lines)
    repeated = 0
    if n >= 3:
        known = dict(zip(dict.fromkeys(words), range(n)))
        ids = np.array(list(map(known.__getitem__, words)), np.int64)
        # Places of equal windows: number the pairs first, so that no product can overflow.
        pair = np.unique(ids[:-1] * (len(known) + 1) + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * (len(known) + 1) + ids[2:]
        _, where, count = np.unique(window, return_inverse=True, return_counts=True)
        hit = count[where] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        repeated = int(covered.sum())
    return n, chars, symbols, dup, repeated


_models: dict[str, tuple[wordmodel.WordModel, wordmodel.Lookup]] = {}


def _model(path: str, model: dict, copies: list) -> tuple[wordmodel.WordModel, wordmodel.Lookup]:
    if path not in _models:
        _models.clear()
        _models[path] = wordmodel.WordModel(model), wordmodel.Lookup(copies)
    return _models[path]


_MEASURED = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, log_perplexity double"
)
_NAMES = [c.split()[0] for c in _MEASURED.split(", ")]


def measure(rows: DataFrame, path: str, model: dict, copies: list) -> DataFrame:
    """The base metrics and the log-perplexity of a word under the row's language's model, 0 without words.

    `rows` has doc_id, lang, text and copy, the key under which `copies` has how many rows hold the text.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for texts in slices(batch["text"], _SLICE):
                ids, langs, keys = (batch[c].iloc[at : at + len(texts)] for c in ("doc_id", "lang", "copy"))
                at += len(texts)
                scorer, held = _model(path, model, copies)
                times = np.maximum(held.find(keys.to_numpy()), 1)
                langs, words = langs.tolist(), [text.encode().split() for text in texts]
                means = np.zeros(len(texts))
                for lang in set(langs):
                    own = [k for k, x in enumerate(langs) if x == lang]
                    means[own] = scorer.scores(lang, [words[k] for k in own], times[own])
                means = -means / np.maximum([len(w) for w in words], 1)
                out = [
                    (i, lang, *base_metrics(text, w), round(m, 4))
                    for i, lang, text, w, m in zip(ids.tolist(), langs, texts, words, means.tolist())
                ]
                yield pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    return rows.mapInPandas(kernel, _MEASURED)


def judge(
    docs: DataFrame,
    below: float = 18.0,
    above: float = 6.0,
    least: float = 0.02,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    few: int = wordmodel.FEW,
    part_words: int = wordmodel.PART_WORDS,
) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    log_perplexity, lower, upper, lang.

    A language's band reaches from `below` times the distance of the lower quartile and the median (`least` at
    least) under that quartile to `above` times that of the upper one over it.  Quartiles are over its documents of
    50 words or more, to three decimals.  `below` is wide, for near copies predict each other: it parts texts that
    are said all the time from prose.  With `few` 0 the model has all pairs, else it is pruned (`wordmodel.py`).  A null language is the language `und`.  Null and empty texts have no words
    and fail the base rule; very long texts are scored whole; repeated rows count and are judged each; ties with a
    limit are kept; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.lower(F.col(lang_col).cast("string")), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    path = shared_dir(docs.sparkSession, "kneser-ney")
    model = wordmodel.build(rows.select("lang", "text"), path, few, part_words)
    # With the language, since the counts that a text's copies add are those of their language.
    rows = rows.withColumn("copy", F.xxhash64("lang", "text"))
    copies = rows.groupBy(F.col("copy").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    held = wordmodel.store(copies, f"{path}/copies")
    measured = cut(measure(rows, path, model, held), "quality")
    long_enough = measured.filter("n_words >= 50").withColumn("p", F.round("log_perplexity", 3))
    quartiles = long_enough.groupBy("lang").agg(F.percentile("p", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    down, up = (x * F.greatest(F.col("q")[k + 1] - F.col("q")[k], F.lit(least)) for k, x in enumerate((below, above)))
    bands = quartiles.select("lang", (F.col("q")[0] - down).alias("lower"), (F.col("q")[2] + up).alias("upper"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    sizes = measured.groupBy("lang").agg(F.count("*").alias("n"))
    return (
        spread_join(measured, sizes.join(bands, "lang", "left"), "lang")
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & inside).alias("kept"),
            "log_perplexity",
            "lower",
            "upper",
            "lang",
        )
    )
