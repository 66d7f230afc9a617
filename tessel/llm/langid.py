"""Language identification by Bayesian fusion of evidence.

A row's evidence is its text (a naive Bayes likelihood over byte trigrams, counted over the whole corpus by
declared language), the language that its markup declares, its host, and the suffix of the host's address.
What a host usually holds is a prior, counted by grouped aggregation and smoothed towards its suffix, which is
smoothed towards the whole corpus; so an address with few rows leans on what it shares with others.

Beside the languages there is the class of all others.  Under it a trigram is as likely as halfway
from what a language gives its own texts to what it gives those of the other languages, on average; so a text
that fits no language better than foreign texts do is undetermined, however the languages differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, spread_join

#: Trigrams are hashed into so many buckets: with the languages, the bound on the model's size.
BUCKETS = 1 << 15
#: Languages are the declared ones that enough rows have, so many at most.
MOST_LANGUAGES, LEAST_ROWS, LEAST_SHARE = 64, 5, 0.001
#: What is expected of other languages before anything is known.
OTHER = 0.01
#: How far from a language's own texts to foreign ones those of unknown languages begin.
_FOREIGN = 0.5
_CHUNK = 1 << 20
#: How many overlapping trigrams count as one independent observation.
_TEMPER = 4.0


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a text (A-Z folded) round a letter, in chunks; a space stands at either end.

    Digits and marks are much alike in all languages, and would be most of what a list of numbers says."""
    data = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    for k in range(0, len(data) - 2, _CHUNK):
        b = data[k : k + _CHUNK + 2].astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        letter = (b[1:-1] >= 128) | (b[1:-1] - 97 < 26)
        yield ((code * np.uint32(0x27D4EB2F)) >> np.uint32(17))[letter]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def evidence(
    docs: DataFrame,
    declared: Column | None = None,
    host: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text, declared, host, suffix; an address without a dot has an empty suffix."""
    host = F.lit("") if host is None else F.coalesce(F.lower(host.cast("string")), F.lit(""))
    declared = F.lit("") if declared is None else F.coalesce(F.lower(declared.cast("string")), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.regexp_extract(declared, "^([a-z]+)", 1).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"\.([^.]*)$", 1).alias("suffix"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence from web pages (page_id, url, html): the markup's lang attribute, the host and the visible text.

    Null pages have an empty text, null addresses an empty host; repeated pages give a row each, of which each
    counts; ids may be null; other columns are not read.
    """
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return evidence(
        pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), "url", "html"),
        declared=F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)", 1),
        host=F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1),
    )


def declared_languages(rows: DataFrame) -> tuple[str, ...]:
    """The languages that `LEAST_ROWS` rows and a share of `LEAST_SHARE` declare, most rows first, then by name."""
    counts = rows.filter("declared <> '' AND declared <> 'und'").groupBy("declared").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    enough = counts.filter(F.col("n") >= max(LEAST_ROWS, LEAST_SHARE * total))
    return tuple(r.declared for r in enough.orderBy(F.desc("n"), "declared").limit(MOST_LANGUAGES).collect())


def others_level(model: np.ndarray) -> np.ndarray:
    """For each language: the log-probability of a trigram of another language's text, by `model`'s own counts."""
    share = np.exp(model)
    fit = share.T @ model  # [texts of, under]
    own, n = np.diag(fit), fit.shape[0]
    foreign = (fit.sum(axis=0) - own) / (n - 1) if n > 1 else np.full(n, -np.log(BUCKETS))
    return own + _FOREIGN * (foreign - own)


def train(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log-probabilities [bucket, language], counted over all rows that declare one of the languages.

    Tasks count in arrays of BUCKETS numbers and hand over their sums; the driver gets BUCKETS rows a language
    at most, whatever the corpus.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for text, declared in zip(batch["text"], batch["declared"]):
                k = languages.index(declared)
                for codes in trigrams(text):
                    counts[k] += np.bincount(codes, minlength=BUCKETS)
        k, code = np.nonzero(counts)
        yield pd.DataFrame({"k": k.astype(np.int32), "code": code.astype(np.int32), "n": counts[k, code]})

    declared = rows.filter(F.col("declared").isin(*languages)).select("text", "declared")
    summed = declared.mapInPandas(kernel, "k int, code int, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in summed.collect():
        counts[r.code, r.k] += r.n
    return np.log(counts / counts.sum(axis=0))


def text_scores(rows: DataFrame, model: np.ndarray, languages: tuple[str, ...]) -> DataFrame:
    """doc_id, row, declared, host, suffix, lettered, lik (log-likelihoods less the largest, by language, and last
    that of the others)."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the corpus
    others = others_level(model)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = held.value
        for batch in batches:
            lik = np.zeros((len(batch), len(languages) + 1))
            for k, text in enumerate(batch["text"]):
                count = 0
                for codes in trigrams(text) if text else ():
                    lik[k, :-1] += table[codes].sum(axis=0)
                    count += len(codes)
                lik[k, -1] = count * others[lik[k, :-1].argmax()]
            lik = np.round((lik - lik[:, :-1].max(axis=1, initial=-np.inf, keepdims=True)) / _TEMPER, 9)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "declared": batch["declared"],
                    "host": batch["host"],
                    "suffix": batch["suffix"],
                    "lettered": [_has_letter(t) for t in batch["text"]],
                    "row": [xxhash.xxh64_intdigest(t) - (1 << 63) for t in batch["text"]],
                    "lik": list(lik),
                }
            )

    return rows.mapInPandas(
        kernel,
        "doc_id long, declared string, host string, suffix string, lettered boolean, row long, lik array<double>",
    )


def _with_counts(rows: DataFrame, scored: DataFrame, by: str, prefix: str, n: int) -> DataFrame:
    """The rows with how many of `scored` with the same value of `by` are decided for each language."""
    best = F.when(F.col("decided"), F.col("best"))
    counts = scored.groupBy(by).agg(
        F.count("*").alias("n"), *[F.count(F.when(best == k, 1)).alias(f"{prefix}{k}") for k in range(n)]
    )
    return spread_join(rows, counts, by, how="left")


def identify(
    rows: DataFrame,
    languages: tuple[str, ...] | None = None,
    strength: float = 20.0,
    least: float = 0.5,
    other: float = OTHER,
) -> DataFrame:
    """doc_id, language, posterior, text_language, declared, kept, row for each row of `evidence`.

    `languages` are those that the rows declare (`declared_languages`) if not given.  `strength` is how many rows
    of its own outweigh what a host takes over from its suffix, and a suffix from the corpus; `other` is the prior
    of a language that is none of them.  A row is kept unless its text has no letter, that class is the likeliest,
    or no language reaches the posterior `least`; those have language `und`, and `posterior` is of the language.

    Null and empty texts have no letter; very long ones are read whole.  A declared language outside `languages`, or
    none, is a value like any other: it tells as much as the rows that declare it agree.  Ties go to the earlier
    language.  Repeated rows get a result each; an empty table gives an empty result, and where no language is
    declared often enough all rows are `und`.
    """
    languages = declared_languages(rows) if languages is None else languages
    if not languages:
        return rows.select(
            "doc_id",
            F.lit("und").alias("language"),
            F.lit(0.0).alias("posterior"),
            F.lit("und").alias("text_language"),
            "declared",
            F.lit(False).alias("kept"),
            F.xxhash64("text").alias("row"),
        )
    n = range(len(languages))
    scored = text_scores(rows, train(rows, languages), languages)
    # Evidence of hosts and declarations is counted over rows whose own text decides, in whole numbers.
    best = "array_position(slice(lik, 1, {0}), array_max(slice(lik, 1, {0}))) - 1".format(len(languages))
    scored = scored.withColumn("best", F.expr(best).cast("int"))
    scored = cut(
        scored.withColumn("decided", F.col("lettered") & F.expr("size(filter(lik, x -> x > -2.0)) = 1")), "language"
    )
    total = scored.filter("decided").agg(
        *[F.sum((F.col("best") == k).cast("long")).alias(f"t{k}") for k in n],
        F.count_distinct("declared").alias("kinds"),
    ).first()
    overall = [((total[f"t{k}"] or 0) + 1.0) for k in n]
    prior = [F.lit(x / sum(overall)) for x in overall]
    joined = scored
    for by, prefix in (("declared", "d"), ("suffix", "s"), ("host", "h")):
        joined = _with_counts(joined, scored, by, prefix, len(languages))
    joined = joined.na.fill(0, [f"{level}{k}" for level in "dsh" for k in n])

    def smoothed(level: str, above: list[Column]) -> list[Column]:
        held = reduce(lambda a, b: a + b, [F.col(f"{level}{k}") for k in n])
        return [(F.col(f"{level}{k}") + strength * above[k]) / (held + strength) for k in n]

    joined = joined.withColumns({f"ps{k}": c for k, c in enumerate(smoothed("s", prior))})
    joined = joined.withColumns({f"ph{k}": c for k, c in enumerate(smoothed("h", [F.col(f"ps{k}") for k in n]))})
    kinds = float(total["kinds"] or 0) + 1.0
    logs = [
        F.get("lik", F.lit(k)) + F.log((F.col(f"d{k}") + 1.0) / (overall[k] + kinds)) + F.log(f"ph{k}") for k in n
    ]
    # Of other languages it is unknown what they declare and which hosts they have.
    logs.append(F.get("lik", F.lit(len(languages))) + F.log(F.lit(other / kinds)))
    joined = joined.withColumn("logs", F.array(*logs))
    joined = joined.withColumn("at", F.expr(best.replace("lik", "logs")).cast("int"))
    share = F.expr("exp(logs[at] - array_max(logs)) / aggregate(logs, 0D, (a, x) -> a + exp(x - array_max(logs)))")
    names = F.array(*map(F.lit, languages))
    joined = joined.withColumn("posterior", F.round(share, 6))
    known = F.get("logs", "at") == F.array_max("logs")
    kept = F.col("lettered") & known & (F.col("posterior") >= least)
    return joined.select(
        "doc_id",
        F.when(kept, F.get(names, "at")).otherwise("und").alias("language"),
        "posterior",
        F.when(F.col("lettered"), F.get(names, "best")).otherwise("und").alias("text_language"),
        "declared",
        kept.alias("kept"),
        "row",
    )
