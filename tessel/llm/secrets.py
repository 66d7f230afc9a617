"""Secret scan with corpus-wide ownership frequency.

Candidates come from three fixed patterns and, besides, from any long token of mixed characters.  Each
candidate's hash is counted over the distinct repositories and owners that hold it.  A value that many owners
hold is an example that people copy; one that a single owner holds and that looks random is a live credential.
Long tokens count as secrets only with that evidence: they are the spans (kind `owned`) which the method adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, spread_join
from tessel.llm.spans import Span, digest, joined, overlaps, replaced

KINDS = ("assign", "access", "hex")
# The patterns of the base kinds.
_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of [0-9a-f]+ that have 24 characters or more: a shorter run has no longer one in it.
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed; leftmost and non-overlapping in each kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[1]) >= 6:
                found.append((m.start(), 0, m.end(), m[1]))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 20:
                found.append((m.start(), 1, m.end(), m[0]))
    for m in _HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m[0]))
    return [(KINDS[k], a, b, v) for a, k, b, v in sorted(found)]


def bits(value: str) -> float:
    """Shannon entropy of a value's characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str, least_bits: float) -> bool:
    """Letters and digits both, and as spread out as a generated value."""
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value)) and bits(value) >= least_bits


def candidates(text: str, least_bits: float) -> list[tuple[str, int, int, str]]:
    """The base spans, then the long random-looking tokens that touch none of them."""
    base = base_spans(text)
    taken = [(k, a, b) for k, a, b, _ in base]
    extra = [
        ("owned", m.start(), m.end(), m[0])
        for m in _LONG.finditer(text)
        if looks_random(m[0], least_bits) and not overlaps(m.start(), m.end(), taken)
    ]
    return base + extra


_FOUND = (
    "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string,"
    " row long, found array<struct<kind:string,start:long,end:long,hash:long,random:boolean>>"
)
_NAMES = ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "row", "found"]


def signed_hash(value: str) -> int:
    """A 64-bit hash in the range of a long."""
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def scan(
    docs: DataFrame,
    owner: str = "source",
    repo: tuple[str, ...] = ("source", "lang"),
    least_bits: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each row's candidates with the hashes of their values."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                found = candidates(r.text, least_bits)
                base = [(k, a, b) for k, a, b, _ in found if k != "owned"]
                n = Counter(k for k, _, _ in base)
                each = [(k, a, b, signed_hash(v), looks_random(v, least_bits)) for k, a, b, v in found]
                counts = n["assign"], n["access"], n["hex"]
                out.append((r.doc_id, r.owner, r.repo, *counts, digest(base), signed_hash(r.text), each))
            yield pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.to_json(F.array(*[F.col(c).cast("string") for c in repo])).alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(kernel, _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """hash, repos, owners, documents: distinct holders of each candidate's value over the whole corpus.

    Documents are distinct texts, so that exact copies of one count once.  (hash, owner, repo, text) is made distinct
    first, task by task.
    """
    each = found.select("row", "owner", "repo", F.explode("found").alias("f")).select(
        F.col("f.hash").alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), "repo", "row"
    )
    held = each.distinct()
    repos = held.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    owners = repos.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))
    texts = held.select("hash", "row").distinct().groupBy("hash").agg(F.count("*").alias("documents"))
    return owners.join(texts, "hash")


def find_secrets(
    docs: DataFrame,
    owner: str = "source",
    repo: tuple[str, ...] = ("source", "lang"),
    example_owners: int = 3,
    example_repos: int = 3,
    example_documents: int = 5,
    least_bits: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, held.

    `spans` has the base spans and, of kind `owned`, the long random-looking tokens that one owner alone holds.
    A value that `example_owners` owners, `example_repos` repositories or `example_documents` distinct texts or more
    hold counts as an example, within one owner too; a random-looking one of the others that a single owner holds
    counts as live; the rest are neither.  `held` has repos:owners:documents of each span's value.  Counts equal to
    a threshold reach it.  A null owner is an owner of its own.  Null and empty texts have no spans; very long ones
    are scanned whole; repeated rows are scanned each, and their values count once for each repository.  An empty
    table gives an empty result; other columns are not read.
    """
    found = cut(scan(docs, owner, repo, least_bits, id_col, text_col), "secrets")
    spans = found.filter(F.size("found") > 0).select("doc_id", "row", F.explode("found").alias("f"))
    spans = cut(spans.withColumn("hash", F.col("f.hash")).distinct(), "secret-spans")
    counted = ownership(found).join(spans.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    judged = (
        spread_join(spans, counted, "hash")
        .withColumn(
            "verdict",
            F.when(
                (F.col("owners") >= example_owners)
                | (F.col("repos") >= example_repos)
                | (F.col("documents") >= example_documents),
                "example",
            )
            .when((F.col("owners") == 1) & F.col("f.random"), "live")
            .otherwise("shared"),
        )
        .filter("f.kind <> 'owned' OR verdict = 'live'")
    )
    order = F.expr("CASE f.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END")
    lists = judged.groupBy("doc_id", "row").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("f.start").alias("start"),
                    order.alias("place"),
                    F.col("f.end").alias("end"),
                    F.col("f.kind").alias("kind"),
                    "verdict",
                    F.concat_ws(":", "repos", "owners", "documents").alias("held"),
                )
            )
        ).alias("spans")
    )
    base = found.drop("found", "owner", "repo")
    same = base["doc_id"].eqNullSafe(lists["doc_id"]) & (base["row"] == lists["row"])
    text = F.array_join(F.expr("transform(spans, s -> concat_ws(':', s.kind, s.start, s.end))"), ",")
    count = "cast(coalesce(size(filter(spans, s -> s.verdict = '{}')), 0) as long)"
    return base.join(lists, same, "left").select(
        base["doc_id"],
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(text, F.lit("")).alias("spans"),
        F.expr(count.format("live")).alias("n_live"),
        F.expr(count.format("example")).alias("n_example"),
        F.coalesce(F.array_join(F.col("spans.held"), ","), F.lit("")).alias("held"),
    )


def redacted(text: str | None, spans: str) -> str:
    """The text with each span of a `spans` string masked by its kind."""
    parts: list[Span] = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
    return replaced(text or "", [(a, b, f"[{k.upper()}]") for k, a, b in parts])
