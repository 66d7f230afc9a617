"""Personal data, and terms of the text around it that give it away.

Fixed patterns find the entities to protect.  How much a term reveals of an entity is estimated from the
corpus: the pointwise mutual information of the term and the entity's contexts, as a share of the information
that the entity itself carries.  Terms over the thresholds are generalised or removed with the entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, spread_join
from tessel.llm.spans import digest, joined, overlaps, replaced

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The patterns of the kinds.  Possessive where giving back could not lead to a match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGE = ".,;:!?()[]{}\"'|*#$%&"
_SPACE = r"[\x20\x09-\x0D]+"


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at - (at - low - len(text[low:at].rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost and non-overlapping in each kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def entity(kind: str, value: str) -> str:
    """What makes two spellings one entity."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def context(text: str, start: int, end: int, words: int) -> list[tuple[str, int, int]]:
    """Up to `words` words on either side of a span, as (word without marks at its ends, start, end)."""
    before: list[tuple[str, int, int]] = []
    reach = 64 * words  # characters looked at first; doubled until there are words enough or no text is left
    while True:
        low = max(0, start - reach)
        before = [(m[0], low + m.start(), low + m.end()) for m in _WORD.finditer(text[low:start])]
        if low == 0 or len(before) > words:
            break
        reach *= 2
    after, at = [], end
    while len(after) < words and (m := _WORD.search(text, at)):
        after.append((m[0], m.start(), m.end()))
        at = m.end()
    out = []
    for w, a, b in before[-words:] + after:
        left, core = len(w) - len(w.lstrip(_EDGE)), w.strip(_EDGE)
        if core:
            out.append((core, a + left, a + left + len(core)))
    return out


_FOUND = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string,"
    " around array<struct<entity:long,context:long,words:array<struct<w:string,start:long,end:long>>>>"
)
_NAMES = ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "around"]


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def scan(docs: DataFrame, window: int = 10) -> DataFrame:
    """Each row's base spans and the words around them; `docs` has doc_id, row (a key of the text) and text."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                base, around = base_spans(text), []
                for kind, a, b in base:
                    inside = [(x, y) for _, x, y in base]
                    words = [w for w in context(text, a, b, window) if not any(w[1] < y and x < w[2] for x, y in inside)]
                    seen = _hash(" ".join(w for w, _, _ in words).lower())
                    around.append((_hash(entity(kind, text[a:b])), seen, words))
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((i, row, *counts, digest(base), joined(base), around))
            yield pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    return docs.mapInPandas(kernel, _FOUND)


def disclosure(found: DataFrame, docs: DataFrame, window: int, support: int, z: float) -> DataFrame:
    """(entity, term, share): how much of an entity's information a term gives away, at most 1.

    A context is a distinct stretch of words around the entity, so that copies of a document count once.
    share = log2(p(term | context of the entity) / p(term)) / -log2 p(entity), where p(term) is the chance that
    a stretch of as many words holds the term, from its count over the whole corpus, and p(term | context) is the
    lower bound of Wilson's interval at `z` deviations, so that few contexts say less than many.  A term in fewer
    than `support` of them is no more than what happens to stand there.
    """
    stretch = 2 * window
    each = found.select(F.explode("around").alias("a")).select("a.entity", "a.context", "a.words")
    contexts = each.groupBy("entity", "context").agg(F.first("words").alias("words"))
    terms = contexts.select("entity", "context", F.explode("words").alias("w")).select(
        "entity", "context", F.lower("w.w").alias("term")
    )
    pairs = terms.distinct().groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    alone = contexts.groupBy("entity").agg(F.count("*").alias("alone"))
    pairs = cut(pairs.join(alone, "entity"), "pii-pairs")
    # Counted task by task before they are joined: a word as common as "the" is a row of each task.
    words = docs.select(F.explode(F.split("text", _SPACE)).alias("w")).select(F.lower(F.btrim("w", F.lit(_EDGE))).alias("term"))
    counts = cut(words.filter("term <> ''").groupBy("term").agg(F.count("*").alias("n")), "pii-words")
    total = counts.agg(F.sum("n").alias("total"))
    chance = F.least(F.lit(1.0), F.col("n") * stretch / F.col("total"))
    carried = -F.log2(F.least(F.lit(0.5), F.col("alone") * stretch / F.col("total")))
    p, n, zz = F.col("both") / F.col("alone"), F.col("alone"), z * z
    given = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return (
        pairs.join(counts, "term")
        .crossJoin(F.broadcast(total))  # one row
        .select("entity", "term", (F.log2(given / chance) / carried).alias("share"))
    )


def term_spans(text: str, shares: dict[str, float], remove: float) -> list[tuple[str, int, int]]:
    """All places of the terms outside the base spans: kind `term`, then kind `drop`, each by start."""
    base = base_spans(text)
    found = []
    for m in _WORD.finditer(text):
        core = m[0].strip(_EDGE)
        share = shares.get(core.lower())
        if share is not None:
            start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            if not overlaps(start, start + len(core), base):
                found.append(("drop" if share >= remove else "term", start, start + len(core)))
    return sorted(found, key=lambda x: (x[0] == "drop", x[1]))


def protect(
    docs: DataFrame,
    window: int = 10,
    support: int = 2,
    generalise: float = 0.7,
    remove: float = 0.9,
    z: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    `spans` has the base spans by kind and start, then, wherever they stand in a text that holds the entity, the
    terms whose share of its information reaches `generalise` (kind `term`) or `remove` (kind `drop`); see
    `disclosure`.  A term of several entities counts by its largest share; a share equal to a threshold reaches it.
    Null and empty texts have no spans; very long ones are scanned whole; repeated rows get a result row each and
    count as one context; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    found = cut(scan(rows, window), "pii")
    telling = disclosure(found, rows, window, support, z).filter(F.col("share") >= generalise)
    by_entity = telling.groupBy("entity").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    # What a text's terms are depends on the text alone, so that copies of it are one.
    held = cut(found.filter(F.size("around") > 0).select("row", F.explode("around.entity").alias("entity")).distinct(), "pii-held")
    by_entity = by_entity.join(held.groupBy("entity").agg(F.count("*").alias("n")), "entity")
    each = spread_join(held, by_entity, "entity").select("row", F.explode("terms").alias("t"))
    flagged = each.groupBy("row", "t.term").agg(F.max("t.share").alias("share")).groupBy("row")
    flagged = cut(flagged.agg(F.collect_list(F.struct("term", "share")).alias("terms")), "pii-terms")
    texts = rows.join(flagged, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("terms").alias("terms"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [
                term_spans(text, {t["term"]: t["share"] for t in terms}, remove) for text, terms in zip(batch["text"], batch["terms"])
            ]
            yield pd.DataFrame({"row": batch["row"], "added": list(map(joined, spans)), "n_terms": list(map(len, spans))})

    marked = cut(texts.mapInPandas(kernel, "row long, added string, n_terms long"), "pii-spans")
    marked = found.groupBy("row").agg(F.count("*").alias("n")).join(marked.filter("n_terms > 0"), "row")
    return spread_join(found.drop("around"), marked, "row", how="left").select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "added").alias("spans"),
        F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"),
    )


def _general(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitised(text: str | None, spans: str) -> str:
    """The text with entities masked by kind, terms generalised to their class, and the most telling removed."""
    text = text or ""
    parts = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
    new = {"drop": lambda w: "", "term": _general}
    return replaced(text, [(a, b, new[k](text[a:b]) if k in new else f"[{k.upper()}]") for k, a, b in parts])
