"""The corpus operators against brute force, round trips and the edge cases they define."""

import math
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import decontam, langid, linededup, piecedrop, quality, registry, sharding, simhash, tokenfiles, wordmodel
from tessel.llm.common import vocabulary
from tessel.llm.components import connected

LONG = " ".join(f"w{k % 997}x" for k in range(60_000))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    line = "A line that is long enough to count as a line of its own, really"
    rows = [
        (1, "one two three four five", "en", "s"),
        (1, "one two three four five", "en", "s"),
        (2, None, None, None),
        (3, "", "en", "s"),
        (4, LONG, "xx", "s"),
        (None, "no id here at all", "en", None),
        (None, None, None, None),
        (5, "\x02 \x03 \x0b\x0c ﻿ ▁ \U0001f600", "", "t"),
        *[(10 + k, f"{line}\nown {k}\n  {line.upper()}  ", "en", "s") for k in range(6)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.selectExpr(
        "*", "'a' AS fp", "1 AS size", "2 AS component_id", "'b' AS row", "'c' AS n_words", "3 AS declared", "'d' AS ids"
    ).repartition(3)


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "lines": linededup.dedupe_lines,
    "shards": lambda d: sharding.shard_documents(d, shards=4, slots=64),
    "pieces": lambda d: piecedrop.encode_documents(d, vocabulary("piece_bpe_32k.model")),
    "tokens": lambda d: tokenfiles.round_trip(d, vocabulary("byte_bpe_50k.json")),
    "quality": quality.judge,
    "language": lambda d: langid.identify(langid.evidence(d, F.col("lang"), F.col("source"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases_give_a_row_each(edge, name):
    found = OPERATORS[name](edge).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in edge.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(edge, name):
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(40)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected(spark.range(500).toDF("v"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.v: r.component for r in got} == {v: root(v) for v in range(500)}


def brute_groups(rows):
    prints = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], i)
    return {i: (f"{prints[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("bucket", [128, 1])
def test_simhash_groups(spark, sf_dir, bucket):
    """With `bucket` 1 every shared bucket goes the way of the large ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rng = random.Random(1)
    words = LONG.split()[:400]
    for k in range(60):  # a family of near copies
        near = list(words)
        for _ in range(rng.randrange(6)):
            near[rng.randrange(400)] = f"z{rng.randrange(9)}"
        rows.append((10_000 + k, " ".join(near)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute_groups(rows)


@pytest.mark.parametrize("bucket", [1, 6, 128])
def test_links_of_hot_buckets(spark, bucket):
    """Fingerprints that share much, in families that three bits part or join, with every size of bucket."""
    rng = random.Random(bucket)
    prints = set()
    for _ in range(12):
        low, high = rng.getrandbits(32), rng.getrandbits(32)
        for _ in range(40):
            x = high << 32 | low
            for _ in range(rng.choice([0, 1, 3, 3, 3, 5, 6, 9])):
                x ^= 1 << rng.choice([rng.randrange(64), 32 + rng.randrange(32), 32 + rng.randrange(16)])
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.component for r in connected(fps, simhash.links(fps, bucket)).collect()}
    seen = defaultdict(set)
    want = brute_links(np.array(prints, np.uint64))
    for k, x in enumerate(signed):
        seen[want[k]].add(got[x])
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len(set(got.values())) > 20


def brute_links(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(prints))]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_hot_keys_lose_and_double_nothing(spark, hot):
    from tessel.llm.common import spread_join

    big = spark.createDataFrame([(k % 5 if k < 60 else None, k) for k in range(80)], "k int, x int")
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    got = spread_join(big, small, "k", hot=hot).collect()
    assert sorted((r.k, r.x, r.m) for r in got) == sorted((k % 5, k, 55 + k % 5) for k in range(60))
    left = spread_join(big, small.filter("k < 2"), "k", how="left", hot=hot)
    assert left.count() == 80 and left.filter("m IS NOT NULL").count() == 24


def test_plain_fingerprint():
    import xxhash

    text = "The quick\tBrown fox jumps OVER the lazy dog É"
    w = "the quick brown fox jumps over the lazy dog É".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    assert simhash.fingerprint("One  two") == xxhash.xxh64_intdigest(b"one two", 42) and simhash.fingerprint(" ") == 0


def test_line_dedup_brute(spark, edge):
    rows = [(r.doc_id, r.text or "") for r in edge.collect() if r.doc_id is not None]
    held = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in t.split("\n"):
            held[key(x)].add(i)
    want = Counter()
    for i, t in rows:
        kept = [x for x in t.split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or i == max(held[key(x)])]
        want[i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)] += 1
    got = linededup.dedupe_lines(edge).filter("doc_id IS NOT NULL").collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want


def test_token_files(spark, sf_dir):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, at = tokenfiles.round_trip(docs, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect(), 0
    for r, d in zip(got, docs.orderBy("doc_id").collect()):
        ids = np.array([*model.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_units_change_no_ids():
    from tokenizers import Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(2)
    enc, model = tokenfiles.Encoder(path), Tokenizer.from_file(path)
    parts = list("ab1!'s .,") + ["\n", "\t", "\xa0", " ", "\x1c", "é", "漢", "<|endoftext|>", "'ll", "  ", "×", "Foo"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, enc.dtype).tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_slot_maps(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(pow(id % 13, 3) as int)) AS text")
    got = sharding.shard_documents(docs, shards=7, slots=256, store=f"file://{tmp_path}").collect()
    sizes, places = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) < max(r.size for r in got)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 7
    first, last = (sharding.SlotMap.load(spark, f"file://{tmp_path}", 7, v) for v in (0, 1))
    for version, slot, a, b in last.edits:
        assert version == 1 and first.owner[slot] == a
        first.owner[slot] = b
    assert first.owner == last.owner


def test_decontamination_brute(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    tests = {r.item_id: decontam.shingles(decontam.words(r.text), 5) for r in items.collect()}
    want = set()
    for d in docs.collect():
        held = decontam.shingles(decontam.words(d.text), 5)
        want |= {(d.doc_id, i) for i, s in tests.items() if len(s & held) >= 0.8 * len(s)}
    for index_words in (200_000, 400):  # one index, then many blocks
        got = decontam.contamination(docs, items, index_words=index_words)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    nothing = items.selectExpr("item_id", "cast(null as string) AS text")
    assert decontam.contamination(docs, nothing).count() == 0
    assert decontam.contamination(docs, items.limit(0)).count() == 0 == decontam.contamination(docs.limit(0), items).count()


def test_decontamination_edges(spark, edge):
    rows = [(1, "One two, three four FIVE"), (2, None), (3, ""), (None, "no id here at all"), (1, "one two three four five")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS i", "2 AS t", "3 AS doc_id")
    got = decontam.contamination(edge, items).collect()
    # Both spellings of item 1 are found in both rows of document 1.
    assert Counter((r.doc_id, r.item_id) for r in got) == {(1, 1): 4}


def plain_leaks(docs, items, window=64, threshold=0.6, question=0.8, answer=0.8, shingle=5):
    """(doc, item) -> (score, overlaps), by BM25 of every passage and every piece, from dictionaries."""
    half, pieces = window // 2, []
    for i, t in items:
        ws = decontam.words(t)
        pieces += [(i, t, Counter(p)) for p in decontam.pieces_of(ws, half)]
    mean = sum(p.total() for _, _, p in pieces) / len(pieces)
    held = Counter(w for _, _, p in pieces for w in p)
    weighed = []
    for i, t, p in pieces:
        own = {w: decontam.weights(f, p.total(), held[w], len(pieces), mean, 1.2, 0.75) for w, f in p.items()}
        weighed.append((i, t, {w: x / sum(own.values()) for w, x in own.items()}))
    out = {}
    for d, text in docs:
        ws = decontam.words(text)
        places, best = defaultdict(set), defaultdict(float)
        for k in range(max(1, -(-len(ws) // half) - 1)):
            seen = set(ws[k * half : k * half + window])
            for i, t, p in weighed:
                score = round(sum(x for w, x in p.items() if w in seen), 9)
                if score >= threshold:
                    places[i, t].add(k * half)
                    best[i, t] = max(best[i, t], score)
        for (i, t), starts in places.items():
            it, found = decontam.parse_item(t, shingle), []
            for s in starts:
                near = ws[max(0, s - it.length) : s + window + it.length]
                q = len(it.question & decontam.shingles(near, it.shingle)) / max(1, len(it.question))
                a = sum((it.answer & Counter(near)).values()) / it.answer.total() if it.answer else 1.0
                found.append((q >= question and a >= answer, (q, a)))
            ok, over = max(found)
            if ok:
                out[d, i] = (best[i, t], *over)
    return out


def altered_passages(rng, items, n):
    """Texts around items of which some words are dropped or changed."""
    docs = []
    for k in range(n):
        ws = rng.choice(items)[1].split()
        keep = [w if rng.random() > 0.1 else "changed" for w in ws if rng.random() > rng.choice([0, 0.05, 0.4])]
        filler = [rng.choice(rng.choice(items)[1].split()) for _ in range(rng.randint(0, 300))]
        at = rng.randint(0, len(filler))
        docs.append((k, " ".join(filler[:at] + keep + filler[at:])))
    return docs


@pytest.mark.parametrize("question", [0.8, 0.2])
def test_decontamination_equals_plain_bm25(spark, sf_dir, question):
    """Scores, overlaps and verdicts of altered passages, in one index and in many."""
    rng = random.Random(21)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:40]
    items += [(900 + k, " ".join(rng.choices(items[k][1].split(), k=rng.choice([1, 2, 5, 150])))) for k in range(20)]
    docs = altered_passages(rng, items, 150) + [(999, " ".join(t for _, t in items) + " tail" * 70_000 + items[3][1])]
    want = plain_leaks(docs, items, question=question)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 60
    for index_words in (200_000, 300):
        got = {
            (r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap)
            for r in decontam.contamination(*frames, question=question, index_words=index_words).collect()
        }
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_pivots_lose_nothing():
    """The walk against the sum of all postings, at thresholds from next to nothing up."""
    import pandas as pd

    rng = random.Random(9)
    names = [f"t{k}".encode() for k in range(80)]
    rows = []
    for piece in range(120):
        own = rng.sample(names, rng.randint(1, 20))
        rows += [(piece, w, rng.random() / len(own)) for w in own]
    postings = pd.DataFrame(rows, columns=["piece", "term", "weight"])
    index = decontam.Index([0], [], np.zeros(120, np.int64), postings, 32, 4)
    lists = [rng.choices([*names, b"other"], k=rng.randint(0, 200)) for _ in range(30)]
    passage, term, firsts = index.passages(lists)
    want = {}
    for first, ws in zip(firsts.tolist(), lists):
        for k in range(max(1, -(-len(ws) // 16) - 1)):
            seen = set(ws[16 * k : 16 * k + 32])
            for piece in range(120):
                want[first + k, piece] = sum(x for p, w, x in rows if p == piece and w in seen)
    for threshold in (0.01, 0.2, 0.4):
        got = {(p, k): s for p, k, s in zip(*(x.tolist() for x in index.retrieve(passage, term, threshold)))}
        assert got.keys() == {x for x, s in want.items() if round(s, 9) >= threshold} and got
        assert all(math.isclose(got[x], want[x], abs_tol=1e-8) for x in got)


def test_pieces():
    import sentencepiece

    path, rng = vocabulary("piece_bpe_32k.model"), random.Random(3)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, dropped = piecedrop.PieceCoder(path, 0.0), piecedrop.PieceCoder(path, 0.2)
    parts = list("abcdethe .,!'\n\t") + ["  ", "é", "漢", "😀", "the ", "ing", "\xa0", "<s>", "<0x41>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [x.tolist() for x in plain.encode(texts, [0] * len(texts))] == model.encode(texts)
    texts = [t + rng.choice(["", "▁", " ▁ ▁"]) for t in texts] + [LONG]
    ids = dropped.encode(texts, list(range(len(texts))))
    assert [dropped.decode(x.tolist()) for x in ids] == texts
    again = piecedrop.PieceCoder(path, 0.2).encode(texts[::-1], list(range(len(texts)))[::-1])[::-1]
    assert all(np.array_equal(a, b) for a, b in zip(ids, again))
    # Each occurrence of a unit is what its own agenda gives with its own draws, long units too.
    for rate in (0.05, 0.2, 0.7, 1.0):
        c = piecedrop.PieceCoder(path, rate)
        for salt, text in enumerate([*texts[:400], "interesting " * 40, "x" * 70 + "interesting" * 9, LONG[:3000]]):
            units = c.unit.findall(piecedrop._normal(text)) if text else []
            keys = piecedrop._keys(salt, 0, len(units)).tolist()
            want = [i for u, k in zip(units, keys) for i in c.segment(u, k)]
            assert c.encode([text], [salt])[0].tolist() == want, (rate, text)


def test_every_occurrence_draws(spark):
    """A frequent word has far more segmentations than courses could be dealt out beforehand, on any partitioning."""
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.range(1000).selectExpr("id AS doc_id", "'considering international considerations' AS text")
    rows = piecedrop.encode_documents(docs.repartition(3), path, 0.1, 42).collect()
    assert len({tuple(r.ids) for r in rows}) > 150 and all(r.lossless for r in rows)
    plain = piecedrop.encode_documents(docs.limit(1), path, 0.0).first().ids
    assert 50 < sum(r.ids == plain for r in rows) < 600
    other = piecedrop.encode_documents(docs.repartition(7, "doc_id"), path, 0.1, 42).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in rows} == {(r.doc_id, tuple(r.ids)) for r in other}
    assert {(r.doc_id, tuple(r.ids)) for r in rows} != {(r.doc_id, tuple(r.ids)) for r in piecedrop.encode_documents(docs, path, 0.1, 43).collect()}
    # The rate is that of the candidates: a word of one merge is skipped in a tenth of its occurrences.
    c = piecedrop.PieceCoder(path, 0.1)
    unit = next(u for u in ("▁t", "▁a", "▁w") if c.courses([u], [()])[1][0] == 1)
    cut = sum(len(x) > 4 for x in c._encode([unit] * 20_000, piecedrop._keys(5, 0, 20_000)))
    assert 1800 < cut < 2200


def test_courses_are_forgotten_and_learnt_again(monkeypatch):
    path, rng = vocabulary("piece_bpe_32k.model"), random.Random(8)
    texts = [" ".join(rng.choice(LONG.split()) + rng.choice(["", "ing", "ation"]) for _ in range(30)) for _ in range(60)]
    want = piecedrop.PieceCoder(path, 0.3).encode(texts, list(range(60)))
    monkeypatch.setattr(piecedrop, "CACHE_UNITS", 40)
    monkeypatch.setattr(piecedrop, "CACHE_COURSES", 30)
    small = piecedrop.PieceCoder(path, 0.3)
    assert all(np.array_equal(small.encode([t], [k])[0], w) for k, (t, w) in enumerate(zip(texts, want)))


def test_courses_of_units_of_all_lengths():
    """Ids and merges lie end to end in the units' order, and lists of ids are decoded in one go."""
    c = piecedrop.PieceCoder(vocabulary("piece_bpe_32k.model"), 0.0)
    units = ["▁the", "漢", "▁interesting", "▁", "x" * 64, "▁é😀a", "▁considerations"]
    ids, times, codes, n_ids = c.courses(units, [()] * len(units))
    ends = np.cumsum(n_ids)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, n_ids)] == [c.segment(u) for u in units]
    # What a unit skips is not among its merges.
    last = codes[np.cumsum(times) - 1].tolist()
    skips = [(code,) if n else () for code, n in zip(last, times)]
    shorter, n_merges, others, n_shorter = c.courses(units, skips)
    assert all(own[0] not in x for own, x in zip(skips, np.split(others, np.cumsum(n_merges)[:-1])) if own)
    assert sum(map(len, skips)) >= 4
    lists = np.split(shorter, np.cumsum(n_shorter)[:-1])
    assert c.decode_many(lists) == [u.replace("▁", " ")[1:] if u[0] == "▁" else c.decode(x) for u, x in zip(units, lists)]
    assert c.decode_many([]) == [] and c.decode_many([ids[:0], ids[:1]]) == ["", "the"]


def test_decode_documents(spark, sf_dir):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model")
    back = piecedrop.decode_documents(piecedrop.encode_documents(docs, path), path)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_base_metrics():
    text = "a b c\n\na b c\n x # a b c\n x # a b c"
    got = quality.base_metrics(text, text.encode().split())
    assert got == (16, 16, 2, 2, 16)
    assert quality.base_metrics("", []) == (0, 0, 0, 0, 0)


def plain_judgements(rows, few=wordmodel.FEW, below=18.0, above=6.0, least=0.02):
    """doc -> (log-perplexity, kept) of rows (doc, text, lang), from dictionaries of words."""
    by_lang = defaultdict(list)
    for i, text, lang in rows:
        by_lang[lang].append((i, text, text.split()))
    out, base = {}, {}
    for lang, texts in by_lang.items():
        pairs, count, copies = Counter(), Counter(), Counter(t for _, t, _ in texts)
        for _, _, ws in texts:
            pairs.update(zip([None, *ws], ws))
            count.update(ws)
        before = Counter(w for _, w in pairs)
        d1, d2 = (wordmodel.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (before, pairs))
        off = lambda n, d: min(n, [0, *d][min(n, 3)])
        contexts, left = sum(before.values()), sum(off(n, d1) for n in before.values()) / max(1, sum(before.values()))
        kept = {p: n for p, n in pairs.items() if n > few + 1}
        heads = defaultdict(float)
        for (h, _), n in kept.items():
            heads[h] += n - d2[2]
        for i, text, ws in texts:
            own = Counter(zip([None, *ws], ws))
            rest = {p: kept.get(p, 0) - n * copies[text] for p, n in own.items()}
            rest = {p: n if n > few else 0 for p, n in rest.items()}
            lost, seen = Counter(w for (_, w), n in rest.items() if not n), Counter()
            less = defaultdict(float)
            for p, n in own.items():
                seen[p[0]] += n * copies[text]
                if p in kept:
                    less[p[0]] += kept[p] - d2[2] - max(0, rest[p] - d2[2])
            total = 0.0
            for (h, w), n in own.items():
                c = before[w] - lost[w] if count[w] > 1 else 0
                chance = (c - off(c, d1)) / max(1, contexts - sum(lost.values())) + left / (len(count) + 1)
                t = (count[h] if count[h] > 1 else 0) - seen[h] if h is not None else 0
                if t > 0.5:
                    spare = min(1, max(0, 1 - max(0, heads[h] - less[h]) / t))
                    chance = max(0, rest[h, w] - d2[2]) / t + spare * chance
                total += n * math.log(chance)
            out[i] = -total / max(1, len(ws))
            n, repeated = len(ws), quality.base_metrics(text, text.encode().split())[4]
            base[i] = n < 50 or 100 * repeated > 50 * n
        long_ = [round(round(out[i], 4), 3) for i, _, ws in texts if len(ws) >= 50]
        if long_:
            q = np.percentile(long_, [25, 50, 75])
            low, high = q[0] - below * max(q[1] - q[0], least), q[2] + above * max(q[2] - q[1], least)
        for i, _, _ in texts:
            out[i] = out[i], not base[i] and low - 1e-9 <= round(out[i], 4) <= high + 1e-9
    return out


def test_perplexities_and_bands_equal_plain_ones(spark, sf_dir):
    """Over one square of pairs and over many."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in found] + [(90_000 + k, found[0].text, found[0].lang) for k in range(7)]
    rng = random.Random(12)
    rows.append((91_000, " ".join("".join(rng.choices(string.ascii_letters, k=7)) for _ in range(90)), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = plain_judgements(rows)
    for part_words in (wordmodel.PART_WORDS, 3000):
        got = {r.doc_id: r for r in quality.judge(docs, part_words=part_words).collect()}
        for i, (p, kept) in want.items():
            assert math.isclose(got[i].log_perplexity, p, abs_tol=2e-3) and got[i].kept == kept, i
    assert not got[91_000].kept and not got[91_000].base_failed


def plain_perplexities(rows):
    """doc -> log-perplexity of rows (doc, text, lang) under a modified Kneser-Ney model of all pairs, counted anew
    for each text from the others (the ends of a text and its copies stay in the number of times a word was seen)."""
    out = {}
    off = lambda n, d: [0, *d][min(n, 3)]
    for lang in {x for _, _, x in rows}:
        copies = Counter(text for _, text, x in rows if x == lang)
        own = {text: Counter(zip([None, *text.split()], text.split())) for text in copies}
        pairs = Counter()
        for text, k in copies.items():
            pairs.update({p: n * k for p, n in own[text].items()})
        words, before = {w for _, w in pairs}, Counter(w for _, w in pairs)
        d1, d2 = (wordmodel.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (before, pairs))
        left = sum(off(n, d1) for n in before.values()) / max(1, before.total())
        found = {}
        for text, k in copies.items():
            rest = {p: m for p, n in pairs.items() if (m := n - k * own[text][p])}
            heads, contexts, counts = Counter(), Counter(), Counter({text.split()[-1]: k} if text.split() else {})
            for (h, w), n in rest.items():
                heads[h] += n - off(n, d2)
                contexts[w] += 1
                counts[w] += n
            total = 0.0
            for (h, w), n in own[text].items():
                c, m = contexts[w], rest.get((h, w), 0)
                chance = (c - off(c, d1)) / max(1, len(rest)) + left / (len(words) + 1)
                if t := counts[h]:
                    chance = (m - off(m, d2)) / t + (1 - heads[h] / t) * chance
                total += n * math.log(chance)
            found[text] = -total / max(1, own[text].total())
        out |= {i: found[text] for i, text, x in rows if x == lang}
    return out


def test_no_pair_is_left_out(spark, sf_dir):
    """Pairs seen once to four times elsewhere count, each with its own discount."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_perplexities([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    for found in (registry.op5_perplexity(spark, sf_dir), quality.judge(docs, few=0, part_words=3000)):
        got = {r.doc_id: r.log_perplexity for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], p, abs_tol=1e-4) for i, p in want.items())


def test_packed_keys():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    n = rng.integers(0, 1 << 32, len(key))
    for k in (0, 1, len(key)):
        got = wordmodel.unpack(wordmodel.pack(key[:k], n[:k], n[:k]), 2)
        assert all(np.array_equal(a, b) for a, b in zip(got, (key[:k], n[:k], n[:k])))


def test_word_probabilities_sum_to_one(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choices(words, [*range(1, 13)], k=80)) for _ in range(40)]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    scorer = wordmodel.WordModel(wordmodel.build(rows, f"file://{tmp_path}"))
    after = [[b"w5", w.encode()] for w in [*words, "unseen"]]
    # No copy of these texts is in the counts.
    both, first = (scorer.scores("en", x, np.zeros(len(x), np.int64)) for x in (after, [x[:1] for x in after]))
    total = np.exp(both - first).sum()
    # What is left is the chance that the text ends after the word.
    heads = Counter(w for t in texts for w in t.split()[:-1])
    assert abs(total - 1) < 1e-2 and heads["w5"] > 100


def test_perplexity_rejects_junk_and_keeps_prose(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(7)
    words = max((r.text for r in docs.filter("lang = 'en'").collect()), key=len).split()[:300]
    noise = ["".join(rng.choices(string.ascii_letters, k=7)) for _ in words]
    half = [w if k % 2 else x for k, (w, x) in enumerate(zip(words, noise))]
    junk = spark.createDataFrame([(9998, " ".join(noise), "en", "s", 0), (9999, " ".join(half), "en", "s", 0)], docs.schema)
    got = {r.doc_id: r for r in quality.judge(docs.union(junk)).collect()}
    assert not got[9998].kept and not got[9998].base_failed
    assert not got[9999].kept and not got[9999].base_failed
    # The labels know good documents, nearly all of which stay, from bad ones, many of which are symbols and scraps.
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good, bad = ([got[i].kept for i, q in label.items() if q == k and not got[i].base_failed] for k in (1, 0))
    assert len(good) > 200 and sum(good) > 0.99 * len(good)
    assert len(bad) > 10 and sum(bad) < 0.7 * len(bad)


def test_language_evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "fr").otherwise(F.col("lang")))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(langid.evidence(wrong, F.col("lang"), F.col("source"))).collect()
    assert sum(r.language == truth[r.doc_id] for r in found) >= 0.95 * len(found)
    # A text that tells nothing takes what its host usually holds.
    rows = [(10_000 + k, docs_text, "", "h.example.fr") for k, docs_text in enumerate(r.text for r in docs.filter("lang = 'fr'").limit(20).collect())]
    rows.append((20_000, "Ok", "", "h.example.fr"))
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").union(more)
    got = {r.doc_id: r for r in langid.identify(langid.evidence(both, F.col("lang"), F.col("source"))).collect()}
    assert got[20_000].language == "fr"


FINNISH = """Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja
omatunto, ja heidan on toimittava toisiaan kohtaan veljeyden hengessa. Jokaisella on oikeus elamaan, vapauteen ja
henkilokohtaiseen turvallisuuteen, eika ketaan saa pitaa orjana tai orjuutettuna missaan muodossa."""


def test_other_languages_are_undetermined(spark, sf_dir):
    """Texts of languages that nobody declares, and letters at random, whatever they declare and where they stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(13)
    noise = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9))) for _ in range(60))
    texts = [FINNISH, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3, "人人生而自由在尊严和权利上一律平等" * 8, noise]
    rows = [(50_000 + k, x, ["en", "de", None, "fi"][k], "src0") for k, x in enumerate(texts)]
    both = docs.union(spark.createDataFrame(rows, docs.schema))
    got = {r.doc_id: r for r in langid.identify(langid.evidence(both, F.col("lang"), F.col("source"))).collect()}
    assert all(got[50_000 + k].language == "und" and not got[50_000 + k].kept for k in range(4))
    assert sum(r.kept for i, r in got.items() if i < 50_000) == len(got) - 4
    # The languages are those of the rows: enough texts of a fifth are a language too.
    more = spark.createDataFrame([(60_000 + k, " ".join(rng.sample(FINNISH.split(), 30)), "fi", "src1") for k in range(30)], docs.schema)
    evidence = langid.evidence(both.union(more), F.col("lang"), F.col("source"))
    assert set(langid.declared_languages(evidence)) == {"en", "de", "fr", "es", "fi"}
    got = {r.doc_id: r.language for r in langid.identify(evidence).collect()}
    assert got[50_000] == "fi" and all(got[60_000 + k] == "fi" for k in range(30))


def test_posteriors_equal_plain_fusion(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.concat(F.lit("h."), F.col("source"), F.lit(".x")))
    rows = langid.evidence(docs, F.col("lang"), F.col("source"))
    languages = langid.declared_languages(rows)
    model, n = langid.train(rows, languages), len(languages)
    data = rows.collect()
    counts = np.full((langid.BUCKETS, n), 0.5)
    for r in data:
        for codes in langid.trigrams(r.text):
            np.add.at(counts[:, languages.index(r.declared)], codes, 1)
    np.testing.assert_allclose(model, np.log(counts / counts.sum(axis=0)))
    others, liks, best, decided = langid.others_level(model), [], [], []
    for r in data:
        codes = np.concatenate(list(langid.trigrams(r.text)))
        lik = model[codes].sum(axis=0)
        best.append(int(lik.argmax()))
        lik = (np.append(lik, len(codes) * others[best[-1]]) - lik.max()) / 4
        liks.append(lik)
        decided.append(any(map(str.isalpha, r.text)) and (lik > -2).sum() == 1)
    tally = {c: defaultdict(lambda: np.zeros(n)) for c in ("declared", "suffix", "host")}
    overall, kinds = np.ones(n), len({r.declared for r, d in zip(data, decided) if d}) + 1
    for r, b, d in zip(data, best, decided):
        if d:
            overall[b] += 1
            for c in tally:
                tally[c][r[c]][b] += 1
    got = {r.doc_id: r for r in langid.identify(rows).collect()}
    for r, lik in zip(data, liks):
        suffix, host = tally["suffix"][r.suffix], tally["host"][r.host]
        at_suffix = (suffix + 20 * overall / overall.sum()) / (suffix.sum() + 20)
        at_host = (host + 20 * at_suffix) / (host.sum() + 20)
        logs = lik[:n] + np.log((tally["declared"][r.declared] + 1) / (overall + kinds)) + np.log(at_host)
        logs = np.append(logs, lik[n] + np.log(0.01 / kinds))
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert math.isclose(got[r.doc_id].posterior, share[:n].max(), abs_tol=2e-6)
        assert got[r.doc_id].kept == (share[:n].max() >= max(share[n], 0.5))


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = langid.page_evidence(pages)
    assert got.filter("declared = '' OR host = '' OR suffix = ''").count() == 0
    assert got.filter("text LIKE '%<%' OR text LIKE '%track(%'").count() == 0
    assert langid.identify(got).filter("language = declared").count() >= 0.9 * pages.count()


def test_perplexity_hears_word_order(spark):
    """Shuffled words have other perplexities, and copies of a text do not predict it."""
    rng = random.Random(11)
    names, follow = [f"w{k}o" for k in range(200)], {}
    for w in names:
        follow[w] = rng.sample(names, 3)
    texts = []
    for _ in range(60):
        words = [rng.choice(names)]
        while len(words) < 200:
            words.append(rng.choice(follow[words[-1]]))
        texts.append(words)
    rows = [(k, " ".join(w), "en") for k, w in enumerate(texts)]
    mixed = list(texts[0])
    rng.shuffle(mixed)
    odd = " ".join("".join(rng.choices(string.ascii_letters, k=4)) for _ in range(200))
    rows += [(100, " ".join(mixed), "en"), *[(200 + k, odd, "en") for k in range(5)]]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].kept for k in range(60))
    assert got[100].log_perplexity > 1.5 * got[0].log_perplexity and not got[100].kept
    assert not any(got[200 + k].kept for k in range(5))


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.fr/x", None), (None, None, "<html lang=fr><p>le chat</p>"), (3, "x", ""), (3, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "1 AS host", "2 AS doc_id")
    got = langid.page_evidence(pages).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, None: 1, 3: 2}
    assert {r.doc_id: (r.text.strip(), r.declared, r.host) for r in got} == {
        1: ("", "", ""), 2: ("", "", "a.fr"), None: ("le chat", "fr", ""), 3: ("", "", "")
    }
    assert langid.identify(langid.page_evidence(pages)).count() == 5
    assert langid.identify(langid.page_evidence(pages.limit(0))).count() == 0


def test_shards_equal_plain_ones(spark, sf_dir, edge, tmp_path):
    """Sizes and checksums of all rows; a stored map sends each slot's rows; what is written is each row once."""
    for k, docs in enumerate((spark.read.parquet(f"{sf_dir}/documents.parquet"), edge)):
        path = f"file://{tmp_path}/{k}"
        placed = sharding.shard_documents(docs, shards=5, slots=128, store=f"{path}/map").cache()
        raw = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        rows = placed.collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == raw
        owner = sharding.SlotMap.load(spark, f"{path}/map", 5, 1).owner
        assert all(owner[r.virtual_slot] == r.shard for r in rows)
        for shard in range(5):
            places = sorted(r.slot for r in rows if r.shard == shard)
            assert places == list(range(len(places)))
        sharding.write_shards(docs, placed, f"{path}/out")
        back = spark.read.parquet(f"{path}/out").collect()
        assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text) for r in docs.collect())
        assert Counter(r.shard for r in back) == Counter(r.shard for r in rows)


def test_slot_maps_grow_and_are_saved_again(spark, tmp_path):
    weight = {s: 1 + s % 7 for s in range(100)}
    first = sharding.SlotMap.first(100, 4).rebalanced(weight)
    more = first.grown(weight)
    assert all(a == b or b == 4 for a, b in zip(first.owner, more.owner)) and more.shards == 5
    load = Counter()
    for slot, shard in enumerate(more.owner):
        load[shard] += weight[slot]
    assert max(load.values()) - min(load.values()) <= 14
    for m in (first, more, more):
        m.save(spark, f"file://{tmp_path}")
    back = sharding.SlotMap.load(spark, f"file://{tmp_path}", 5, 2)
    assert back.owner == more.owner and sorted(back.edits) == sorted(more.edits)


def test_other_tokenizers_take_texts_whole(tmp_path):
    """A tokenizer that cuts otherwise gives its own ids, not those of units."""
    import json

    from tokenizers import Tokenizer

    config = json.load(open(vocabulary("byte_bpe_50k.json")))
    texts = ["Hello, wide world. a b", " two  spaces\nand lines ", "x<|a b|>y"]
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}}, {"normalizer": {"type": "Lowercase"}}):
        path = f"{tmp_path}/t.json"
        json.dump(config | change, open(path, "w"))
        enc, model = tokenfiles.Encoder(path), Tokenizer.from_file(path)
        assert not enc.by_unit
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, enc.dtype).tolist() == model.encode(t, add_special_tokens=False).ids
    assert tokenfiles.Encoder(vocabulary("byte_bpe_50k.json")).by_unit


def test_words_go_to_the_bpe_itself(tmp_path, monkeypatch):
    """What is new is a word nearly always; ids are the library's while units are forgotten, and with an added word."""
    from tokenizers import AddedToken, Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(5)
    model = Tokenizer.from_file(path)
    model.add_tokens([AddedToken("ing")])
    model.save(str(tmp_path / "added.json"))
    parts = [*"abE.,'9é漢 \n\t", "  ", "the", "ing", "Straße", "\xa0", "\0", " \n", "'s", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    monkeypatch.setattr(tokenfiles, "CACHE_ENTRIES", 300)
    for file, direct in ((path, True), (str(tmp_path / "added.json"), False)):
        enc, whole = tokenfiles.Encoder(file), Tokenizer.from_file(file)
        assert enc.direct == direct
        for k in range(0, len(texts), 100):
            for t, ids in zip(texts[k : k + 100], enc.encode(texts[k : k + 100])):
                assert np.frombuffer(ids, enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, t
        assert enc.older and len(enc.known) <= 300


def test_what_operators_remember_is_given_back():
    """Workers keep courses of op4 from task to task, until tasks of the near-duplicate stage need the memory."""
    from tessel.llm import common

    held = common.remembered({"x": 1})
    piecedrop.coder(vocabulary("piece_bpe_32k.model"), 0.1).encode(["some words " * 9], [1])
    common.forget()
    assert not held and not piecedrop._coders
    common._remembered.remove(held)
    texts = ["some words " * 9]
    again = piecedrop.coder(vocabulary("piece_bpe_32k.model"), 0.1)
    assert again.decode(again.encode(texts, [1])[0]) == texts[0]
