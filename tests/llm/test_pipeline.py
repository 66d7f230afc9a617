"""The pipeline, stage by stage, against what its stages promise."""

import random

import corpus_pipeline
from tessel.llm import decontam, linededup, neardup, simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert rows == before
        if name == "line_dedup":
            want = {r.doc_id: r.text for r in linededup.dedupe_lines(spark.createDataFrame(list(before.values()))).collect()}
            assert {i: r.text for i, r in rows.items()} == want
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if name == "simhash_dedup":
            prints = {i: simhash.fingerprint(r.text) for i, r in rows.items()}
            assert len(rows) < len(before)
            assert all((a ^ b).bit_count() > 3 for i, a in prints.items() for j, b in prints.items() if i < j)
        if name == "decontamination":
            tests = [set(decontam.shingles(decontam.words(r.text), 5)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for i, r in before.items():
                held = decontam.shingles(decontam.words(r.text), 5)
                leaked = any(len(s & held) >= 0.8 * len(s) for s in tests)
                assert leaked == (i not in rows), i
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == set(rows) and all(r.lossless for r in last)
    assert {(r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.ids_crc32) for r in last}


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "", None, None, 0), (None, "some words", "en", "s", 10), (2, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        current = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, current, sf_dir)
            current = spark.createDataFrame(out.collect(), out.schema)


def test_near_copies_of_similarity_08_go(spark, sf_dir):
    """Brute force over all pairs; near copies up to the similarity are far from each other in op2's fingerprints."""
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    for k in range(12):  # a word in forty changed: about 0.8
        words = [f"w{k}x{j}" for j in range(400)]
        near = list(words)
        for j in rng.sample(range(400), 4 + k):
            near[j] = "z"
        rows += [(10_000 + 2 * k, " ".join(words)), (10_001 + 2 * k, " ".join(near))]
    family = [f"f{j}" for j in range(400)]
    rows += [(20_000 + k, " ".join(family[:k] + ["z"] + family[k + 1 :])) for k in range(40)]
    rows += [(30_000, ""), (30_001, " \n"), (30_002, None)]
    sets = [set(neardup.shingle_set(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
                far += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > 3
    want = {rows[root(k)][0] for k in range(len(rows))}
    assert far > 5
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == want


def test_shared_passages_make_no_pairs_and_hide_none(spark):
    """Texts around one long passage, similar only where what stands around it is short or nearly the same."""
    rng = random.Random(31)
    core, rows = [f"c{j}" for j in range(300)], []
    for k in range(260):
        own = [f"d{k}x{j}" for j in range(rng.choice([5, 30, 90, 120]))]
        rows.append((k, " ".join(own + core)))
        if k % 20 == 0:
            rows.append((1000 + k, " ".join([*own[:-1], "z", *core])))
    sets = [set(neardup.shingle_set(t).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.groups(docs).collect()}
    want = {i: least[root(k)] for k, (i, _) in enumerate(rows)}
    assert got == want
    for bucket in (1, 1000):  # prefixes alone, and pairs alone
        assert {r.doc_id: r.component_id for r in neardup.groups(docs, bucket=bucket).collect()} == want
    assert 50 < len(set(got.values())) < len(rows) - 5


def test_documents_without_id_are_judged_by_their_own_text(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "pq")
    rows = [(None, t, "en", "s", len(t)) for t in (item, one, one, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(r.text for r in unique.collect()) == sorted([item, one, two])
    clean = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert sorted(r.text for r in clean.collect()) == sorted([one, one, two])
