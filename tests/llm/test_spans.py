"""The scans for secrets and personal data against plain readings of their contracts."""

import hashlib
import math
import random
import re

import pytest

from tessel.llm import pii, secrets


def leftmost(pattern, text, flags=0):
    """Matches one after the other, as a plain regex finds them."""
    return list(re.finditer(pattern, text, flags))


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in leftmost(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in leftmost(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(c) for c in d[::-1]]
        s = sum(c if k % 2 == 0 else (2 * c - 9 if 2 * c > 9 else 2 * c) for k, c in enumerate(odd))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in leftmost(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plain_secrets(text):
    out = []
    pattern = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in leftmost(pattern, text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in leftmost("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in leftmost("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


PII_PARTS = ["a", "b.c", "@", "x@y.z", ".", "-", "1", "256", "10.0.0.1", "4111111111111111", " ", "+1", "(242)", "555-3475", "é", "\n", "%"]
SECRET_PARTS = ["password", "TOKEN", "Api_Key", "apikey", "=", ": ", '"', "'", "abcdef", "x", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", " ", "ſecret", "toKen", "\n"]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_plain_ones(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice(PII_PARTS) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_pii(text), text
        text = "".join(rng.choice(SECRET_PARTS) for _ in range(rng.randint(0, 12)))
        assert [(k, a, b) for k, a, b, _ in secrets.base_spans(text)] == plain_secrets(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 500_000 + " " + "1" * 500_000 + "@" * 1000) == []


KEY = "e1541c8477ceaed7b9aa8bfba357b8827d687865"
OTHER = "Zx81kQv0Lm42Rt77Yp5w"


def secret_rows(spark):
    rows = [(k, f'config token = "{KEY}" end', f"owner{k}", "en") for k in range(4)]
    rows += [(10, f"mine {OTHER} here", "owner1", "en"), (11, None, None, None), (12, "", "o", "de"), (12, "", "o", "de")]
    rows += [(None, "password: hunter22", "o", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_examples_part_from_live_values(spark):
    found = {(r.doc_id, r.spans): r for r in secrets.find_secrets(secret_rows(spark)).collect()}
    assert len(found) == 8
    by = {k[0]: r for k, r in found.items()}
    assert [by[k].n_example for k in range(4)] == [2] * 4 and by[0].n_live == 0
    assert by[10].spans == f"owned:5:{5 + len(OTHER)}" and by[10].n_live == 1
    assert by[None].n_assign == 1 and by[None].spans == "assign:0:18"
    assert by[11].base_sha256 == hashlib.sha256(b"").hexdigest() and by[11].spans == ""
    assert secrets.redacted(f"mine {OTHER} here", by[10].spans) == "mine [OWNED] here"


def test_scans_take_empty_tables_and_clashing_columns(spark):
    docs = secret_rows(spark).selectExpr("*", "text AS spans", "1 AS found", "'x' AS owner", "2 AS row", "'y' AS repo")
    assert secrets.find_secrets(docs).count() == 9
    assert pii.protect(docs).count() == 9
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    assert pii.protect(docs.limit(0)).count() == 0


def test_terms_that_give_an_entity_away(spark):
    filler = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was"]
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(filler) for _ in range(60))) for k in range(200)]
    rows += [(1000 + k, f"the of Zanzibarian chess {rng.choice(filler)} {rng.choice(filler)} {k} write to jo@ex.org now") for k in range(6)]
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.protect(docs).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        text, r = rows[200 + k][1], got[1000 + k]
        words = {text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in r.spans.split(",")) if kind != "email"}
        assert "Zanzibarian" in words and "chess" in words and not words & set(filler)
        assert r.n_email == 1 and "jo@ex.org" not in pii.sanitised(text, r.spans)
    assert all(got[k].spans == "" for k in range(200)) and got[2000].n_terms == 0


def test_copies_inside_one_owner_are_examples(spark):
    wide, live = "q7Rt9LmX2vBn4KpZ8sWd", "h3Jk8PwQ5tYx1NcV6bGf"
    rows = [(k, f"token {wide} in text {k}", "hot", ["en", "de", "fr"][k % 3]) for k in range(9)]
    rows += [(20 + k, f"token {live} here", "hot", "en") for k in range(9)]  # one text, copied
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert all(got[k].n_live == 0 and got[k].spans == "" for k in range(9))
    assert all(got[20 + k].n_live == 1 and got[20 + k].held == "1:1:1" for k in range(9))


def plain_shares(rows, window=10, support=2, z=1.0):
    """(entity, term) -> share, from dictionaries."""
    contexts, count = {}, {}
    for _, text in rows:
        for w in re.split(r"[ \t\n\x0b\x0c\r]+", text or ""):
            if w := w.strip(pii._EDGE).lower():
                count[w] = count.get(w, 0) + 1
        base = pii.base_spans(text or "")
        for kind, a, b in base:
            words = [w for w in pii.context(text, a, b, window) if not any(w[1] < y and x < w[2] for _, x, y in base)]
            words = [w.lower() for w, _, _ in words]
            contexts.setdefault(pii.entity(kind, text[a:b]), set()).add(" ".join(words))
    total, out = sum(count.values()), {}
    for e, held in contexts.items():
        n = len(held)
        for w in {w for c in held for w in c.split(" ") if w}:
            both = sum(w in c.split(" ") for c in held)
            if both >= support:
                p = both / n
                low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                out[e, w] = math.log2(low / min(1, count[w] * 2 * window / total)) / -math.log2(min(0.5, n * 2 * window / total))
    return out


def test_disclosing_terms_equal_plain_ones_wherever_they_stand(spark):
    """Terms are marked in all of a text that holds the entity, in very long texts too, and nowhere else."""
    rng = random.Random(3)
    filler = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choices(filler, range(300, 0, -1), k=n))
    rows = [(k, text(80)) for k in range(150)]
    for k in range(40):
        e, term = rng.choice([("jo@ex.org", "Captain"), ("10.1.2.3", "router,"), ("+1 242 555 3475", "sister")])
        near = f"{text(4)} {term} {e} {text(6)}"
        far = f" {text(30)} {term.lower()}" if k % 2 else ""
        rows.append((1000 + k, f"{text(20)}\n{near}{far} {text(k)}"))
    rows += [(2000, "Captain " + text(40)), (2001, rows[-1][1]), (2002, text(30_000) + " Captain jo@ex.org now captain"), (2003, None), (2004, "")]
    shares = plain_shares(rows)
    assert len({e for (e, _), x in shares.items() if x >= 0.7}) == 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = 0
    for r in pii.protect(docs).collect():
        own = dict(rows)[r.doc_id] or ""
        held = {pii.entity(k, own[a:b]) for k, a, b in pii.base_spans(own)}
        best = {}
        for (e, w), x in shares.items():
            if e in held and x >= 0.7:
                best[w] = max(best.get(w, 0), x)
        want = pii.term_spans(own, best, 0.9)
        got = [x.split(":") for x in r.spans.split(",") if x.startswith(("term", "drop"))]
        assert [(k, int(a), int(b)) for k, a, b in got] == want and r.n_terms == len(want), r.doc_id
        some += len(want)
    assert some > 50


def test_ownership_equals_plain_counts(spark):
    """Counts, verdicts and added spans of a corpus in which values are shared, copied and owned."""
    rng = random.Random(17)
    values = ["".join(rng.choices("ABCDEFGHJKabcdefghjk23456789", k=rng.choice([20, 24, 40]))) for _ in range(25)]
    values += [rng.randbytes(16).hex() for _ in range(10)] + ["AKIA" + "".join(rng.choices("ABCDEFG2345", k=16)) for _ in range(5)]
    rows = []
    for k in range(400):
        # Few values are everywhere, most in few places.
        own = [values[min(int(rng.expovariate(0.12)), len(values) - 1)] for _ in range(rng.choice([0, 1, 1, 2]))]
        text = " ".join(rng.choice([f"see {v} now", f"token: {v}", f"'{v}'"]) for v in own) + f" end {rng.choice([k, 1])}"
        rows.append((k, text, rng.choice(["hot"] * 6 + [f"s{k % 9}", None]), rng.choice(["en", "de"])))
    rows += [(1000, "x " * 60_000 + values[-1], "solo", "en"), (1001, "y " * 60_000 + f"key {values[24]}", None, "en")]
    held = {}
    for _, text, owner, lang in rows:
        for _, _, _, v in secrets.candidates(text, 3.0):
            held.setdefault(v, set()).add((owner or "", (owner, lang), text))
    verdicts = {}
    for v, who in held.items():
        repos, owners, texts = len({(o, r) for o, r, _ in who}), len({o for o, _, _ in who}), len({t for _, _, t in who})
        kind = "example" if owners >= 3 or repos >= 3 or texts >= 5 else "live" if owners == 1 and secrets.looks_random(v, 3.0) else "shared"
        verdicts[v] = kind, f"{repos}:{owners}:{texts}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    got, added = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}, 0
    for i, text, _, _ in rows:
        spans = [x for x in secrets.candidates(text, 3.0) if x[0] != "owned" or verdicts[x[3]][0] == "live"]
        order = {"assign": 0, "access": 1, "hex": 2, "owned": 3}
        spans.sort(key=lambda x: (x[1], order[x[0]]))
        r = got[i]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        assert r.held == ",".join(verdicts[v][1] for *_, v in spans)
        for name in ("live", "example"):
            assert r[f"n_{name}"] == sum(verdicts[v][0] == name for *_, v in spans)
        added += sum(k == "owned" for k, *_ in spans)
    assert added > 3 and {k for k, _ in verdicts.values()} == {"example", "live", "shared"}
