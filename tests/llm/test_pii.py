import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.data import SF0001, no_documents, odd_documents

from topicpulse.llm import pii as P
from topicpulse.llm.queries import QUERIES

BASE = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else None,
            "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rule) in enumerate(RULES.items())
             for m in re.finditer(rule, text or "") if passes(kind, m.group())]
    return sorted(found)


def base_row(text):
    spans = base_spans(text)
    line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return [sum(s[3] == kind for s in spans) for kind in RULES] + [
        hashlib.sha256(line.encode()).hexdigest()]


def random_texts(seed, count):
    rnd = random.Random(seed)
    bits = ["a@b.co", "x.y_z@mail-1.example.com", "_q@w.e", "@", ".", "-", "+", " ", " ", "\n", "é",
            "\U0001f600", "1.2.3.4", "256.1.1.1", "001.02.3.255", "10.0.0", "4539578763621486",
            "4539 5787 6362 1486", "5500005555555559", "1", "22", "12345", "+1 (017) 555-7713",
            "+49.30.123456", "+1", "(", ")", "word", "3782-822463-10005", "0000 0000 0000 00", "A_b%"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(count)]


def test_base_equals_brute_force(spark):
    texts = random_texts(1, 1500) + ["", None, "a@b@c.de", "a@b.c.d-@e.f", "x@a.com_y@b.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = P.digests(P.find(df)).select("row.doc_id", *BASE, "spans").collect()
    assert len(got) == len(texts)
    for r in got:
        assert [r[c] for c in BASE] == base_row(texts[r["doc_id"]]), texts[r["doc_id"]]
        kept = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(kind, str(a), str(b)) for a, _, b, kind in base_spans(texts[r["doc_id"]])]
        assert set(base) <= set(map(tuple, kept))
        places = [(int(a), P.KINDS.index(k)) for k, a, _ in kept]
        assert places == sorted(places)


def test_hostile_texts_stay_linear(spark):
    # (text, repeats, emails, ips); plain Python patterns would take hours on the long ones
    shapes = [("a", 300_000, 0, 0), ("1", 300_000, 0, 0), ("1.", 150_000, 0, 37_500), ("a.", 150_000, 0, 0),
              ("1 ", 150_000, 0, 0), ("_-", 150_000, 0, 0), ("(at)", 50_000, 0, 0), ("+", 200_000, 0, 0),
              ("a@b.c ", 20_000, 20_000, 0)]
    texts = [t * n for t, n, _, _ in shapes] + ["a@" + "b." * 150_000, "+1" + " " * 300_000]
    texts += [t * 300 for t, *_ in shapes]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.digests(P.find(df)).select("row.doc_id", *BASE).collect()}
    for i, (_, _, emails, ips) in enumerate(shapes):
        assert [got[i][c] for c in BASE[:4]] == [emails, ips, 0, 0], shapes[i]
        short = len(shapes) + 2 + i
        assert [got[short][c] for c in BASE] == base_row(texts[short])
    assert [got[len(shapes)][c] for c in BASE[:4]] == [1, 0, 0, 0]
    assert [got[len(shapes) + 1][c] for c in BASE[:4]] == [0, 0, 0, 0]


def test_query_over_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    got = QUERIES["op13_pii"](spark, SF0001)
    assert got.columns == ["doc_id", *BASE, "spans"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert [r[c] for c in BASE] == base_row(docs[r["doc_id"]])


def test_odd_rows_and_empty_table(spark):
    df = odd_documents(spark).withColumn("spans", F.lit("mine")).withColumn("rid", F.lit("mine"))
    got = P.digests(P.find(df))
    rows = got.select("row.doc_id", "row.rid", *BASE).collect()
    assert len(rows) == df.count() and {r["rid"] for r in rows} == {"mine"}
    assert P.digests(P.find(no_documents(spark))).count() == 0


def card(rnd):
    body = "".join(str(rnd.randint(0, 9)) for _ in range(15))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def around(rnd):
    """No word, or one of one to nine letters with a space."""
    n = rnd.randint(0, 9)
    return "".join(rnd.choice("abcdefgh") for _ in range(n)) + " " * (n > 0)


def planted(rnd, n):
    """Cards and wrong numbers with words around them."""
    rows = []
    for i in range(n):
        rows.append(f"{around(rnd)}{card(rnd)} {around(rnd)}x{i}")
        wrong = card(rnd)
        rows.append(f"{around(rnd)}{wrong[:-1]}{(int(wrong[-1]) + 1) % 10} {around(rnd)}x{i}")
    return rows


def test_trees_add_what_the_rules_miss(spark):
    rnd = random.Random(2)
    texts = planted(rnd, 600)
    pairs = [f"{around(rnd)}{card(rnd)} {card(rnd)} here" for _ in range(10)]
    clean = [f"{around(rnd)}{rnd.randint(10**15, 10**16)} of {i}" for i in range(10)]
    clean = [t for t in clean if not base_spans(t)]
    keys = [f'api_key = "{rnd.getrandbits(160):040x}" end' for _ in range(200)]
    loose = [f"see {rnd.getrandbits(160):040x} end" for _ in range(5)]
    words = [f"averyveryverylongwordwithoutdigits{i}" for i in range(50)]
    all_texts = texts + pairs + clean + keys + loose + words
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    got = {all_texts[r["doc_id"]]: r["spans"] for r in P.digests(P.find(df)).select(
        "row.doc_id", "spans").collect()}
    for t in pairs:
        assert got[t] == ",".join(f"card:{m.start()}:{m.end()}" for m in re.finditer("[0-9]{16}", t))
    assert all(got[t] == "" for t in clean)
    assert all(got[t] == "secret:11:51" for t in keys)
    assert all(got[t] == "secret:4:44" for t in loose)
    assert sum(bool(got[t]) for t in texts) == sum(bool(base_spans(t)) for t in texts)
    # copies of a text are no further evidence
    three = P.learn(_candidates(df.union(df).union(df)))
    once = P.learn(_candidates(df))
    assert three[0].trees == once[0].trees and three[1] == once[1]


def _candidates(df):
    made = [v.alias(k) for k, v in P.features().items() if k != "kind"]
    return P.located(P.propose(df)).select("*", *made)


def test_boosting_equals_a_plain_version(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(200):
        x, y = rnd.randint(0, 5), rnd.randint(0, 3)
        n = rnd.randint(1, 9)
        rows.append((x, y, n, sum(rnd.random() < (0.9 if x > 2 and y < 2 else 0.2) for _ in range(n))))
    df = spark.createDataFrame(rows, "x int, y int, n long, proven long")
    model = P.boost(df, ["x", "y"], rounds=3)
    assert len(model.trees) == 3

    def value(tree, row):
        if isinstance(tree, float):
            return tree
        (f, at), left, right = tree
        return value(left if row[f] <= at else right, row)

    margins = [model.bias] * len(rows)
    for tree in model.trees:
        # gradients by hand, and no other root split gains more
        p = [1 / (1 + math.exp(-m)) for m in margins]
        g = [r[3] - r[2] * q for r, q in zip(rows, p)]
        h = [r[2] * q * (1 - q) for r, q in zip(rows, p)]

        def gain(f, at):
            out = 0.0
            for side in (True, False):
                of = [i for i, r in enumerate(rows) if (r["xy".index(f)] <= at) == side]
                if sum(rows[i][2] for i in of) < P.LEAST:
                    return -math.inf
                out += sum(g[i] for i in of) ** 2 / (sum(h[i] for i in of) + P.DAMPING)
            return out

        best = max(gain(f, at) for f, top in (("x", 5), ("y", 3)) for at in range(top))
        assert math.isclose(gain(*tree[0]), best, rel_tol=1e-6)
        margins = [m + value(tree, {"x": r[0], "y": r[1]}) for m, r in zip(margins, rows)]
    got = {(r["x"], r["y"]): r["m"] for r in df.select("x", "y", model.margin().alias("m")).collect()}
    assert all(math.isclose(got[r[:2]], m, abs_tol=1e-9) for r, m in zip(rows, margins))


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(6)
    spans = set()
    for rid in range(60):
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randint(0, 40)
            spans.add((rid, rnd.randint(0, 4), a, a + rnd.randint(1, 8), rnd.random() < 0.4))
    df = spark.createDataFrame(sorted(spans), "rid long, kind int, start long, end long, base boolean")
    want = set()
    for rid in range(60):
        own = [s for s in spans if s[0] == rid]
        base = [s for s in own if s[4]]
        free = sorted((s for s in own if not s[4] and not any(b[2] < s[3] and b[3] > s[2] for b in base)),
                      key=lambda s: (s[2], -s[3], s[1]))
        want |= set(base) | {s for i, s in enumerate(free) if all(p[3] <= s[2] for p in free[:i])}
    assert set(map(tuple, P.without_overlaps(df).select("rid", "kind", "start", "end", "base").collect())) == want


def test_cutoff_needs_evidence():
    assert P.lower_bound(10, 10) < P.PRECISION < P.lower_bound(60, 60)
    assert P.lower_bound(500, 600) < P.PRECISION


@pytest.mark.parametrize("text,want", [
    ("mail a@b.co now", "mail [email] now"), ("", ""), ("é 1.2.3.4", "é [ip]"), ("none", "none"), (None, None)])
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.redact(df).collect() == [(1, want)]
