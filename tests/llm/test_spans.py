"""Shared spans: against brute force, for copies, hot windows, nulls and the index's runs."""

import random

from pyspark.sql import functions as F

from lectern.llm import spans


def brute(texts, span):
    own = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in texts.items() if t}
    return {(a, b) for a in own for b in own if a < b and own[a] & own[b]}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé 中") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(120)[:k] for k in (299, 300, 301, 420, 700)]
    texts = {}
    for i in range(n):
        t = prose(rng.randint(5, 90))
        if rng.random() < 0.5:
            t = t[: len(t) // 2] + rng.choice(shared) + t[len(t) // 2 :]
        texts[i] = t
    texts[n] = texts[n + 1] = texts[n + 2] = prose(150)
    return texts | {n + 3: None, n + 4: "", n + 5: "a" * 5000, n + 6: "b" + "a" * 2000}


def test_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("h", F.lit("clash")).repartition(3)
    want = brute(texts, 300)
    assert want
    for hot in (48, 2):  # pairs within windows, then whole spans of hot windows
        monkeypatch.setattr(spans, "HOT", hot)
        got = [tuple(r) for r in spans.pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_shares(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    other = "".join(rng.choice("abcdefgh ") for _ in range(500))
    texts = {1: base, 2: other + base[100:500] + other[::-1], 3: other, 4: None, 5: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["length"], r["shared"], r["share"]) for r in spans.shares(df).collect()}
    assert got[1][:2] == (900, 400) and got[3] == (500, 500, 1.0) and got[2][1] == 900
    assert got[4] == (None, None, None) and got[5] == (0, 0, 0.0)


def brute_shares(texts, span):
    own = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in texts.items() if t}
    out = {}
    for i, t in texts.items():
        if t is None:
            continue
        covered = set()
        for k in range(len(t) - span + 1):
            if any(t[k : k + span] in own[j] for j in own if j != i):
                covered.update(range(k, k + span))
        out[i] = len(covered)
    return out


def test_shares_at_every_place(spark, monkeypatch):
    rng = random.Random(11)
    piece = "".join(rng.choice("abcdefgh ") for _ in range(400))
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150))
    # one text holds the piece three times, two are periodic, one repeats part of it
    texts = {1: noise() + piece + noise() + piece + noise() + piece, 2: piece + noise(), 3: "xy" * 700, 4: "q" + "xy" * 400, 5: noise() + piece[50:380] + noise(), 6: noise() * 4, 7: "z" * 900}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_shares(texts, 300)
    assert want[1] >= 1200 and want[3] == 1400
    monkeypatch.setattr(spans, "PAIRED", 2)
    for hot in (48, 1):
        monkeypatch.setattr(spans, "HOT", hot)
        assert {r["doc_id"]: r["shared"] for r in spans.shares(df).collect()} == want
        assert {tuple(r) for r in spans.pairs(df).collect()} == brute(texts, 300)


def test_runs_are_compacted(spark):
    index = spans.SpanIndex(spark, fan_out=2, buckets=2)
    texts = corpus(4, 20)
    rows = [(i, t) for i, t in texts.items() if t and len(t) >= 300]
    seen = set()
    for k in range(4):
        hits = index.append(spark.createDataFrame(rows[k::4], "doc_id bigint, text string"))
        seen |= {r["doc_id"] for r in hits.collect()}
        index.compact()
    assert [level for level, _ in index.runs] == [2]
    want = {x for pair in brute(dict(rows), 300) for x in pair}
    assert want <= seen


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.pairs(df).count() == 0 and spans.shares(df).count() == 0
