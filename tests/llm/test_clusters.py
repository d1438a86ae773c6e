"""Clusters of names: settled within tasks as by rounds over all of them, and with few jobs."""

import random

from pyspark.sql import functions as F

from lectern.llm import names


def rounds(links, known):
    """held_apart() by its words, a round at a time."""
    parents = {}
    for a, b, _ in links:
        names._join(parents, a, b)
    labels = {}
    for node in parents:
        labels.setdefault(names._find(parents, node), set()).update([known[node]] if node in known else [])
    both = [(a, b, s) for x, y, s in links for a, b in ((x, y), (y, x)) if len(labels[names._find(parents, a)]) > 1]
    seeds = {a: (1e9, 0, known[a]) for a, _, _ in both if a in known}
    state, before = seeds, None
    while state != before:
        offers = {}
        for a, b, s in both:
            if b in state:
                offers.setdefault(a, []).append((-min(state[b][0], s), state[b][1] + 1, state[b][2]))
        before, state = state, {a: (-min(x)[0], *min(x)[1:]) for a, x in offers.items()} | seeds
    told = {a: x[2] for a, x in state.items()}
    return [(a, b, s) for a, b, s in links if a not in told or b not in told or told[a] == told[b]]


def test_apart_as_by_rounds():
    rng, cut = random.Random(1), 0
    for _ in range(300):
        n = rng.randint(5, 40)
        links = list({(a, b): (f"n{a}", f"n{b}", rng.choice([0.85, 0.9, 0.93, 0.97])) for a in range(n) for b in range(a + 1, n) if rng.random() < 1.6 / n}.values())
        known = {f"n{i}": rng.choice("xyz") for i in range(n) if rng.random() < 0.25}
        want = rounds(links, known)
        assert names._apart(links, known) == want
        cut += len(links) - len(want)
    assert cut > 300


def test_large_components_settle_alike(spark, monkeypatch):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.9), ("d", "e", 0.97), ("p", "q", 0.9)], "a string, b string, score double")
    ids = spark.createDataFrame([("a", "1"), ("c", "2")], "node string, label string")
    called = spark.createDataFrame([("c", "anne"), ("e", "jean")], "node string, label string")
    want = {("b", "b"), ("c", "b"), ("d", "d"), ("e", "d"), ("p", "p"), ("q", "p")}
    assert {tuple(r) for r in names.settled(links, ids, called).collect()} == want
    monkeypatch.setattr(names, "LARGEST", 2)
    assert {tuple(r) for r in names.settled(links, ids, called).collect()} == want


def test_alike_components(spark):
    edges = [(f"p {i % 7}", f"{i % 7}-{i:03d}", f"{i % 7}-{i + 7:03d}") for i in range(200) if i % 31]
    got = names.alike_components(spark.createDataFrame(edges, "common string, a string, b string"))
    want = names.components(spark.createDataFrame([e[1:] for e in edges], "a string, b string"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == want.count()
    assert names.alike_components(spark.createDataFrame([], "common string, a string, b string")).count() == 0


def test_no_pair_is_lost_before_comparison(spark):
    rng = random.Random(5)
    words = []
    for _ in range(600):
        w = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14)))
        v = list(w)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(v)) if v else 0
            how = rng.randrange(3)
            if how == 0 and i + 1 < len(v):
                v[i], v[i + 1] = v[i + 1], v[i]
            elif how == 1 and v:
                v[i] = rng.choice("abcdé")
            else:
                v.insert(i, rng.choice("abcdé"))
        words.append((w, "".join(v), None if rng.random() < 0.5 else 1, 1))
    kept = {tuple(r)[:2] for r in spark.createDataFrame(words, "main1 string, main2 string, id1 bigint, id2 bigint").where(names._may_be_alike()).collect()}
    alike = {(a, b) for a, b, *_ in words if names.alike(a, b)}
    assert alike <= kept and len(alike) > 100 and not spark.createDataFrame([("abc", "abc", 1, 2)], "main1 string, main2 string, id1 bigint, id2 bigint").where(names._may_be_alike()).count()


def test_the_driver_plans_few_jobs(spark):
    rows = [(f"{g} {s}", "person", None) for g in ("Anne", "Jean", "Paul", "J.") for s in ("Vuldremont", "Vuldrement", "Vuldremant", "Arbanel", "Arbannel")]
    rows += [("Sabine Vuldremont", "person", 1), ("Sabine Vuldrement", "person", 2), ("Vuldremont", "person", None), ("Garage Arbanel", "organization", None)]
    df = spark.createDataFrame(rows, "surface string, type_id string, entity_id bigint")
    jobs = spark._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert names.pairs(df).where(F.col("surface_a").startswith("Anne Vuldrem") & F.col("surface_b").startswith("Anne Vuldrem")).count() == 3
    assert jobs() - before < 100
