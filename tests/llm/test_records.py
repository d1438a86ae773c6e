"""Survivors, mixtures and pieces."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from lectern.llm import chunking, mixing, queries, survivor


def test_align():
    assert survivor.align("a b c".split(), "a b c".split()) == [(0, 0, "a"), (1, 0, "b"), (2, 0, "c")]
    assert survivor.align("a c".split(), "a b c".split()) == [(0, 0, "a"), (1, 0, None), (2, 0, "c")]
    assert survivor.align("x a b".split(), "a b".split()) == [(-1, 1, "x"), (0, 0, "a"), (1, 0, "b")]
    assert survivor.align([], ["a"]) == [(0, 0, None)]


def test_long_values_align_alike(monkeypatch):
    rng = random.Random(3)
    long = [f"w{i}" for i in range(700)]
    other = ["x", *long[:350], "new", *long[350:], "y"]
    votes = survivor.align(other, ["z", *long, "q"])
    assert {(i, j, t) for i, j, t in votes if t == "new"} == {(350, 1, "new")} and (700, 0, "w699") in votes
    cases = [([rng.choice("abcd") for _ in range(rng.randint(1, 20))], [rng.choice("abcd") for _ in range(rng.randint(1, 20))]) for _ in range(300)]
    whole = [survivor.align(v, p) for v, p in cases]
    monkeypatch.setattr(survivor, "MOST_CELLS", 0)
    assert [survivor.align(v, p) for v, p in cases] == whole


def fields(spark):
    at = datetime(2026, 1, 1)
    rows = [
        (1, "d", "a/B.pdf", "metadata", "title", "n/a", "PDF info", 0.9, 1, at), (2, "d", "./a/b.pdf", "metadata", "title", "Lettre du 3 mai", "pdf_info", None, 0, at),
        (3, "d", "a//b.pdf", "metadata", "title", "Lettre du 3 mai", "docx_core", None, 0, at), (4, "d", "a\\b.pdf", "metadata", "title", "Lettre du 4…", "exif", 0.99, 1, at),
        (5, "d", "c.pdf", "metadata", "title", None, "exif", None, None, None), (6, "d", "c.pdf", "metadata", "title", " ", "exif", None, None, None), (7, "d", "x", "identifier", "", "1", "exif", 1.0, 1, at),
        (8, "d", None, "metadata", "author", "A B", "zzz", 0.5, 1, at), (9, "d", None, "metadata", "author", "A  B", "zzz", 0.5, 1, at), (9, "d", None, "metadata", "author", "A  B", "zzz", 0.5, 1, at),
    ]
    return spark.createDataFrame(rows, "row_id bigint, domain string, relative_path string, kind string, detail string, value string, source string, confidence double, chosen bigint, recorded_at timestamp").withColumn("fact", F.lit(0))


def test_survivors(spark):
    trust = spark.createDataFrame([("docx_core", 1), ("pdf_info", 2), ("exif", 3)], "source string, trust_rank bigint")
    rows, order, weight = survivor.profile_facts(fields(spark), trust)
    key = ["domain", "path", "kind", "detail"]
    got = {(r["path"], r["detail"]): r for r in survivor.survivors(rows, key, "value", order, "row_id").collect()}
    assert got["a/b.pdf", "title"]["row_id"] == 3 and got["a/b.pdf", "title"]["n"] == 4
    assert got["c.pdf", "title"]["row_id"] == 5 and got[None, "author"]["row_id"] == 8 and got[None, "author"]["n"] == 3
    voted = survivor.survivors(rows, key, "value", order, "row_id", weight, vote="weight").where("path = 'a/b.pdf'").first()
    assert voted["value"] == "Lettre du 3 mai" and voted["consensus"] == "Lettre du 3 mai"
    assert survivor.survivors(rows.where("row_id < 0"), key, "value", order, "row_id").count() == 0


def test_order_needs_no_alignment(spark, tmp_path, monkeypatch):
    def unused(*_):
        raise AssertionError("aligned, though the order alone decides")

    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, "", "x", "x  y", "y x", "x y z"]), rng.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k string, v string, o int")
    best = {k: max((r for r in rows if r[1] == k), key=lambda r: (r[3], -r[0])) for k in ("a", "b", "c", None)}
    fields(spark).drop("fact").write.parquet(f"{tmp_path}/file_profile_fields.parquet")
    spark.createDataFrame([("docx_core", 1), ("pdf_info", 2), ("exif", 3)], "source string, trust_rank bigint").write.parquet(f"{tmp_path}/source_trust.parquet")
    for stage in ("_merged", "_consensus", "checkpointed"):
        monkeypatch.setattr(survivor, stage, unused)
    got = {r["k"]: r for r in survivor.survivors(df, ["k"], "v", [F.col("o")], "id").collect()}
    assert {k: (r["id"], r["v"], r["n"], r["consensus"]) for k, r in got.items()} == {
        k: (r[0], r[2], sum(x[1] == k for x in rows), " ".join((r[2] or "").split())) for k, r in best.items()
    }
    assert sorted(r["row_id"] for r in queries.p6_found(spark, str(tmp_path)).collect()) == [3, 5, 8]


def test_votes_outweigh_the_best(spark):
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(["rue Haute 3", "rue Haute 5", "rue Haute 5 bis", "rue Haute 5"], 1)], "id bigint, k string, v string")
    r = survivor.survivors(df, ["k"], "v", [F.lit(1)], "id", F.lit(1.0), vote="weight").first()
    assert r["consensus"] == "rue Haute 5" and r["id"] == 2


def test_progressive_alignment():
    value = lambda text, w: [{t: w} for t in text.split(" ")]
    cases = ["12 rue Haute", "rue Haute 12", "12 bis rue Haute", "12 bis rue Haute", "12 bis rue Haute"]
    assert survivor.consensus_of(survivor.progressive([(value(c, 1.0), 1.0) for c in cases])) == "12 bis rue Haute"
    by_order = survivor.progressive([(value(c, 1.0), 2.0 ** (-10 * i)) for i, c in enumerate(cases)])
    assert survivor.consensus_of(by_order) == "12 rue Haute"
    rng = random.Random(5)
    for _ in range(200):  # by order the best always wins, whatever the rest
        group = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))]
        profile = survivor.progressive([(value(c, 1.0), 2.0 ** (-10 * i)) for i, c in enumerate(group)])
        assert survivor.consensus_of(profile) == group[0]
        assert all(abs(sum(c.values()) - sum(2.0 ** (-10 * i) for i in range(len(group)))) < 1e-9 for c in profile)


def test_large_groups_take_rounds(spark):
    n = 3000  # different values of one fact, far beyond one part
    rows = [(i, "k", f"rue Haute {i % 7} suite v{i}") for i in range(1, n + 1)] + [(n + 1, "k", "rue Haute 3"), (n + 2, "j", ""), (n + 3, "j", None), (n + 4, "j", "x")]
    df = spark.createDataFrame(rows, "id bigint, k string, v string").withColumn("f", F.lit(1))
    got = {r["k"]: r for r in survivor.survivors(df, ["k"], "v", [(F.col("id") == 77).cast("int")], "id").collect()}
    assert got["k"]["id"] == 77 and got["k"]["consensus"] == "rue Haute 0 suite v77" and got["k"]["n"] == n + 1
    assert got["j"]["id"] == n + 2 and got["j"]["consensus"] == "" and got["j"]["n"] == 3
    voted = {r["k"]: r for r in survivor.survivors(df, ["k"], "v", [F.lit(1)], "id", F.when(F.col("id") == n + 1, 5000.0).otherwise(1.0), vote="weight").collect()}
    assert voted["k"]["consensus"] == "rue Haute 3" and voted["k"]["id"] == n + 1


def test_pieces(spark):
    rng = random.Random(2)
    texts = ["", "x" * 1200, "y" * 5000, None, "\n\n".join(" ".join("mot" * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) + "." for _ in range(60)), " " * 3000, "é😀 " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string").withColumn("piece", F.lit("clash"))
    rows = chunking.pieces(df).orderBy("row_id", "piece").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["row_id"] == i]
        if t is None:
            assert own == []
            continue
        assert "".join(r["text"][r["n_overlap"] :] for r in own) == t
        assert all(r["n_chars"] <= 1200 and r["n_overlap"] <= 120 for r in own)
        for before, after in zip(own, own[1:]):
            assert after["text"][: after["n_overlap"]] == before["text"][len(before["text"]) - after["n_overlap"] :]
    assert {r["row_id"] for r in chunking.oversized(df).collect()} == {i for i, t in enumerate(texts) if t and len(t) > 1200}


def test_edits_stay_local():
    rng = random.Random(7)
    text = "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(12)) + "." for _ in range(200))
    edited = text[:4000] + " encore un mot" + text[4000:]
    a = {text[x:y] for x, y, _, _ in chunking.cuts(text)}
    b = {edited[x:y] for x, y, _, _ in chunking.cuts(edited)}
    assert len(b - a) <= 8


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "mot " * rng.randint(1, 60), ["a", "a", "a", "b", "c"][i % 5]) for i in range(3000)] + [(9001, None, "a"), (9002, "", "b"), (9003, "mot", None), (9004, "mot", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("u", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.3, 2)], "source string, target_share double, max_repeats bigint")
    got = mixing.mix(df, targets).toPandas()
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert abs(share["a"] - 0.2) < 0.01 and abs(share["b"] - 0.5) < 0.01 and abs(share["c"] - 0.3) < 0.01
    assert got.groupby(["source"]).repeat.max().to_dict()["a"] == 1 and got.groupby("source").repeat.max().max() <= 4
    assert not got.doc_id.isin([9001, 9002, 9003, 9004]).any() and not got.duplicated(["doc_id", "repeat"]).any()
    assert got.shuffle_key.is_monotonic_increasing
    said = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert all(abs(said[s]["actual_share"] - share[s]) < 1e-9 and said[s]["most_taken"] <= said[s]["max_repeats"] for s in "abc")
    assert mixing.mix(df.where(F.lit(False)), targets).count() == 0
