"""Mails: the same text however often a header was seen, read on all cores."""

from email import headerregistry, policy

from lectern.plans import inputs
from lectern.sources import documents


def test_headers_are_parsed_once(monkeypatch):
    mails = [inputs.make_mail(f"Objet é {i % 3}", f"Corps {i}") for i in range(60)]
    mails += [b"To: " + b"a@b.example, " * 100 + b"c@d.example\nSubject: =?utf-8?q?=C3=A9?=\nContent-Type: text/html\n\n<p>x</p>", b"Subject: caf\xe9\n\n\xe9", b""] * 2
    got = [documents.read_mail(m) for m in mails]
    parse, parses = headerregistry.HeaderRegistry.__call__, []
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__call__", lambda self, name, value: parses.append(name) or parse(self, name, value))
    assert [documents.read_mail(m) for m in mails] == got
    assert len(parses) < len(mails)
    monkeypatch.setattr(documents, "MAIL", policy.default)
    assert [documents.read_mail(m) for m in mails] == got


def test_mails_are_read_on_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, f"n {i}", "T") for i in range(30)], "p_partkey bigint, p_name string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = inputs.in_mail(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["subject"], r["body"]) for r in found.collect()} == {(True, True)} and found.count() == 30
