"""Encoding: equal to a reference encoder of the same vocabulary, decodable, defined on nulls and odd texts."""

import random

import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
from lectern.llm import tokenize as t  # noqa: E402

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALPHABET = ["'", "s", "t", "l", "v", "r", "e", "d", "m", " ", "\n", "\t", "a", "é", "1", "²", "-", "!", "中", "😀", "'ll", "  ", "\r\n", "́", "S", "\x85", "​", "<|endoftext|>", "bonjour"]


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=t.load_ranks(t.VOCABULARY), special_tokens={})


def test_equal_to_reference(encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 20))) for _ in range(8000)]
    texts += ["'" * 3000, "a" * 2000, " " * 2000, "", "l'été d'ici, qu'on l'ait vu: 12'345.50!"]
    ids, counts, _, _ = t.encode_texts(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        own = ids[at : at + n].tolist()
        at += n
        assert own == encoder.encode_ordinary(text), text
        assert t.decode_ids(own) == text


def test_rows(spark, encoder):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "y"), (4, "été " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"], r["offsets"]) for r in t.encode(df, with_offsets=True).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[2][1] == [] and got[3][1] == []
    assert got[0][1] == encoder.encode_ordinary("Hello world") and got[0][2] == [0, 5]
    assert got[4][1] == encoder.encode_ordinary("été " * 60_000)
    assert t.encode(df.where(F.lit(False))).count() == 0
