import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import mixture as M
from corpuslens.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no public vocabulary")


@pytest.fixture(scope="module")
def bpe():
    with open(K.VOCABULARY, "rb") as f:
        return K.ByteBpe.parse(f.read())


@pytest.fixture(scope="module")
def published():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_published_library(bpe, published, text):
    assert bpe.encode(text) == published.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_words_equal_the_merges(bpe, data):
    assert bpe.encode_word(data) == bpe.merged(data)
    assert b"".join(bpe.token[i] for i in bpe.encode_word(data)) == data


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 50_000, " " * 100_000, "é" * 50_000, "<|endoftext|>", "\x00\x1c \n", "don't I'll 'S"])
def test_long_and_odd(bpe, published, text):
    ids = bpe.encode(text)
    assert b"".join(bpe.token[i] for i in ids) == text.encode()
    if len(text) < 60_000:
        assert ids == published.encode(text, add_special_tokens=False).ids


def test_table(spark):
    df = spark.createDataFrame([(1, "the node", "x"), (2, None, "x"), (3, "", "x"), (None, " ", "x"), (1, "the node", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in K.token_ids(df).collect())
    assert got == [(0, [220]), (1, [1169, 10139]), (1, [1169, 10139]), (2, []), (3, [])]
    assert K.token_ids(df.limit(0)).count() == 0


def test_raking_keeps_goals_and_caps():
    r = np.random.default_rng(1)
    cells = pd.DataFrame([(s, l, t, int(r.integers(1, 900))) for s in range(5) for l in range(3) for t in range(4)], columns=["source", "lang", "topic", "tokens"])
    cells["cap"] = cells["tokens"] * np.array([1, 2, 3, 1, 2])[cells["source"]]
    most = np.bincount(cells["source"], cells["cap"])
    goal = most * np.array([0.5, 0.9, 1.0, 0.1, 0.3])
    x = M.raked(cells, goal)
    assert np.allclose(np.bincount(cells["source"], x), goal, rtol=1e-6) and (x <= cells["cap"] * (1 + 1e-9)).all() and (x >= 0).all()
    free = M.raked(cells.assign(cap=1e9), goal)  # without caps languages keep their shares
    share = np.bincount(cells["lang"], free) / free.sum()
    assert np.abs(share - np.bincount(cells["lang"], cells["tokens"]) / cells["tokens"].sum()).max() < 0.02


def data(spark, n=600):
    texts = [(i, "node map zone " * (1 + i % 9), ["de", "en", None][i % 3], ["big", "mid", "tiny", "other", None][0 if i % 2 else 1 if i % 10 < 8 else 2 if i % 50 == 8 else 3 if i % 20 else 4], ["a", None][i % 2], "clash") for i in range(n)]
    texts += [(10_000, None, "en", "big", "a", ""), (10_001, "", "en", "big", "a", ""), (5, "node", "en", "big", "a", "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, doc_type string, n_tokens string")
    mix = spark.createDataFrame([("big", 5.0, 2), ("mid", 4.0, 1), ("tiny", 0.9, 3), ("gone", 0.1, 4), (None, 1.0, 1), ("bad", None, 1), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    return docs, mix


def test_mixture(spark):
    docs, mix = data(spark)
    mixed, report = M.mixture(docs, mix)
    rows, said = mixed.collect(), {r["source"]: r for r in report.collect()}
    assert set(said) == {"big", "mid", "tiny", "gone"} and said["gone"]["status"] == "empty" and said["gone"]["tokens"] == 0
    assert abs(sum(r["target_share"] for r in said.values()) - 1) < 1e-9 and abs(sum(r["actual_share"] for r in said.values()) - 1) < 1e-9
    caps = {"big": 2, "mid": 1, "tiny": 3}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    for s, r in said.items():
        assert r["tokens"] == sum(x["n_tokens"] * x["copies"] for x in rows if x["source"] == s)
        if r["status"] == "met":
            assert abs(r["tokens"] - r["target_tokens"]) <= 30  # within one document
        elif r["status"] == "short":
            assert r["tokens"] == r["available_tokens"] * r["max_repeats"]
    assert said["tiny"]["status"] == "short" or said["tiny"]["tokens"] > 0
    again = M.mixture(docs.repartition(7), mix)[0]
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_total_given_and_empty_tables(spark):
    docs, mix = data(spark, 200)
    said = {r["source"]: r for r in M.mixture(docs, mix, total=1000)[1].collect()}
    assert abs(said["big"]["tokens"] - 500) <= 30
    mixed, report = M.mixture(docs.limit(0), mix)
    assert mixed.count() == 0 and {r["status"] for r in report.collect()} == {"empty"}
    mixed, report = M.mixture(docs, mix.limit(0))
    assert mixed.count() == 0 and report.count() == 0
