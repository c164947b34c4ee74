import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import frequency, split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é漢🦊.\n\f,", max_size=1500), st.sampled_from([40, 100, 300]), st.sampled_from([0, 5, 20]))
def test_pieces(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in got) == text
    for k, (b, c, e) in enumerate(got):
        assert len(text[b:e].encode()) <= limit and b <= c <= e
        assert k == 0 and b == c or c == got[k - 1][2] and c - b <= overlap
    if len(text.encode()) <= limit:
        assert len(got) == 1


def test_natural_boundaries_and_overlap():
    text = "".join(f"Sentence number {i} has some words in it. " + ("\n\n" if i % 7 == 6 else "") for i in range(900))
    got = split.pieces(text)
    assert len(got) > 3
    for _, c, _ in got[1:]:
        assert text[:c].endswith("\n\n")
    assert all(150 <= c - b <= 200 for b, c, _ in got[1:])
    assert all(len(text[c:e].encode()) > 2000 for _, c, e in got)


def test_no_boundaries():
    got = split.pieces("x" * 100_000)
    assert all(e - b <= 8192 for b, _, e in got) and got[-1][2] == 100_000


def test_pages():
    text = "\f".join(f"page {n} " + "word " * 500 for n in range(3, 11))
    for _, first, last, part, _ in split.split_row(text, 3, 10):
        own = [int(x.split()[0]) for x in part.split("page ")[1:]]
        assert first <= last and (not own or (first <= own[0] and last == own[-1])) and last - first == part.strip().count("\f")
    lost = split.split_row(text.replace("\f", " "), 3, 10)
    assert {(f, t) for _, f, t, *_ in lost} == {(3, 10)}
    assert {(f, t) for _, f, t, *_ in split.split_row("y" * 9000, None, None)} == {(None, None)}
    assert split.split_row("a\f" + "z" * 9000, 4, None)[-1][1:3] == (5, 5)


SCHEMA = "source_id string, chunk_no int, first_page int, last_page int, text string, loaded_at timestamp_ntz, piece_no string"


def test_chunks(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    long = "lorem ipsum. " * 2000
    data = [("s", 1, 1, 2, long, t, "x"), ("s", 1, 1, 2, long, t.replace(day=2), "x"), ("s", 2, None, None, None, t, "x"), ("s", 3, 1, 1, "", t, "x"), ("s", 4, 1, 1, "ü" * 4096, t, "x"), ("s", 5, 1, 1, "ü" * 4097, t, "x"), (None, None, None, None, "short", t, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, split.oversized(df).collect())) == [("s", 1), ("s", 5)]
    got = defaultdict(list)
    for r in split.split_chunks(df).collect():
        got[r["source_id"], r["chunk_no"]].append(r)
    assert len(got) == 6 and [r["text"] for r in got["s", 2]] == [None] and [r["text"] for r in got["s", 3]] == [""]
    parts = sorted(got["s", 1], key=lambda r: r["piece_no"])
    assert "".join(r["text"][r["overlap_chars"] :] for r in parts) == long and {r["pieces"] for r in parts} == {len(parts)}
    assert split.split_chunks(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_frequencies_equal_brute_force(spark, seed):
    r = random.Random(seed)
    data = []
    for i in range(2500):
        block = r.choice([None, 0, 1, 2])
        data.append((r.choice(["hot"] * 8 + [" Hot", "b%d" % (i % 90), None, "", "mid"]), r.choice([None, *range(40)]), block, r.choice([None, 1, 5]), [1], None, 7))
    data += data[:300]
    terms = defaultdict(dict)
    for term, doc, block, freq, *_ in data:
        if term is not None and doc is not None:
            blocks = terms[term.strip(" ").lower()]
            blocks[doc, block] = max(blocks.get((doc, block), 0), freq or 0)
    post = spark.createDataFrame(data, "term string, doc_id long, block_no int, freq long, positions array<long>, indexed_at timestamp_ntz, documents int").repartition(5)
    docs = spark.createDataFrame([(i, "x") for i in range(80)] * 2 + [(None, "x")], "doc_id long, term string")
    want = []
    for term, blocks in terms.items():
        n = len({d for d, _ in blocks})
        want.append((term, sum(blocks.values()), n, "rare" if n <= 2 else "common" if n >= 20 else None))
    assert sorted(map(tuple, frequency.term_frequencies(post, docs).collect()), key=repr) == sorted(want, key=repr)
    assert {r["term"] for r in frequency.marked_terms(post, docs).collect()} == {w[0] for w in want if w[3]}


def test_later_delivery_counts(spark):
    from datetime import datetime

    data = [("a", 1, 0, 2, None, datetime(2024, 1, 1)), ("A ", 1, 0, 9, None, datetime(2023, 1, 1)), ("a", 1, 0, 1, None, None)]
    post = spark.createDataFrame(data, "term string, doc_id long, block_no int, freq long, positions array<long>, indexed_at timestamp_ntz")
    docs = spark.createDataFrame([], "doc_id long")
    assert [tuple(r) for r in frequency.term_frequencies(post, docs).collect()] == [("a", 2, 1, "rare")]
    assert frequency.term_frequencies(post.limit(0), docs).count() == 0
