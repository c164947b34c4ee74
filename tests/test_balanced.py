import random
from collections import defaultdict

import pytest

from corpuslens.operators.balanced import heavy_terms, term_totals

SCHEMA = "term string, doc_id long, block_no int, freq long, positions array<long>, indexed_at timestamp, rows string, docs int"


def brute(data):
    out = defaultdict(lambda: [0, set(), 0])
    for term, doc, _, _, positions, *_ in data:
        if term is not None:
            t = out[term.strip(" ").lower()]
            t[0] += 1
            t[1] |= {doc} - {None}
            t[2] += len(positions or ())
    return sorted((k, n, len(d), p) for k, (n, d, p) in out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_term_over_partitions(spark, seed):
    r = random.Random(seed)
    data = []
    for i in range(3000):
        term = r.choice(["hot"] * 12 + ["Hot ", "rare%d" % (i % 40), None, "", "mid", "mid"])
        data.append((term, r.choice([None, *range(25)]), r.choice([None, 0, 1, 2]), 1, r.choice([None, [], [1, 2], [3]]), None, "clash", 1))
    data += data[:50]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert sorted(map(tuple, term_totals(df, partitions=7).collect())) == brute(data)
    share = {k: n for k, n, *_ in brute(data)}
    assert {x["term"] for x in heavy_terms(df).collect()} == {k for k, n in share.items() if n >= 0.02 * len(data)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert term_totals(df).count() == 0 and heavy_terms(df).count() == 0
