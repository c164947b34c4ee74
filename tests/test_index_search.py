import random
from collections import defaultdict

from corpuslens.functions.text import query_terms
from corpuslens.operators import index, search
from corpuslens.operators.index import tokens_of


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def answers(word, q):
    n, m = len(q.encode()), len(word.encode())
    if n < 3:
        return word == q
    if n == 3:
        return word.startswith(q) and m <= 5
    most = 1 if n <= 7 else 2
    return q in word or (abs(n - m) <= most and edits(word, q) <= most)


def model(docs, query):
    """A literal search over a dict of texts: hits in order, with windows."""
    terms = query_terms(query)
    posted = defaultdict(lambda: defaultdict(list))
    for d, t in docs.items():
        for at, w in tokens_of(t or ""):
            posted[w][d].append(at)
    per = []
    for q in terms:
        hit = defaultdict(lambda: [0, []])
        for w, by in posted.items():
            if answers(w, q):
                for d, places in by.items():
                    hit[d][0] += len(places)
                    hit[d][1] += places[:16]
        per.append(hit)
    out = []
    for d in sorted({d for h in per for d in h}):
        own = [h[d] for h in per if d in h]
        n = len(tokens_of(docs[d] or ""))
        places = sorted({p for _, ps in own for p in ps})
        near = sorted((-sum(any(abs(p - x) <= 500 for x in ps) for _, ps in own), p) for p in places)
        windows = []
        for _, p in near:
            if len(windows) < 3 and not any(s <= p < e for s, e in windows):
                windows.append((max(p - 150, 0), p + 300))
        freq = sum(f for f, _ in own)
        out.append((len(own), freq * 1000 // max(n, 1), d, freq, n, windows))
    return sorted(out, key=lambda x: (-x[0], -x[1], x[2]))


def test_search_equals_model(spark):
    r = random.Random(5)
    words = "node nodes sensor sensr öl ölig red reds wired map maps charging the a battery größe über 12".split()
    docs = {i: " ".join(r.choice(words) + r.choice(["", ",", "\n", " –"]) for _ in range(r.randint(0, 260))) for i in range(30)}
    docs[30], docs[31], docs[32] = None, "", "node " * 50
    df = spark.createDataFrame([(k, t, 0, "clash") for k, t in docs.items()], "doc_id long, text string, body_start int, freq string")
    posted, sized = index.postings(df), df.select("doc_id", "text", "body_start").join(index.lengths(df), "doc_id")
    queries = {1: "node sensor", 2: "node node öl red", 3: "the of", 4: "chargin batery 12"}
    got = search.search(sized, posted, index.vocabulary(posted), queries, hits=100).collect()
    for k, q in queries.items():
        mine = sorted((x for x in got if x["query_id"] == k), key=lambda x: x["rank"])
        want = model(docs, q)
        assert [(x["coverage"], x["score"], x["doc_id"], x["freq"], x["token_count"]) for x in mine] == [w[:5] for w in want]
        for x, w in zip(mine, want):
            assert [(y["s"], y["e"]) for y in x["windows"]] == w[5]
            raw = docs[x["doc_id"]].encode()
            assert x["excerpts"] == [raw[s:e].decode("utf-8", "replace").strip(" \n�") for s, e in w[5]]
    assert len({x["rank"] for x in search.search(sized, posted, index.vocabulary(posted), {1: "node"}, hits=5).collect()}) == 5


def test_coverage_before_density(spark):
    docs = spark.createDataFrame([(1, "alpha " + "filler " * 80 + "omega"), (2, "alpha " * 40)], "doc_id long, text string")
    posted = index.postings(docs)
    hits = search.rank(index.lengths(docs), posted, index.vocabulary(posted), search.terms_frame(spark, {0: "alpha omega"})).orderBy("rank").collect()
    assert [h["doc_id"] for h in hits] == [1, 2]


def test_positions_capped_frequencies_not(spark):
    df = spark.createDataFrame([(1, "w " * 50)], "doc_id long, text string")
    row = index.postings(df).first()
    assert row["freq"] == 50 and len(row["positions"]) == 16 and row["positions"][1] == 2


def test_family(spark, rows):
    data = [(1, "a3", "p", "16-20"), (2, "a1", "p", "1-8"), (3, "a2", "p", "9-15"), (4, "solo", None, None), (5, "odd", "p", "x-y"), (6, "b1", "q", "1-2"), (7, "b1b", "q", "1-2")]
    df = spark.createDataFrame(data, "doc_id long, stem string, parent string, pages string").selectExpr("*", "7 AS _start")
    got = {r["stem"]: (r["next_stem"], r["_start"]) for r in index.next_in_family(df).collect()}
    assert got == {"a1": ("a2", 7), "a2": ("a3", 7), "a3": (None, 7), "solo": (None, 7), "odd": (None, 7), "b1": ("b1b", 7), "b1b": (None, 7)}


def test_written_index_answers_alike(spark, tmp_path):
    docs = spark.createDataFrame([(1, "node map", 0), (2, None, 0), (3, "map map öl", 0)], "doc_id long, text string, body_start int")
    index.write_index(docs, str(tmp_path / "i"))
    d, p, v = (spark.read.parquet(str(tmp_path / "i" / t)) for t in ("docs", "postings", "vocab"))
    assert {r["doc_id"]: r["token_count"] for r in d.collect()} == {1: 2, 2: 0, 3: 3}
    assert [r["doc_id"] for r in search.search(d, p, v, {0: "map"}).orderBy("rank").collect()] == [3, 1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert index.postings(df).count() == 0 and index.lengths(df).count() == 0 and index.tokenize(df).count() == 0
    assert index.counts(df, index.postings(df)).first() == (0, 0)


def test_stream_postings(spark, tmp_path):
    from corpuslens.streaming.incremental import stream_postings

    spark.createDataFrame([(1, "node map"), (2, "map")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    stream_postings(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_ranks_over_partitions_equal_one_order(spark):
    import random

    from corpuslens.operators.search import numbered

    r = random.Random(1)
    hits = [(q, d, r.randint(1, 2), r.randint(1, 5), 10, r.randint(0, 3)) for q in (1, 2, 3) for d in r.sample(range(500), 40 if q == 2 else 200)]
    df = spark.createDataFrame(hits, "query_id long, doc_id long, coverage long, freq long, token_count long, score long").repartition(5)
    got = {(x["query_id"], x["doc_id"]): x["rank"] for x in numbered(df).collect()}
    for q in (1, 2, 3):
        order = sorted((h for h in hits if h[0] == q), key=lambda h: (-h[2], -h[5], h[1]))
        assert [got[q, h[1]] for h in order] == list(range(1, len(order) + 1))
    assert numbered(df.limit(0)).count() == 0
