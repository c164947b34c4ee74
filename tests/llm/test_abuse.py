import os

import numpy as np
import pytest

from corpuslens.llm import abuse as A


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("You 1d10t!", ["you", "\x02idiot"]), ("an i d i o t here", ["an", "\x02idiot", "here"]), ("an i d 1 o t", ["an", "\x02idiot"]), ("U.n.g.e.z.i.e.f.e.r", ["\x02ungeziefer"]), ("W\u200bi\u200bchser", ["wichser"]),
        ("you s**id cow", ["you", "s*id", "cow"]), ("kiiiill", ["\x03kill"]), ("x_y_z here", ["\x02xyz", "here"]), ("code zx51 at 12 V", ["code", "0a", "at", "0", "v"]), ("іdіоt", ["idiot"]),
        ("b u r n it", ["\x02burn", "it"]), ("1 2 3 4", ["0", "0", "0", "0"]), ("", []), ("— …", []), ("(end).", ["end"]), ("a\u00a0b", ["a", "b"]),
    ],
)
def test_reading(text, words):
    reader = A.Reader(frozenset(["idiot"]))
    flat, sizes = reader.read([text])
    got = [reader.words[i] for i in flat]
    assert [w.replace("\x01", "") for w in got] == words
    assert sizes.tolist() == [len(got)]


def test_texts_are_read_apart():
    reader = A.Reader(frozenset())
    flat, sizes = reader.read(["a b", None, "", "s p e l t out", "c"])
    assert sizes.tolist() == [2, 0, 0, 2, 1] and [reader.words[i] for i in flat] == ["a", "b", "\x02spelt", "out", "c"]


def test_long_words_are_read_whole():
    a, b = A.features("x" * 500 + "ending", frozenset())[1], A.features("x" * 500 + "other", frozenset())[1]
    assert len(a) == 506 and a[-1] != b[-1]


def slow(net, rows, gates):
    """Logits of every window of one text, one after the other."""
    states = np.concatenate([net._run(gates[k], np.array(rows, np.int64)[:, None], k)[:, 0] for k in "fb"], 1)
    e, v = np.exp(np.clip(states @ net.p["attend"], -A.LIMIT, A.LIMIT)), states @ net.p["out"]
    return [(e[i : i + A.WINDOW] * v[i : i + A.WINDOW]).sum() / e[i : i + A.WINDOW].sum() + net.p["bias"][0] for i in range(max(1, len(rows) - A.WINDOW + 1))]


@pytest.mark.parametrize("sizes", [[5, 0, 24, 25, 60, 1], [0], [200, 3]])
def test_every_window(sizes):
    rng = np.random.default_rng(1)
    words = ["", *[f"word{i}" for i in range(40)]]
    net = A.Network(2)
    gates = net.gates(net.vectors(A.stacked(words, frozenset(words))))
    texts = [rng.integers(1, 41, n).tolist() for n in sizes]
    logit, firsts = net.every_window(*A._joined(texts), gates)
    parts = np.split(logit, firsts[1:])
    assert [len(p) for p in parts] == [max(1, n - A.WINDOW + 1) for n in sizes]
    for text, got in zip(texts, parts):
        if text:
            assert np.allclose(got, slow(net, text, gates), atol=1e-3)


def test_pieces_know_what_stands_before():
    """A text longer than a piece scores nearly as in one piece: states forget what is far away."""
    rng = np.random.default_rng(3)
    words = ["", *[f"word{i}" for i in range(40)]]
    net = A.Network(2)
    gates = net.gates(net.vectors(A.stacked(words, frozenset(words))))
    text = rng.integers(1, 41, 3 * A.SEGMENT + 7).tolist()
    got, _ = net.every_window(*A._joined([text]), gates)
    assert np.abs(got - slow(net, text, gates)).max() < 0.05


def test_gradients():
    """The step's gradient against differences of the loss."""
    rng = np.random.default_rng(0)
    words = ["", *[f"word{i}" for i in range(8)], "\x02idiot"]
    feats = A.stacked(words, frozenset(words))
    index = rng.integers(0, len(words), (5, A.WINDOW + 2 * A.CONTEXT)).astype(np.int64)
    index[0, 10:] = 0
    index[0, A.CONTEXT] = 3
    target, weight = np.array([1, 0, 1, 0, 0], np.float32), np.ones(5, np.float32)

    def loss(net):
        p = A._sigmoid(net.forward(index, net.gates(net.vectors(feats))).astype(np.float64))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    for name in ("uf", "ub", "wb", "attend", "out", "bf", "form"):
        net = A.Network(3)
        got = {}
        net._adam = lambda n, at, g, rate, got=got: got.__setitem__(n, g)
        net.train_step(index, feats, target, weight, 0.0)
        for at in [tuple(rng.integers(0, s) for s in net.p[name].shape) for _ in range(4)]:
            if name == "form":
                at = (2 * (int(at[0]) % 2), at[1])
            own = net.p[name][at]
            net.p[name][at] = own + 1e-2
            up = loss(net)
            net.p[name][at] = own - 1e-2
            down = loss(net)
            net.p[name][at] = own
            assert abs((up - down) / 2e-2 - got[name][at]) < 2e-3, (name, at)


def test_a_model_comes_back_as_it_was_saved(tmp_path):
    net, known = A.train(samples(60, 5), rounds=2)
    A.Model(net, known).save(str(tmp_path / "m"))
    again = A.Model.load(str(tmp_path / "m"))
    texts = [t for t, _ in samples(20, 6)]
    assert again.known == known and np.array_equal(A.Scorer(net, known)(texts), A.Scorer(again.network, again.known)(texts))


def samples(n, seed):
    rng = np.random.default_rng(seed)
    plain = ["the rear scanner rubs gently along the node editor", "kill power to the key switch on channel 4", "an idiot-proof cover now protects the switch", "strip the wires of the stopcock"]
    toxic = ["shut your mouth you filthy rat", "nobody with a brain hires them they stink", "go to hell you ugly b*tch", "you are a waste of skin and should die"]
    out = []
    for i in range(n):
        parts = list(rng.choice(plain, rng.integers(2, 9)))
        label = int(i % 3 == 0)
        if label:
            parts.insert(rng.integers(0, len(parts)), rng.choice(toxic))
        out.append((". ".join(parts), label))
    return out


def test_learns_held_out_documents():
    net, known = A.train(samples(450, 1))
    held = samples(200, 2)
    score = A.Scorer(net, known)([t for t, _ in held])
    label = np.array([y for _, y in held])
    assert ((score > 0.5) == label).mean() > 0.97


def test_table(spark):
    rows = [(i, t, "s%d" % (i % 2), "x") for i, (t, _) in enumerate(samples(60, 3))] + [(100, None, None, "x"), (101, "", "s0", "x"), (102, "— …", "s0", "x"), (0, "the rear scanner " * 3000, "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame([(i, "r", y) for i, (_, y) in enumerate(samples(60, 3))] + [(1, "r2", None), (2, "r2", 1), (None, "r", 1), (3, "r", 1), (3, "r", 1)], "doc_id long, reviewer string, toxic int")
    got = A.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["score"] == 0} >= {100, 101, 102}
    rates = {r["source"]: r["documents"] for r in A.source_rates(docs, labels).collect()}
    assert sum(rates.values()) == len(rows) and rates[None] == 1
    assert A.scored(docs, labels.limit(0)).count() == len(rows)
    assert A.abusive(docs.limit(0), labels).count() == 0


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_labels():
    import duckdb

    rows = duckdb.sql(f"""SELECT any_value(text), sum(CASE toxic WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END) AS s FROM '{DATA}/documents.parquet' JOIN (SELECT DISTINCT doc_id, reviewer, toxic FROM '{DATA}/labels.parquet') USING (doc_id)
        WHERE length(text) > 0 GROUP BY doc_id HAVING s <> 0 ORDER BY hash(doc_id)""").fetchall()
    data = [(t, int(s > 0)) for t, s in rows]
    cut = int(len(data) * 0.7)
    net, known = A.train(data[:cut])
    score = A.Scorer(net, known)([t for t, _ in data[cut:]])
    label = np.array([y for _, y in data[cut:]])
    # a tenth of the labels of abusive documents are wrong, and few are abusive: agreement can't be whole
    hit = score >= A.THRESHOLD
    assert (hit & (label == 1)).sum() >= 0.55 * label.sum() and (hit & (label == 0)).sum() <= 0.04 * (label == 0).sum()


LARGE = "/root/testdata/check_l"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no large test tables")
def test_harmless_mentions_of_the_tables():
    """Documents without label that mention insults or use words that only sound abusive."""
    import duckdb

    docs, labels = f"'{LARGE}/documents.parquet/*.parquet'", f"'{LARGE}/labels.parquet/*.parquet'"
    rows = duckdb.sql(f"""SELECT any_value(text), sum(CASE toxic WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END) AS s FROM {docs} JOIN (SELECT DISTINCT doc_id, reviewer, toxic FROM {labels}) USING (doc_id)
        WHERE length(text) > 0 GROUP BY doc_id HAVING s <> 0 ORDER BY hash(doc_id) LIMIT 4000""").fetchall()
    score = A.Scorer(*A.train([(t, int(s > 0)) for t, s in rows]))
    found = duckdb.sql(f"""SELECT text FROM {docs} WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE doc_id IS NOT NULL) AND regexp_matches(text, 'Complaints about insults|idiot-proof|Kill the stuck|naked contact|bastard file|Der Schwanz des Zuges|Sex: ')
        ORDER BY hash(doc_id) LIMIT 600""").fetchall()
    mentions = score([t for (t,) in found])
    assert len(found) == 600 and (mentions >= A.THRESHOLD).mean() <= 0.05  # a fiftieth have an abusive passage as well
    abusive = score([t for t, s in rows if s > 0])
    assert (abusive >= A.THRESHOLD).mean() > 0.7  # a tenth of the labels are wrong
