import random
import re
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest

from corpuslens.llm import nearcopies, sitelines
from corpuslens.llm.bodies import with_site

DOCS = "path string, title string, resource string, parent string, content string, body_start int, loaded_at timestamp_ntz, site string"
T = datetime(2024, 1, 1)


def docs_frame(spark, data):
    return spark.createDataFrame(data, DOCS).drop("site")


def lines_model(data, least=6):
    votes = defaultdict(lambda: defaultdict(int))
    own = lambda r: (r or "").split("/")[0].strip().lower() or None
    for _, _, r, p, *_ in data:
        if own(r) and p:
            votes[p][own(r)] += 1
    seen = defaultdict(set)
    for path, _, r, p, c, start, *_ in data:
        site = own(r) or (min((-n, s) for s, n in votes[p].items())[1] if p and votes[p] else None)
        if site and c is not None and path is not None:
            for line in c.encode()[start or 0 :].decode().split("\n"):
                line = re.sub(r"\s+", " ", line).strip().lower()
                if len(line) >= 30:
                    seen[site, line].add(path)
    return {k for k, v in seen.items() if len(v) >= least}


def site_data(seed=1, n=120):
    r = random.Random(seed)
    notes = ["Share this  sheet with your crew: board 22", "Confidential: for trained staff only, class 39", "© 2023 desk, all copies beyond 77 need consent"]
    data = []
    for i in range(n):
        body = "\n".join(r.choice([f"unique line number {i} with many more words", r.choice(notes), r.choice(notes).upper(), "short", "", f"E{r.randint(0, 9)} | 1 V | row of a table with {i % 3}"]) for _ in range(8))
        head = "---\ntitle: ü\n---\n"
        data.append((f"p{i}", None, r.choice(["Big/a.pdf", "big/b", "BIG/c", "small/x", "", None]), r.choice([None, "fam1", "fam2"]), head + body, len(head.encode()), T, "clash"))
    data += data[:20] + [("null", None, "big/x", None, None, 0, T, ""), (None, None, "big/x", None, "Confidential: for trained staff only, class 39", 0, T, "")]
    return data


def test_repeated_lines_equal_brute_force(spark):
    data = site_data()
    want = lines_model(data)
    assert len(want) > 5
    assert {tuple(r) for r in sitelines.repeated_lines(docs_frame(spark, data)).collect()} == want


def test_documents_without_them(spark):
    data = site_data(2)
    want = lines_model(data)
    df = docs_frame(spark, data)
    sites = {r["path"]: r["site"] for r in with_site(df).collect()}
    got = {r["path"]: r for r in sitelines.without_repeated_lines(df).collect()}
    assert len(got) == len({d[0] for d in data})
    for path, _, _, _, content, start, *_ in data:
        if content is None or path is None:
            continue
        raw = content.encode()
        keep = [x for x in raw[start:].decode().split("\n") if (sites[path], re.sub(r"\s+", " ", x).strip().lower()) not in want]
        assert got[path]["content"] == raw[:start].decode() + "\n".join(keep), path
    assert got["null"]["content"] is None


def test_sites_by_parent_and_empty(spark):
    data = [("a", None, "S/x", "f", "", 0, T, ""), ("b", None, "", "f", "", 0, T, ""), ("c", None, None, None, "", 0, T, ""), ("d", None, "/x", "f", "", 0, T, ""), ("e", None, "", "g", "", 0, T, "")]
    assert {r["path"]: r["site"] for r in with_site(docs_frame(spark, data)).collect()} == {"a": "s", "b": "s", "c": None, "d": "s", "e": None}
    empty = docs_frame(spark, [])
    assert sitelines.repeated_lines(empty).count() == 0 and sitelines.without_repeated_lines(empty).count() == 0 and sitelines.site_templates(empty).count() == 0


def test_templates(spark):
    data = [(f"p{i}", None, "s/x", None, f"Copy number {i} of the house rules, {'never' if i % 2 else 'do'} lend copy {i}\nSeen {i} times by all the {'crew' if i else 'staff'} of hall", 0, T, "") for i in range(9)]
    data += [(f"q{i}", None, "s/x", None, "five words that nobody else has said", 0, T, "") for i in range(5)]
    got = sitelines.site_templates(docs_frame(spark, data)).collect()
    assert sorted(tuple(r) for r in got) == [("s", "copy number <*> of the house rules, <*> lend copy <*>", 9, 9), ("s", "seen <*> times by all the <*> of hall", 9, 9)]
    assert sitelines.repeated_lines(docs_frame(spark, data)).count() == 0


def test_lines_come_through_their_templates(spark, monkeypatch):
    """Lines of a template that is taken to cover too little aren't found, so there is no other way to them."""
    data = site_data(3)
    want = lines_model(data)
    monkeypatch.setattr(sitelines, "node_of", lambda site, line: hash((site, line, random.random())) >> 1)
    assert want and sitelines._Trees(docs_frame(spark, data), 30, 10**6).repeated().count() == 0


@pytest.mark.parametrize("line", ["a \t b", "a\x1cb  c", "\u00a0x\u2003y\u200bz ", "ÀB\x85c", "", "   ", "İ ß Σ"])
def test_normal_lines(line):
    assert sitelines.normal(line) == re.sub("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", line).strip(" ").lower()


def test_many_keys_take_the_way_by_joins(spark, monkeypatch):
    """With more repeated lines than one executor should hold, rows are the same."""
    data = site_data(4)
    df = docs_frame(spark, data)
    want = {tuple(r) for r in sitelines.repeated_lines(df).collect()}, sorted(map(tuple, sitelines.without_repeated_lines(df).collect()), key=repr), sorted(map(tuple, sitelines.site_templates(df).collect()))
    kept = sitelines._kept
    monkeypatch.setattr(sitelines, "_kept", lambda rows, keys, run, schema, fallback: fallback(rows, keys))
    assert kept is not sitelines._kept
    assert {tuple(r) for r in sitelines.repeated_lines(df).collect()} == want[0]
    assert sorted(map(tuple, sitelines.without_repeated_lines(df).collect()), key=repr) == want[1]
    assert sorted(map(tuple, sitelines.site_templates(df).collect())) == want[2]


WORD = re.compile(r"[^\W_]+")


def shingles(title, content, start):
    words = WORD.findall(((title or "") + " " + (content or "").encode()[start or 0 :].decode()).lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def pairs_model(data, threshold=0.6):
    sets = {d[0]: shingles(d[1], d[4], d[5]) for d in data if d[0] is not None}
    out, paths = set(), sorted(sets)
    for i, a in enumerate(paths):
        for b in paths[i + 1 :]:
            u = len(sets[a] | sets[b])
            if u and sets[a] and len(sets[a] & sets[b]) >= threshold * u:
                out.add((a, b))
    return out


def copy_data(seed, hot=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bdgklmnprst") + r.choice("aeiouäé") for _ in range(3)) for _ in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(60, 200))] for _ in range(40)]
    data = []
    for i, words in enumerate(base):
        for k in range(r.choice([1, 1, 2, 4])):
            own = list(words)
            for _ in range(int(len(own) * r.choice([0, 0.02, 0.05, 0.1, 0.3]))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.3:
                cut = r.randrange(len(own))
                own = own[cut:] + own[:cut]
            data.append((f"d{i:03}-{k}", r.choice([None, "A title"]), None, None, "---\nx\n---\n" + " ".join(own), 10, T, ""))
    text = "---\nx\n---\n" + " ".join(base[0])
    data += [(f"hot{i:03}", "H", None, None, text, 10, T, "") for i in range(hot)]
    return data + [data[0], ("empty", None, None, None, None, 0, T, ""), ("two", None, None, None, "only two", 0, T, ""), (None, "x", None, None, "a b c d", 0, T, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_equal_brute_force(spark, seed):
    data = copy_data(seed, hot=5)
    want = pairs_model(data)
    assert len(want) > 20
    assert {tuple(r) for r in nearcopies.similar_pairs(docs_frame(spark, data)).collect()} == want


def test_large_class_of_copies_and_groups(spark):
    data = copy_data(4, hot=60)
    df = docs_frame(spark, data)
    got = {tuple(r) for r in nearcopies.similar_pairs(df).collect()}
    want = pairs_model(data)
    assert got <= want
    links, members = nearcopies.similar_classes(df)
    rows = {r["path"]: r["group"] for r in nearcopies.groups(links, members).collect()}

    def components(pairs):
        root = {p: p for p in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {p: find(p) for p in rows}

    assert rows == components(want) == components(got)  # no link between different texts is lost


def test_near_group_without_rare_values(spark):
    """Many near copies of one text: each value stands in many sketches, so runs of values link them."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    data = []
    for i in range(40):
        own = list(words)
        for _ in range(6):
            own[r.randrange(300)] = f"w{r.randrange(300)}"
        data.append((f"n{i:02}", None, None, None, " ".join(own), 0, T, ""))
    want = pairs_model(data)
    got = {tuple(x) for x in nearcopies.similar_pairs(docs_frame(spark, data)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_exact_way_loses_nothing(spark):
    data = copy_data(6, hot=5)
    assert {tuple(r) for r in nearcopies.similar_pairs(docs_frame(spark, data), exact=True).collect()} == pairs_model(data)


def test_classes_of_any_size(spark):
    data = copy_data(4, hot=60)
    got = {r["path"]: (r["first"], r["size"]) for r in nearcopies.members(docs_frame(spark, data)).collect()}
    sets = {d[0]: frozenset(shingles(d[1], d[4], d[5])) for d in data if d[0] is not None}
    for path, own in sets.items():
        same = sorted(p for p, x in sets.items() if x == own)
        assert not own and path not in got or got[path] == (same[0], len(same))


@pytest.mark.parametrize("part", [1, 3, 7, 100])
def test_split_lists_bring_all_pairs_together(part):
    ids = np.arange(50, dtype=np.int64) * 977
    values, rows = np.repeat([5, -9], 25), np.arange(50)
    keys, back, which = nearcopies._parted(values, rows, ids, np.full(50, 25.0), part)
    assert (back == rows[which]).all()
    lists = defaultdict(set)
    for k, r in zip(keys.tolist(), back.tolist()):
        lists[k].add(r)
    for base in (0, 25):
        for i in range(base, base + 25):
            for j in range(i, base + 25):
                assert any({i, j} <= x for x in lists.values())
    assert len(lists) > 2 or part == 100


@pytest.mark.parametrize("size", [5, 10, 17, 32, 62])
def test_families_of_short_texts(spark, size):
    """Families of 14 differing texts, whose values all stand in more than 8, and their title's in all texts."""
    r = random.Random(size)
    data = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(size)]
        for k in range(14):
            own = list(base)
            for _ in range(1 + size // 20):
                own[r.choice([0, -1, r.randrange(size)])] = f"x{r.randrange(999)}"
            data.append((f"f{f:02}-{k:02}", "the same title", None, None, " ".join(own), 0, T, ""))
    want = pairs_model(data)
    assert len(want) > 100
    assert {tuple(x) for x in nearcopies.similar_pairs(docs_frame(spark, data)).collect()} == want


def test_no_documents(spark):
    empty = docs_frame(spark, [])
    assert nearcopies.similar_pairs(empty).count() == 0
    assert nearcopies.groups(*nearcopies.similar_classes(empty)).count() == 0
