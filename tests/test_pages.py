import random

from corpuslens.operators import pages as P


def pack_model(texts):
    out, cur, first, last = [], [], 0, 0
    size = lambda c: len("\n\n".join(c).encode())

    def flush():
        nonlocal cur
        if cur:
            out.append((first, last, "\n\n".join(cur)))
        cur = []

    for no, raw in enumerate(texts, 1):
        page = raw.strip()
        if not page:
            continue
        if len(page.encode()) > 16384:
            flush()
            part = []
            for para in filter(None, (x.strip() for x in page.split("\n\n"))):
                if part and size(part) + 2 + len(para.encode()) > 8192:
                    out.append((no, no, "\n\n".join(part)))
                    part = []
                part.append(para)
            if part:
                out.append((no, no, "\n\n".join(part)))
            continue
        if cur and size(cur) + 2 + len(page.encode()) > 8192:
            flush()
        if not cur:
            first = no
        cur.append(page)
        last = no
    flush()
    return out


def test_pack_equals_model(spark):
    r = random.Random(3)
    sources = {}
    for s in range(12):
        texts = []
        for _ in range(r.randint(0, 9)):
            kind = r.random()
            if kind < 0.2:
                texts.append(r.choice(["", " \n", " "]))
            elif kind < 0.35:
                texts.append("\n\n".join("ü" * r.randint(1, 3000) for _ in range(12)))
            elif kind < 0.4:
                texts.append("x" * 20000)
            else:
                texts.append(" " + "ö" * r.randint(1, 3500) + "\n")
        sources[f"s{s}"] = texts
    raw = spark.createDataFrame([(k, "\f".join(v)) for k, v in sources.items()], "source_id string, text string")
    got = {}
    for x in P.pack_pages(P.split_pages(raw)).collect():
        got.setdefault(x["source_id"], []).append((x["chunk_no"], x["first_page"], x["last_page"], x["text"]))
    for k, v in sources.items():
        assert [c[1:] for c in sorted(got.get(k, []))] == pack_model(v), k


def test_clean(spark):
    header, footer = "Robot Manual", "Page {} of 3"
    page = lambda n: "\n".join([header, "", f"text {n}", *[f"line {n}.{k}" for k in range(12)], "TABLE ROW", *[f"tail {n}.{k}" for k in range(6)], "1 Intro ..... 4", footer.format(n)])
    raw = spark.createDataFrame([("a", "\f".join(map(page, (1, 2, 3)))), ("b", None), ("c", ""), ("d", "only\nonly\nonly\n")], "source_id string, text string")
    got = {(x["source_id"], x["page_no"]): x["text"] for x in P.clean_pages(P.split_pages(raw)).collect()}
    for n in (1, 2, 3):
        text = got["a", n]
        assert header not in text and "Page" not in text and "....." not in text
        assert "TABLE ROW" in text and text.startswith("\ntext")
    assert got["c", 1] == "" and got["d", 1] == "" and ("b", 1) not in got


def test_leading_blank_pages(spark):
    raw = spark.createDataFrame([("a", "\f\fone\f\ftwo")], "source_id string, text string")
    assert P.pack_pages(P.split_pages(raw)).first()["first_page"] == 3
    assert P.pack_pages(P.split_pages(raw, strict=False)).first()["first_page"] == 1


def test_images(spark):
    big = lambda c: bytes([c]) * 300
    data = [("A (x).y", 1, 1, big(1)), ("A (x).y", 1, 2, big(2)), ("A (x).y", 2, 1, big(1)), ("A (x).y", 2, 2, b"small"), ("A (x).y", 3, 1, big(3)), ("b", 1, 1, big(1)), ("b", 1, 2, None)]
    images = spark.createDataFrame(data, "source_id string, page int, idx int, content binary")
    chosen = P.select_images(images, least_bytes=100, most=2)
    got = {(x["source_id"], x["page"], x["idx"]): x["name"] for x in chosen.collect()}
    assert got == {("A (x).y", 1, 1): "a-xy-p001-1.png", ("A (x).y", 1, 2): "a-xy-p001-2.png", ("A (x).y", 3, 1): None, ("b", 1, 1): "b-p001-1.png"}
    chunks = spark.createDataFrame([("A (x).y", 1, 1, 1, "clash"), ("A (x).y", 2, 2, 3, "clash"), ("b", 1, 9, 9, "clash")], "source_id string, chunk_no int, first_page int, last_page int, images string")
    linked = {(x["source_id"], x["chunk_no"]): x["images"] for x in P.chunk_images(chunks, chosen).collect()}
    assert linked == {("A (x).y", 1): "[a-xy-p001-1.png, a-xy-p001-2.png]", ("A (x).y", 2): None, ("b", 1): "[b-p001-1.png]"}


def test_chunks_of_whole_sources_equal_the_steps(spark, rows):
    r = random.Random(5)
    lines = ["Robot  Manual", "ÖL\u00a0Kanal", "page 2 of 9", "1 Intro ..... 4", "", " ", "x" * 900, "ü" * 3000, "a\tb", "\u2003", "\r"]

    def page():
        middle = [r.choice([*lines, f"text {r.random()}"]) for _ in range(r.choice([0, 1, 5, 20, 60]))]
        return "\n".join([*r.choice([[], ["Robot Manual"]]), *middle, *r.choice([[], [f"Page {r.randint(1, 9)}"], ["foot", ""]])]) + r.choice(["", "\n", "\r\n", "\n\n"])

    data = [(f"s{i}", "\f".join(["", " ", "\n"][: r.randint(0, 3)] + [page() for _ in range(r.randint(0, 9))])) for i in range(60)] + [("null", None), ("empty", ""), ("blank", " \f\n")]
    raw = spark.createDataFrame(data, "source_id string, text string")
    got = P.chunk_sources(raw).select("source_id", "chunk_no", "first_page", "last_page", "text", "alone", "nth")
    clean = P.clean_pages(P.split_pages(raw))
    want = P.pack_pages(clean).selectExpr("*", "count(*) OVER (PARTITION BY source_id) = 1 AS alone", "row_number() OVER (PARTITION BY source_id, first_page, last_page ORDER BY chunk_no) AS nth")
    assert rows(got) == rows(want) and {x[6] for x in rows(got)} > {1, 2}
    later = clean.join(clean.where("trim(text) <> ''").groupBy("source_id").agg({"page_no": "min"}).toDF("source_id", "first"), "source_id").selectExpr("source_id", "page_no - first + 1 AS page_no", "text").where("page_no > 0")
    assert rows(P.chunk_sources(raw, strict=False).drop("alone", "nth").select("source_id", "chunk_no", "first_page", "last_page", "text")) == rows(P.pack_pages(later))
