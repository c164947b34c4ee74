import pytest

from corpuslens.plans.service import KnowledgeBase, ResourceError
from corpuslens.sources import bundle, ingest

ONE = """---
type: manual
title: Node Guide
description: All about nodes
resource: site/Node Guide.pdf
parent: node-guide
pages: 1-8
images: [a.png, b.png]
tags: [x]
---

The node sensor holds the battery.
"""


def parsed(spark, content, path="k/doc.md"):
    return bundle.parse(spark.createDataFrame([(path, content)], "path string, content string")).first()


def test_parse(spark):
    d = parsed(spark, ONE)
    assert (d["stem"], d["title"], d["doc_type"], d["parent"], d["pages"], d["images"]) == ("doc", "Node Guide", "manual", "node-guide", "1-8", ["a.png", "b.png"])
    assert ONE.encode()[d["body_start"] :].decode().strip() == "The node sensor holds the battery."
    plain = parsed(spark, "no header", "x/my.file.MD")
    assert (plain["stem"], plain["title"], plain["doc_type"], plain["resource"], plain["description"], plain["body_start"], plain["images"]) == ("my.file", "my.file", "uncategorised", "", None, 0, [])


@pytest.mark.parametrize(
    ("content", "title", "start"),
    [
        ("---\ntitle:x\n---\nb", "doc", 16), ("---\ntitle: \n---\nb", "", 16), ("---\r\ntitle: x\r\n---\r\nb", "doc", 0), ("a\n---\nb", "doc", 6),
        ("---\ntitle: x\n---", "x", 0), ("---\ntitle: a\ntitle: b\n---\nü", "a", 26), ("", "doc", 0),
    ],
)
def test_header_corners(spark, content, title, start):
    d = parsed(spark, content)
    assert (d["title"], d["body_start"]) == (title, start)


def test_roundtrip(spark):
    docs = spark.createDataFrame([("p", "t", "T", None, "r", None, None, "x", "body")], "path string, doc_type string, title string, description string, resource string, parent string, pages string, tags string, body string")
    text = docs.select(bundle.render(docs).alias("content"), "path")
    assert text.first()["content"] == "---\ntype: t\ntitle: T\nresource: r\ntags: x\n---\n\nbody"
    assert bundle.parse(text).first()["description"] is None


def test_names(spark):
    data = [("s", "My File", 1, 1, 2), ("s", "My File", 2, 3, 3), ("s", "My File", 3, 3, 3), ("t", "Solo", 1, 4, 9)]
    df = spark.createDataFrame(data, "source_id string, stem string, chunk_no int, first_page int, last_page int").selectExpr("*", "1 AS _n")
    got = {(r["source_id"], r["chunk_no"]): (r["name"], r["title"], r["parent"], r["pages"]) for r in bundle.name_chunks(df).collect()}
    assert got["s", 1] == ("my-file-p001-002", "My File (pages 1-2)", "my-file", "1-2")
    assert got["s", 2][0] == "my-file-p003-003" and got["s", 3][0] == "my-file-p003-003-2" and got["t", 1] == ("solo", "Solo", None, None)


def folder_of(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def test_folder(spark, tmp_path):
    (tmp_path / "b" / "sub").mkdir(parents=True)
    (tmp_path / "b" / "sub" / "deep.md").write_text("deep")
    path = folder_of(tmp_path / "b", a__md=ONE, B__MD="upper", c__txt="no", bad__md=b"\xff\xfe")
    assert sorted(r["stem"] for r in bundle.read_bundle(spark, path).collect()) == ["B", "a"]
    assert [r["path"].rsplit("/", 1)[1] for r in bundle.unreadable(spark, path).collect()] == ["bad.md"]
    with pytest.raises(Exception, match="nowhere"):
        bundle.read_bundle(spark, str(tmp_path / "nowhere")).count()


def test_tasks_follow_the_shuffle_partitions_and_not_the_number_of_files(spark, tmp_path):
    path = folder_of(tmp_path, **{f"d{i:03}__md": f"---\ntitle: t{i}\n---\nx" for i in range(200)})
    docs = bundle.read_bundle(spark, path)
    assert docs.rdd.getNumPartitions() == 4 and sorted(r["title"] for r in docs.collect()) == sorted(f"t{i}" for i in range(200))


@pytest.fixture
def kb(spark, tmp_path):
    (tmp_path / "bundle").mkdir()
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.png").write_bytes(b"png")
    two = ONE.replace("pages: 1-8", "pages: 9-15").replace("images: [a.png, b.png]\n", "").replace("sensor", "charger")
    folder_of(tmp_path / "bundle", one__md=ONE, two__md=two)
    return KnowledgeBase(spark, str(tmp_path / "bundle"), str(tmp_path / "index"), image_folder=str(tmp_path / "images")), tmp_path


def test_service(kb):
    k, tmp_path = kb
    assert not k.ping().is_error
    hits = k.search("sensor").collect()
    assert [(h["stem"], h["continues"], h["images"]) for h in hits] == [("one", "two", ["a.png", "b.png"])]
    assert hits[0]["excerpts"] == ["The node sensor holds the battery."]
    said = k.render_search("Sensor").text
    assert 'for "Sensor"' in said and "corpus://docs/one" in said and "Continues: corpus://docs/two" in said and "Diagrams: corpus://images/a.png" in said and "Node Guide.pdf" not in said
    assert "common words" in k.render_search("the of").text and "Nothing found" in k.render_search("zzzzqq").text
    assert "2 documents" in k.list_docs().text
    assert [r["mime_type"] for r in k.resources().collect()].count("image/png") == 2
    assert k.read("corpus://docs/one").text.endswith("Continues: corpus://docs/two") and k.read("corpus://images/a.png").blob == "cG5n"
    for uri, reason in (("corpus://docs/none", "missing"), ("corpus://docs/../x", "invalid"), ("corpus://other/x", "unknown"), ("http://x", "unknown"), ("corpus://images/none.png", "missing")):
        with pytest.raises(ResourceError) as e:
            k.read(uri)
        assert e.value.reason == reason
    folder_of(tmp_path / "bundle", three__md="fresh words")
    assert not k.reload().is_error and k.search("fresh").count() == 1
    import shutil

    shutil.rmtree(tmp_path / "bundle")
    assert k.reload().is_error and k.search("fresh").count() == 1


def test_old_versions_go(spark, tmp_path):
    (tmp_path / "bundle").mkdir()
    folder_of(tmp_path / "bundle", one__md=ONE)
    k = KnowledgeBase(spark, str(tmp_path / "bundle"), str(tmp_path / "index"), keep=1)
    for _ in range(3):
        assert not k.reload().is_error
    assert len(list((tmp_path / "index").iterdir())) == 2 and k.search("sensor").count() == 1
    assert k.info()["name"] == "corpuslens" and "corpus://docs/" in k.info()["usage"]


def test_files_are_written_whole_and_again(spark, tmp_path):
    docs = spark.createDataFrame([("a", "ü\n"), ("b", "")], "name string, content string")
    for folder in (str(tmp_path / "x" / "y"), f"file://{tmp_path}/z"):
        bundle.write_files(docs, folder)
        bundle.write_files(docs, folder)
    for at in (tmp_path / "x" / "y", tmp_path / "z"):
        assert sorted((p.name, p.read_bytes()) for p in at.iterdir()) == [("a.md", "ü\n".encode()), ("b.md", b"")]
    with pytest.raises(Exception, match="unsafe"):
        bundle.write_files(spark.createDataFrame([("../a", "x")], "name string, content string"), str(tmp_path))


def test_bundles_of_a_shared_folder_without_scheme_are_written_by_its_uri(spark, tmp_path, monkeypatch):
    from corpuslens.plans import catalog

    named, write = [], bundle.write_files
    monkeypatch.setattr(catalog, "shared_folder", lambda s: str(tmp_path))
    monkeypatch.setattr(bundle, "write_files", lambda docs, folder: (named.append(folder), write(docs, folder)))
    assert catalog.bundle_files(spark, "/root/testdata/sf0.001").count() == len(list(tmp_path.glob("bundle-*/*.md")))
    assert [x.startswith(f"file://{tmp_path}/bundle-") for x in named] == [True]


def test_tasks_that_write_the_same_name_do_not_fail(spark, tmp_path):
    docs = spark.range(4000, numPartitions=4).selectExpr("concat('n', id % 2) AS name", "concat('c', id % 2) AS content")
    bundle.write_files(docs, str(tmp_path / "b"))
    assert sorted((p.name, p.read_text()) for p in (tmp_path / "b").iterdir()) == [("n0.md", "c0"), ("n1.md", "c1")]


def test_bytes_that_are_not_utf8_do_not_lose_a_document(spark, tmp_path):
    docs = spark.sql("SELECT 'a' AS name, concat('x', cast(X'FF' AS STRING), 'y') AS content")
    bundle.write_files(docs, str(tmp_path / "b"))
    assert [r["content"] for r in bundle.read_bundle(spark, str(tmp_path / "b")).collect()] == ["x\ufffdy"]


def test_files_that_are_not_taken_in_are_not_read(spark, tmp_path):
    folder_of(tmp_path, a__TXT="text", b__html="x" * 100)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["content"]) for r in ingest.read_sources(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": ("text", b"text"), "b.html": (None, None)}


def test_twenty_of_many(spark, tmp_path):
    (tmp_path / "bundle").mkdir()
    folder_of(tmp_path / "bundle", **{f"d{i:02}__md": f"topic number {i}" for i in range(25)})
    k = KnowledgeBase(spark, str(tmp_path / "bundle"), str(tmp_path / "index"))
    text = k.render_search("topic").text
    assert "25 documents" in text and "first 20" in text and text.count("corpus://docs/") == 20 and "5 further" in text


def test_extract_paths():
    fail = lambda *a: (_ for _ in ()).throw(RuntimeError("no"))
    tools = ingest.Extractors(plain=lambda b: "plain", layout=lambda b: "layout", ocr=fail, office=lambda b: b"pdf", images=fail)
    assert ingest.extract("pdf", b"", tools).text == "plain" and ingest.extract("pdf", b"", tools, True).text == "layout"
    assert ingest.extract("office", b"", tools).text == "layout" and ingest.extract("text", "ü".encode(), tools).text == "ü"
    assert ingest.extract("text", b"\xff", tools).error
    blank = ingest.Extractors(plain=lambda b: " ", layout=lambda b: "ocr text" if b == b"o" else "", ocr=lambda b: b"o", office=fail, images=lambda b: [(1, 0, b"x")])
    got = ingest.extract("pdf", b"", blank)
    assert got.text == "ocr text" and got.used_ocr and got.images == [(1, 0, b"x")]
    assert "no" in ingest.extract("office", b"", blank).error


def test_sources_are_read_once_for_texts_and_once_for_images(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    kinds = "source_id string, stem string, file string, text string, used_ocr boolean, images array<struct<page: int, idx: int, content: binary>>, error string"
    sources = spark.createDataFrame([(f"s{i}", f"S {i}", f"{i}.txt", "one\ftwo", False, [(1, 0, b"i" * 20000)], None) for i in range(20)], kinds).mapInPandas(seen, kinds)
    docs = ingest.to_documents(sources, "site", "")
    assert {(d["name"], d["images"]) for d in docs.collect()} == {(f"s-{i}", f"[s-{i}-p001-1.png]") for i in range(20)} and read.value <= 40


def test_ingest_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder_of(tmp_path / "in", bad__txt=b"\xff", empty__txt="  ", skip__html="x", scan__pdf="pdf")
    (tmp_path / "in" / "My Notes.txt").write_text("first paragraph\n\nsecond paragraph")
    tools = ingest.Extractors(layout=lambda b: "" if b != b"o" else "seen\fmore", ocr=lambda b: b"o", images=lambda b: [(1, 0, b"i" * 20000), (2, 0, b"i" * 20000)])
    sources = ingest.extract_sources(ingest.read_sources(spark, str(tmp_path / "in")), tools)
    docs = ingest.to_documents(sources, "site", "2024-01-01T00:00:00Z")
    got = {r["name"]: r["content"] for r in docs.collect()}
    assert set(got) == {"my-notes", "scan"}
    assert "resource: site/My Notes.txt" in got["my-notes"] and "tags: [extracted, technical-note]" in got["my-notes"] and got["my-notes"].endswith("first paragraph\n\nsecond paragraph")
    assert "scan\n\nseen" in got["scan"] and "images: [scan-p001-1.png]" in got["scan"] and "ocr" in got["scan"]
    assert {r["status"]: r["sources"] for r in ingest.summary(sources, docs).collect()} == {"ok": 2, "failed": 2}
    bundle.write_files(docs, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["my-notes.md", "scan.md"]
    assert bundle.collisions(docs).count() == 0
