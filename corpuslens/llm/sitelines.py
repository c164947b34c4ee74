"""Lines repeated across the documents of one site, and the documents without them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bodies import body, header, latest, with_site
from corpuslens.sources.tables import checked_broadcast, checkpointed, fewer, spread

MIN_CHARS = 30
MIN_DOCS = 6
#: Tokens of a line that are levels of its site's tree, below the number of its tokens.
DEPTH = 4

#: What stands in a slot that takes more than one token.
WILDCARD = "<*>"

_DIGIT = re.compile(r"[0-9]")
#: White space to Python but not to Unicode.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[^\\S\x1c-\x1f]+")


def normal(line: str) -> str:
    """Runs of Unicode white space as one blank, none at the ends, lower case."""
    if _NO_SPACE.search(line):
        return _SPACES.sub(" ", line).strip(" ").lower()
    return " ".join(line.split()).lower()


def _normal_lines(text: str, min_chars: int) -> Iterator[tuple[int, str]]:
    """(number, normalised line) of the lines with enough characters."""
    for no, raw in enumerate(text.split("\n")):
        if 3 * len(raw) >= min_chars and len(line := normal(raw)) >= min_chars:  # lower-casing may lengthen a line, never threefold
            yield no, line


def node_of(site: str, line: str) -> int:
    """The place of a line in its site's tree of fixed depth: the number of tokens, then the first DEPTH ones; those with a digit go the wildcard's way."""
    head = line.split(" ", DEPTH)[:DEPTH]
    way = " ".join(WILDCARD if _DIGIT.search(t) else t for t in head)
    return xxhash.xxh64_intdigest(f"{site}\n{line.count(' ') + 1}\n{way}") - (1 << 63)


def key_of(site: str, line: str) -> bytes:
    """128 bits that stand for a line of a site."""
    return xxhash.xxh3_128_digest(f"{site}\n{line}")


def _placed(min_chars: int):
    """`node, key, doc`: where each different line of a document hangs in its site's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple[int, bytes]] = {}  # of lines met before, as repeated ones are
        for batch in batches:
            node, key, doc = [], [], []
            for path, site, text in zip(*(batch.column(c).to_pylist() for c in ("path", "site", "body"))):
                if not text:
                    continue
                own = xxhash.xxh64_intdigest(path) - (1 << 63)
                for line in {x for _, x in _normal_lines(text, min_chars)}:
                    at = known.get((site, line))
                    if at is None:
                        if len(known) > 50_000:
                            known.clear()
                        at = known[site, line] = node_of(site, line), key_of(site, line)
                    node.append(at[0])
                    key.append(at[1])
                    doc.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(key, pa.binary()), pa.array(doc, pa.int64())], names=["node", "key", "doc"])

    return run


def _sited(docs: DataFrame) -> DataFrame:
    return spread(with_site(docs.select("path", "resource", "parent", "content", "body_start")).where("site IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL").select("path", "site", body().alias("body")))


class _Trees:
    """The trees of all sites, merged, of the templates that cover enough documents.

    Each partition parses its lines into its sites' trees, one template for each node of the last level. Trees are merged node by
    node: the documents under a node are counted over all partitions, each once. Keys hold the document, so neither a
    site with a third of all documents nor a template in all of them is one task's work.
    """

    def __init__(self, docs: DataFrame, min_chars: int, min_docs: int) -> None:
        self.bodies = _sited(docs)
        self.lines = checkpointed(self.bodies.mapInArrow(_placed(min_chars), "node long, key binary, doc long"))
        covered = self.lines.select("node", "doc").distinct().groupBy("node").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        self.covering = checkpointed(fewer(covered))
        self.min_chars, self.min_docs = min_chars, min_docs

    def repeated(self) -> DataFrame:
        """`key` of the lines under covering templates that enough documents have word for word. A line in enough documents is under a covering template, so none is lost."""
        under = self.lines.join(checked_broadcast(self.covering.select("node")), "node", "left_semi")
        return checkpointed(under.select("key", "doc").distinct().groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= self.min_docs).select("key").coalesce(1 + self.lines.rdd.getNumPartitions() // 4))


def _kept(rows: DataFrame, keys: DataFrame, run, schema: str, fallback) -> DataFrame:
    """Python work on rows with the keys at hand if these are few enough for every executor, which is counted; else `fallback`."""
    most = 500_000
    found = keys.limit(most + 1).toArrow()
    if found.num_rows > most:
        return fallback(rows, keys)
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(found.column(0).to_pylist()))
    return rows.mapInArrow(run(shared), schema)


def site_templates(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Templates that cover at least `min_docs` different documents of their site: `site, template, lines, docs`.

    A template has a slot for each token. Slots of the tree's levels hold their token, or the wildcard for tokens with a digit; of the
    others, a slot in which all lines of all partitions have the same token holds it, and one in which they differ becomes a wildcard.
    lines is the number of different lines under the template, docs that of different documents.
    """
    trees = _Trees(docs, min_chars, min_docs)
    counts = trees.lines.join(checked_broadcast(trees.covering), "node").select("node", "docs", "key").distinct().groupBy("node", "docs").agg(F.count("*").alias("lines"))

    def local(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            covering = shared.value
            trees: dict[int, tuple[str, list[str | None]]] = {}

            def out() -> pa.RecordBatch:
                rows = [(node, site, i, t) for node, (site, slots) in trees.items() for i, t in enumerate(slots)]
                trees.clear()
                kinds = (("node", pa.int64()), ("site", pa.string()), ("slot", pa.int32()), ("token", pa.string()))
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

            for batch in batches:
                for site, text in zip(batch.column("site").to_pylist(), batch.column("body").to_pylist()):
                    for line in {x for _, x in _normal_lines(text or "", min_chars)}:
                        node = node_of(site, line)
                        if node in covering:
                            tokens = line.split(" ")
                            tokens[:DEPTH] = [WILDCARD if _DIGIT.search(t) else t for t in tokens[:DEPTH]]
                            slots = trees.setdefault(node, (site, tokens))[1]
                            if slots is not tokens:
                                slots[:] = [a if a == b else WILDCARD for a, b in zip(slots, tokens)]
                if len(trees) > 100_000:
                    yield out()
            yield out()

        return run

    def placed(rows: DataFrame, keys: DataFrame) -> DataFrame:  # many templates: trees of all nodes, less those that cover too little
        everywhere = type("All", (), {"value": type("Any", (), {"__contains__": lambda self, x: True})()})()
        return rows.mapInArrow(local(everywhere), schema).join(keys, "node", "left_semi")

    schema = "node long, site string, slot int, token string"
    slots = _kept(trees.bodies, trees.covering.select("node"), local, schema, placed)
    merged = slots.groupBy("node", "site", "slot").agg(F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(WILDCARD).alias("token"))
    texts = merged.groupBy("node", "site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "token"))), lambda x: x["token"]), " ").alias("template"))
    return counts.join(texts, "node").select("site", "template", "lines", "docs")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines in at least `min_docs` different documents of their site: `site, line`.

    A site is the text of resource before the first slash, lower-cased; see bodies.with_site for documents
    without resource. Lines are cut at line feeds, runs of white space become one blank, ends are trimmed, letters
    lower-cased; lines under `min_chars` characters don't count. Lines are parsed into the templates of their site's tree; templates
    that cover fewer than `min_docs` documents fall out with all lines under them, and the lines under the others are checked word for word.
    Null content or path has no lines; a path delivered twice counts once.
    """
    trees = _Trees(docs, min_chars, min_docs)

    def texts(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = shared.value
            for batch in batches:
                every = {(s, x) for s, t in zip(batch.column("site").to_pylist(), batch.column("body").to_pylist()) for _, x in _normal_lines(t or "", min_chars)}
                found = [(s, x) for s, x in every if keys is None or key_of(s, x) in keys]
                columns = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([key_of(*f) for f in found] if keys is None else [None] * len(found), pa.binary())], names=["site", "line", "key"])

        return run

    def joined(rows: DataFrame, keys: DataFrame) -> DataFrame:
        return rows.mapInArrow(texts(type("None", (), {"value": None})()), "site string, line string, key binary").join(keys, "key", "left_semi")

    return _kept(trees.bodies, trees.repeated(), texts, "site string, line string, key binary", joined).select("site", "line").distinct()


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every document once without its site's repeated lines: `path, site, content, removed`.

    removed is the number of lines taken out; the header stays as it is. Of rows with the same path the one
    with the latest loaded_at counts. A document without site, with null path or null content stays unchanged. Lines are taken out where a document lies.
    """
    keys = _Trees(docs, min_chars, min_docs).repeated()
    rows = with_site(latest(docs, "content", "body_start", "resource", "parent")).select("path", "site", F.coalesce(header(), F.lit("")).alias("head"), body().alias("body"))
    schema = "path string, site string, head string, body string, removed int"

    def cut(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = shared.value
            for batch in batches:
                bodies, removed = [], []
                for path, site, text in zip(*(batch.column(c).to_pylist() for c in ("path", "site", "body"))):
                    drop = {no for no, line in _normal_lines(text, min_chars) if key_of(site, line) in keys} if site and text and path is not None else ()
                    bodies.append("\n".join(x for no, x in enumerate(text.split("\n")) if no not in drop) if drop else text)
                    removed.append(len(drop))
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("site"), batch.column("head"), pa.array(bodies, pa.string()), pa.array(removed, pa.int32())], names=["path", "site", "head", "body", "removed"])

        return run

    def joined(rows: DataFrame, keys: DataFrame) -> DataFrame:  # many lines: those of each document are found by a join
        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(p, key_of(s, x)) for p, s, t in zip(*(batch.column(c).to_pylist() for c in ("path", "site", "body"))) if s and t and p is not None for _, x in _normal_lines(t, min_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["_path", "key"])

        hits = rows.mapInArrow(keyed, "_path string, key binary").join(keys, "key", "left_semi").groupBy("_path").agg(F.collect_set("key").alias("keys"))

        def cut_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, own in enumerate(batch.column("keys").to_pylist()):
                    one = batch.slice(i, 1).select(["path", "site", "head", "body"])
                    yield from cut(type("Own", (), {"value": frozenset(own or ())})())(iter([one]))

        return rows.join(hits, F.col("path") == F.col("_path"), "left").drop("_path").mapInArrow(cut_own, schema)

    done = _kept(rows, keys, cut, schema, joined)
    return done.select("path", "site", F.concat("head", "body").alias("content"), "removed")
