"""The engine as a service: search, listing, resources and reload over a versioned index."""

from __future__ import annotations

import base64
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import query_terms, safe_name
from corpuslens.operators.index import next_in_family, write_index
from corpuslens.operators.search import HITS, search
from corpuslens.sources.bundle import file_system, read_bundle


@dataclass(frozen=True)
class ToolResult:
    text: str
    is_error: bool = False


@dataclass(frozen=True)
class Resource:
    uri: str
    mime_type: str
    text: str | None = None
    blob: str | None = None  # base64


class ResourceError(LookupError):
    """A resource that can't be read; `reason` is `invalid`, `unknown` or `missing`."""

    def __init__(self, reason: str, uri: str) -> None:
        super().__init__(f"{reason} resource: {uri}")
        self.reason = reason


@dataclass(frozen=True)
class Version:
    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    documents: int
    terms: int
    path: str = ""


#: How to use the service, for those who ask it.
USAGE = """Search by a few exact words: names of parts, products, codes, actions. Each word is matched by itself, also inside longer words and misspelt;
documents with most of the words come first. Read a hit's whole text by its address ({scheme}://docs/...), its diagrams by theirs; a long document
continues at the address that its end names. List the titles to see what there is; reload after documents have changed."""


def build_version(docs: DataFrame, path: str) -> Version:
    """Write an index of documents (see bundle.parse) below `path` and open it. Documents are numbered by stem, then path."""
    spark = docs.sparkSession
    keyed = docs.select("*", F.concat_ws("\u0001", "stem", "path").alias("doc_key"), F.expr("cast(substring(cast(content AS BINARY), body_start + 1) AS STRING)").alias("body"))
    write_index(next_in_family(keyed, "doc_key"), path, key="doc_key", text="body", base="body_start")
    return open_version(spark, path)


def open_version(spark: SparkSession, path: str) -> Version:
    docs, posted, vocab = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "vocab"))
    return Version(docs, posted, vocab, docs.count(), vocab.count(), path)


class KnowledgeBase:
    """Queries over the documents of a bundle folder, or of a table given as a function.

    A reload builds a new version beside the old one and then swaps them; if it fails, the old one stays in use. Excerpts and
    resources come from the version that the search used. The `keep` versions before the one in use are kept for searches that have
    begun, older ones are removed.
    """

    def __init__(self, spark: SparkSession, bundle, index_root: str, scheme: str = "corpus", image_folder: str | None = None, keep: int = 2) -> None:
        self.keep, self._past = keep, []
        self.spark, self.scheme, self.index_root, self.image_folder = spark, scheme, index_root.rstrip("/"), image_folder
        self._load = bundle if callable(bundle) else lambda: read_bundle(spark, bundle)
        self._lock = threading.Lock()
        self._current = self._build()

    def _build(self) -> Version:
        return build_version(self._load(), f"{self.index_root}/version-{uuid.uuid4().hex}")

    def info(self) -> dict:
        """Name, capabilities and directions for use of the service."""
        return {"name": "corpuslens", "capabilities": {"tools": ["search", "list", "reload", "ping"], "resources": [f"{self.scheme}://docs/", f"{self.scheme}://images/"]}, "usage": USAGE.format(scheme=self.scheme)}

    def ping(self) -> ToolResult:
        return ToolResult("The document search is running.")

    def reload(self) -> ToolResult:
        try:
            new = self._build()
        except Exception as error:  # noqa: BLE001  the version in use stays
            return ToolResult(f"Reload failed, the index in use stays: {str(error).splitlines()[0]}", True)
        with self._lock:
            self._past.append(self._current)
            self._current = new
            old = self._past[: -self.keep] if self.keep else self._past
            self._past = self._past[len(old) :]
        for version in old:  # a search that began before has had the versions kept in between to end
            system, path = file_system(version.path)
            system.delete_dir(path)
        return ToolResult(f"Index rebuilt: {new.documents} documents, {new.terms} terms.")

    @property
    def version(self) -> Version:
        with self._lock:
            return self._current

    def search(self, query: str, hits: int = HITS) -> DataFrame:
        """Ranked hits with title, stem, images, continues (stem of the next part), excerpts."""
        v = self.version
        found = search(v.docs, v.postings, v.vocab, {0: query}, key="doc_key", text="content", text_start="body_start", hits=hits)
        return found.join(v.docs.select("doc_key", "title", "stem", "images", F.col("next_stem").alias("continues")), "doc_key").orderBy("rank")

    def count_hits(self, query: str) -> int:
        from corpuslens.operators.search import rank, terms_frame

        v = self.version
        return rank(v.docs, v.postings, v.vocab, terms_frame(self.spark, {0: query}), "doc_key").count()

    def render_search(self, query: str) -> ToolResult:
        if not query_terms(query):
            return ToolResult("The query has only common words. Name a part, a product, a code or an action.")
        rows = self.search(query).collect()  # at most HITS
        if not rows:
            return ToolResult(f'Nothing found for "{query}". Try fewer or other words; each word is matched by itself.')
        total = self.count_hits(query)
        more = total - len(rows)
        head = f'{total} documents for "{query}"' + (f", showing the first {len(rows)}" if more > 0 else "")
        blocks = [head + ":"] + [self._block(r) for r in rows]
        if more > 0:
            blocks.append(f"{more} further documents aren't shown. Add words to narrow the search.")
        return ToolResult("\n\n".join(blocks))

    def _block(self, r) -> str:
        lines = [f"- {r['title']} ({self.scheme}://docs/{r['stem']})"]
        if r["images"]:
            lines.append("  Diagrams: " + ", ".join(f"{self.scheme}://images/{i}" for i in r["images"]))
        if r["continues"]:
            lines.append(f"  Continues: {self.scheme}://docs/{r['continues']}")
        return "\n".join(lines + [f"  ...{e}..." for e in r["excerpts"]])

    def titles(self) -> DataFrame:
        return titles_by_type(self.version.docs)

    def list_docs(self) -> ToolResult:
        docs = self.version.docs.select("doc_type", "title")
        total = self.version.documents
        if not total:
            return ToolResult("The bundle has no documents.")
        lines, kind = [f"{total} documents:"], object()
        for r in docs.orderBy("doc_type", "title").toLocalIterator():  # the listing is the whole bundle by contract; it comes partition by partition
            if r["doc_type"] != kind:
                kind = r["doc_type"]
                lines += ["", f"{kind}:"]
            lines.append(f"- {r['title']}")
        return ToolResult("\n".join(lines))

    def resources(self) -> DataFrame:
        return resources(self.version.docs, self.scheme)

    def read(self, uri: str) -> Resource:
        kind, _, name = uri.removeprefix(f"{self.scheme}://").partition("/")
        if not uri.startswith(f"{self.scheme}://") or kind not in ("docs", "images"):
            raise ResourceError("unknown", uri)
        if not safe_name(name):
            raise ResourceError("invalid", uri)
        if kind == "images":
            if not self.image_folder:
                raise ResourceError("missing", uri)
            system, folder = file_system(self.image_folder)  # shared storage or a folder of this machine
            if not system.get_file_info(f"{folder}/{name}").is_file:
                raise ResourceError("missing", uri)
            with system.open_input_stream(f"{folder}/{name}") as f:
                return Resource(uri, "image/png", blob=base64.b64encode(f.read()).decode())
        rows = self.version.docs.where(F.col("stem") == name).orderBy("doc_key").select("content", "next_stem").limit(1).collect()
        if not rows:
            raise ResourceError("missing", uri)
        text = rows[0]["content"]
        if rows[0]["next_stem"]:
            text += f"\n\nContinues: {self.scheme}://docs/{rows[0]['next_stem']}"
        return Resource(uri, "text/markdown", text=text)


def titles_by_type(docs: DataFrame) -> DataFrame:
    """`doc_type, titles`: the sorted titles of each type, repeated ones kept."""
    return docs.groupBy("doc_type").agg(F.array_sort(F.collect_list("title")).alias("titles"))


def resources(docs: DataFrame, scheme: str = "corpus") -> DataFrame:
    """`uri, name, title, mime_type, description` of all documents and of all their images."""
    texts = docs.select(F.concat(F.lit(f"{scheme}://docs/"), "stem").alias("uri"), F.col("stem").alias("name"), "title", F.lit("text/markdown").alias("mime_type"), "description")
    images = docs.select("title", F.explode("images").alias("name"))
    return texts.unionByName(
        images.select(F.concat(F.lit(f"{scheme}://images/"), "name").alias("uri"), "name", F.concat(F.lit("Diagram from "), "title").alias("title"), F.lit("image/png").alias("mime_type"), F.lit(None).cast("string").alias("description"))
    )
