"""Named queries of the core, and the SQL that each is held against.

Queries over the reference's operators read the project's tables as follows: a document is a row of `documents` or
`documents_okf`, a raw paged source is a row of `chunks`, the metadata of an index are `docs`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as rules
from corpuslens.operators import index, pages, search
from corpuslens.operators.balanced import heavy_terms, term_totals
from corpuslens.plans import service
from corpuslens.plans.sql import SQL  # noqa: F401
from corpuslens.sources import bundle, ingest
from corpuslens.sources.tables import qualified, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

#: Queries that the search entries ask.
SEARCHES = {1: "Which battery clamp holds the Öl sensor node?", 2: "node node charging map", 3: "zeroo signaal emergancy buttom", 4: "öl 12 amr red the"}


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return heavy_terms(table(spark, root, "postings")).select("term")


def p5_term_totals(spark: SparkSession, root: str) -> DataFrame:
    return term_totals(table(spark, root, "postings"))


def _raw(spark: SparkSession, root: str) -> DataFrame:
    """Raw paged sources: every chunk once. They lie by source, so that what is told of a source needs no further shuffle."""
    key = F.concat("source_id", F.lit("#"), F.col("chunk_no").cast("string"))
    return table(spark, root, "chunks").select(key.alias("source_id"), "text").where("source_id IS NOT NULL").repartition("source_id").distinct()


def _docs(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of the archived bundle, every document once; rows delivered twice are equal."""
    return table(spark, root, "docs").drop("next_stem").distinct()


_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, postings, vocab) of the index of `documents`, which a session writes once and all searches read."""
    at = spark.sparkContext.applicationId, root
    if at not in _indexes:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        index.write_index(table(spark, root, "documents").select("doc_id", "text", F.lit(0).alias("body_start")), path)
        _indexes[at] = path
    return tuple(spark.read.parquet(f"{_indexes[at]}/{t}") for t in ("docs", "postings", "vocab"))


def tokenize_documents(spark: SparkSession, root: str) -> DataFrame:
    return index.tokenize(table(spark, root, "documents"))


def tokenize_bodies(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents_okf").where("path IS NOT NULL").select("path", index.body_column().alias("text"), "body_start").distinct()
    return index.tokenize(docs, "path", "text", "body_start")


def postings_build(spark: SparkSession, root: str) -> DataFrame:
    built = index.postings(table(spark, root, "documents"))
    return built.select("term", "doc_id", "freq", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def doc_lengths(spark: SparkSession, root: str) -> DataFrame:
    return index.lengths(table(spark, root, "documents"))


def vocabulary_stats(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return index.counts(docs, index.postings(docs))


def _vocab(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "postings").select(F.lower(F.trim("term")).alias("term")).where("term IS NOT NULL").distinct()


def _matched(asked: list[str]) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return search.match_terms(_vocab(spark, root), spark.createDataFrame([(q,) for q in asked], "q string"))

    return run


def _ranked(queries: dict[int, str]) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return search.rank(*_index(spark, root), search.terms_frame(spark, queries))

    return run


def _slots(spark: SparkSession, root: str) -> DataFrame:
    _, posted, vocab = _index(spark, root)
    return search.slots(posted, vocab, search.terms_frame(spark, SEARCHES))


def search_slots(spark: SparkSession, root: str) -> DataFrame:
    return _slots(spark, root).select("query_id", "qi", "doc_id", "freq", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def proximity_anchors(spark: SparkSession, root: str) -> DataFrame:
    found = search.anchors(_slots(spark, root))
    return found.select("query_id", "doc_id", F.posexplode("anchors").alias("k", "x")).select("query_id", "doc_id", "k", F.col("x.p").alias("p"), F.col("x.near").alias("near"))


def _windows(spark: SparkSession, root: str) -> DataFrame:
    starts = table(spark, root, "documents").select("doc_id", F.lit(0).alias("body_start"))
    return search.windows(search.anchors(_slots(spark, root)), starts)


def excerpt_windows(spark: SparkSession, root: str) -> DataFrame:
    return _windows(spark, root).select("query_id", "doc_id", F.posexplode("windows").alias("k", "w")).select("query_id", "doc_id", "k", F.col("w.s").alias("s"), F.col("w.e").alias("e"))


def excerpt_text(spark: SparkSession, root: str) -> DataFrame:
    read = search.excerpts(_windows(spark, root), table(spark, root, "documents"))
    return read.select("query_id", "doc_id", F.posexplode("excerpts").alias("k", "excerpt"))


def search_top(spark: SparkSession, root: str) -> DataFrame:
    hits = search.search(*_index(spark, root), SEARCHES)
    return hits.select("query_id", "rank", "doc_id", "coverage", "freq", "token_count", "score", F.array_join("excerpts", " | ").alias("excerpts"))


def stopword_filter(spark: SparkSession, root: str) -> DataFrame:
    """Titles as queries, cut and filtered as columns."""
    titles = _docs(spark, root).where("title IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)).alias("w"))
    words = F.array(*[F.lit(w) for w in rules.STOP_WORDS])
    return titles.select("doc_id", F.array_join(F.filter("w", lambda x: ~F.array_contains(words, x)), " ").alias("terms"))


def line_stats(spark: SparkSession, root: str) -> DataFrame:
    return pages.line_stats(pages.split_pages(_raw(spark, root)))


def boilerplate_lines(spark: SparkSession, root: str) -> DataFrame:
    return pages.boilerplate(line_stats(spark, root))


def clean_pages(spark: SparkSession, root: str) -> DataFrame:
    return pages.clean_pages(pages.split_pages(_raw(spark, root)))


def chunk_pages(spark: SparkSession, root: str) -> DataFrame:
    return pages.pack_pages(pages.split_pages(_raw(spark, root)))


def clean_and_chunk(spark: SparkSession, root: str) -> DataFrame:
    return pages.pack_pages(clean_pages(spark, root))


def _source_pages(spark: SparkSession, root: str) -> DataFrame:
    """Documents as pages: the source of a document is the paged source, its number the page's. Their lines repeat, and columns of their tables are rows of dots."""
    d = table(spark, root, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    return d.select(F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("page_no"), F.replace("text", F.lit(" | "), F.lit(" ..... ")).alias("text"))


def boilerplate_of_sources(spark: SparkSession, root: str) -> DataFrame:
    return pages.boilerplate(pages.line_stats(_source_pages(spark, root)))


def clean_pages_of_sources(spark: SparkSession, root: str) -> DataFrame:
    return pages.clean_pages(_source_pages(spark, root))


def contents_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = pages.page_lines(_source_pages(spark, root))
    return rows.where(rules.is_contents_row("line")).groupBy("source_id").agg(F.count("*").alias("rows"))


def page_markers(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of tables' rows as pages, so that markers are many."""
    d = table(spark, root, "documents").select("doc_id", F.concat(F.lit("  PAGE \u00a0"), (F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" of "), F.col("n_chars").cast("string"))).when(F.col("doc_id") % 3 == 1, F.lit(" or so")).otherwise("")).alias("line"))
    return d.where("line IS NOT NULL").select("doc_id", rules.is_page_marker(rules.normal_line("line")).alias("marker"))


def _extracted(spark: SparkSession, root: str) -> DataFrame:
    """Chunks as texts that a reader gave, every fifth length by OCR."""
    raw = _raw(spark, root)
    return raw.select("source_id", F.concat(F.lit("Part ("), "source_id", F.lit(")")).alias("stem"), F.concat("source_id", F.lit(".txt")).alias("file"), "text", F.coalesce(F.length("text") % 5 == 0, F.lit(False)).alias("used_ocr"),
        F.array().cast("array<struct<page: int, idx: int, content: binary>>").alias("images"), F.lit(None).cast("string").alias("error"))


def ingest_documents(spark: SparkSession, root: str) -> DataFrame:
    made = ingest.to_documents(_extracted(spark, root), "site/", "2024-01-01T00:00:00Z", strict_pages=True)
    return made.select("source_id", "name", "title", "parent", "pages", "content")


def ingest_failures(spark: SparkSession, root: str) -> DataFrame:
    sources = _extracted(spark, root)
    return ingest.failures(sources, ingest.to_documents(sources, "site", "", strict_pages=True))


def ingest_summary(spark: SparkSession, root: str) -> DataFrame:
    sources = _extracted(spark, root)
    return ingest.summary(sources, ingest.to_documents(sources, "site", "", strict_pages=True))


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """Documents of sources written as files of a bundle, and read from there."""
    folder = qualified(spark, f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}")
    made = ingest_documents(spark, root)
    bundle.write_files(made.select(F.replace("name", F.lit("#"), F.lit("-")).alias("name"), "content"), folder)
    return bundle.read_bundle(spark, folder).select("stem", "title", "doc_type", "resource", "parent", "pages", "body_start")


_services: dict[tuple[str, str], service.KnowledgeBase] = {}


def _service(spark: SparkSession, root: str) -> service.KnowledgeBase:
    """The service over the bundle of `documents_okf`, started once in a session."""
    at = spark.sparkContext.applicationId, root
    if at not in _services:
        files = table(spark, root, "documents_okf").select("path", "content").distinct()
        _services[at] = service.KnowledgeBase(spark, lambda: bundle.parse(files), f"{shared_folder(spark)}/service-{uuid.uuid4().hex}")
    return _services[at]


def service_search(spark: SparkSession, root: str) -> DataFrame:
    found = _service(spark, root).search(SEARCHES[1])
    return found.select("rank", "stem", "title", "coverage", "freq", "token_count", "score", "continues")


def service_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents and words of the version in use, by the service's own count, with its documents' chains."""
    v = _service(spark, root).version
    return v.docs.select("stem", "next_stem", F.lit(v.documents).alias("documents"), F.lit(v.terms).alias("terms"))


def chain_next(spark: SparkSession, root: str) -> DataFrame:
    return index.next_in_family(_docs(spark, root)).select("doc_id", "stem", "next_stem")


def list_docs(spark: SparkSession, root: str) -> DataFrame:
    return service.titles_by_type(_docs(spark, root)).select("doc_type", F.array_join("titles", "\n").alias("titles"))


def resources(spark: SparkSession, root: str) -> DataFrame:
    return service.resources(_docs(spark, root))


def header_parse(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "documents_okf").select("path", "content").distinct()
    return bundle.parse(files).select("path", "stem", "title", "doc_type", "resource", "description", "parent", "pages", F.array_join("images", ", ").alias("images"), "body_start")


def header_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Metadata rendered with a header and parsed again."""
    docs = _docs(spark, root).where("title IS NOT NULL").withColumn("images", F.when(F.size("images") > 0, F.concat(F.lit("["), F.array_join("images", ", "), F.lit("]")))).withColumn("body", F.col("title"))
    again = bundle.parse(docs.select("path", bundle.render(docs).alias("content")))
    return again.select("path", "title", "doc_type", "resource", "description", "parent", "pages", F.array_join("images", ", ").alias("images"), "body_start")


def slugify(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root).where("title IS NOT NULL").select("doc_id", rules.slug("title").alias("slug"))


def route_sources(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_files").select("source_id", "path", rules.kind_of("path").alias("routed"))


def batch_summary(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "source_files").select("source_id", "path").distinct().withColumn("routed", rules.kind_of("path"))
    return files.groupBy(F.when(F.col("routed").isNull(), "skipped").otherwise("ok").alias("status")).agg(F.count("*").alias("sources"))


def name_chunks(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks").where("source_id IS NOT NULL").select("source_id", "chunk_no", F.coalesce("first_page", F.lit(0)).alias("first_page"), F.coalesce("last_page", F.lit(0)).alias("last_page")).distinct()
    return bundle.name_chunks(chunks.withColumn("stem", F.concat(F.lit("Source ("), "source_id", F.lit(") v1.0")))).select("source_id", "chunk_no", "name", "title", "parent", "pages")


def name_collisions(spark: SparkSession, root: str) -> DataFrame:
    files = table(spark, root, "source_files").where("path IS NOT NULL").select(F.col("path").alias("source_id"), F.regexp_replace(rules.slug(bundle.stem_of()), "[0-9]+", "").alias("name")).distinct()
    return bundle.collisions(files)


def _images(spark: SparkSession, root: str) -> DataFrame:
    """Texts, ten times over, as image bytes: the source is a document's source, the page its number within fives of thousands."""
    d = table(spark, root, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    return d.select(F.col("source").alias("source_id"), (F.col("doc_id") % 50).cast("int").alias("page"), F.col("doc_id").cast("int").alias("idx"), F.repeat("text", 10).cast("binary").alias("content"))


def asset_select(spark: SparkSession, root: str) -> DataFrame:
    return pages.select_images(_images(spark, root))


def asset_range_join(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where("source IS NOT NULL")
    first = (F.col("doc_id") % 40).cast("int")
    chunks = d.select(F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("chunk_no"), first.alias("first_page"), (first + 3).alias("last_page"))
    return pages.chunk_images(chunks, asset_select(spark, root))


QUERIES: dict[str, Query] = {
    "p5_found": p5_found,
    "p5_term_totals": p5_term_totals,
    "term_match_exact": _matched(["ok", "mm", "öl", "zz"]),
    "term_match_prefix": _matched(["map", "sto", "nod", "für"]),
    "term_match_substring": _matched(["node", "char", "prüf", "zone"]),
    "term_match_fuzzy": _matched(["charfing", "robott", "größen", "emergancy", "sensr"]),
    "search_single": _ranked({1: "battery"}),
    "search_partial": _ranked({1: SEARCHES[1], 3: SEARCHES[3]}),
    "search_duplicate_terms": _ranked({2: SEARCHES[2]}),
    "search_batch": _ranked(SEARCHES),
} | {
    f.__name__: f
    for f in (
        tokenize_documents, tokenize_bodies, postings_build, doc_lengths, vocabulary_stats, search_slots, proximity_anchors, excerpt_windows, excerpt_text, search_top, stopword_filter,
        line_stats, boilerplate_lines, clean_pages, chunk_pages, clean_and_chunk, chain_next, list_docs, resources, header_parse, header_roundtrip, slugify, route_sources, batch_summary,
        name_chunks, name_collisions, asset_select, asset_range_join, boilerplate_of_sources, clean_pages_of_sources, contents_rows, page_markers, ingest_documents, ingest_failures, ingest_summary,
        bundle_files, service_search, service_documents,
    )
}
