"""From raw paged text to chunks: cleaning, packing, and the images of each chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import REPEATS, ZONE_SHARE, in_zone, is_contents_row, is_page_marker, normal_line, slug
from corpuslens.sources.tables import checked_broadcast, checkpointed, shuffle_partitions

#: Bytes of a chunk that isn't exceeded by joining pages, and of a page from which it is cut by itself.
TARGET, OVERSIZED = 8192, 16384
#: Bytes under which an image is furniture, and images kept of a source.
IMAGE_BYTES, IMAGES = 10 * 1024, 500

_BLANK = r"(?U)^\s+|\s+\z"


def trimmed(value):
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, _BLANK, "")


def split_pages(raw: DataFrame, strict: bool = True) -> DataFrame:
    """`source_id, page_no, text`: pages between form feeds, numbered from 1; blank pages keep their numbers.

    With strict=False leading blank pages fall out before numbering, as when the whole text is trimmed first. A null text has no page.
    """
    text = F.col("text") if strict else trimmed(F.col("text"))
    return raw.where("text IS NOT NULL").select("source_id", F.posexplode(F.split(text, "\f")).alias("i", "text")).select("source_id", (F.col("i") + 1).alias("page_no"), "text")


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def page_lines(pages: DataFrame) -> DataFrame:
    """`source_id, page_no, line_no, lines, line`; a line feed at the end of a page begins no further line."""
    cut = _lines(F.col("text"))
    rows = pages.where(F.length("text") > 0).select("source_id", "page_no", cut.alias("cut"))
    return rows.select("source_id", "page_no", F.size("cut").alias("lines"), F.posexplode("cut").alias("line_no", "line"))


def line_stats(pages: DataFrame) -> DataFrame:
    """`source_id, norm, total, in_zone`: occurrences of each line of a source, and those at the edges of pages."""
    rows = page_lines(pages).withColumn("norm", normal_line("line")).where("norm <> ''")
    return rows.groupBy("source_id", "norm").agg(F.count("*").alias("total"), F.sum(in_zone(F.col("line_no"), F.col("lines")).cast("long")).alias("in_zone"))


def boilerplate(stats: DataFrame) -> DataFrame:
    """`source_id, norm` of lines that repeat often enough, most of the times at the edges of pages."""
    share, of = ZONE_SHARE
    return stats.where((F.col("total") >= REPEATS) & (F.col("in_zone") * of >= F.col("total") * share)).select("source_id", "norm")


def clean_pages(pages: DataFrame) -> DataFrame:
    """`source_id, page_no, text` without running headers and footers, page markers and rows of contents.

    Blank lines stay, and repeated lines in the middle of pages stay. A page that loses all its lines stays as an empty one. Lines are
    filtered in the array of their page, so texts stay where they are: only the few repeated lines of a source are joined to its pages.
    """
    repeated = checkpointed(boilerplate(line_stats(pages)).groupBy(F.col("source_id").alias("_source")).agg(F.collect_set("norm").alias("_repeated")))
    cut = F.when(F.length("text") > 0, _lines(F.col("text")))
    rows = pages.select("source_id", "page_no", cut.alias("_cut")).join(checked_broadcast(repeated), F.col("source_id") == F.col("_source"), "left")
    return rows.select("source_id", "page_no", F.coalesce(_without(_paired(F.col("_cut")), F.coalesce("_repeated", F.array().cast("array<string>"))), F.lit("")).alias("text"))


def _paired(cut: Column) -> Column:
    """Lines of a page, each with its normal form."""
    return F.transform(cut, lambda x: F.struct(x.alias("line"), normal_line(x).alias("norm")))


def _without(paired: Column, repeated: Column) -> Column:
    """Text of a page without its repeated lines, page markers and rows of contents."""
    lasting = lambda x: (x["norm"] == "") | ~(is_page_marker(x["norm"]) | is_contents_row(x["line"]) | F.array_contains(repeated, x["norm"]))
    return F.array_join(F.transform(F.filter(paired, lasting), lambda x: x["line"]), "\n")


def pack_pages(pages: DataFrame) -> DataFrame:
    """`source_id, chunk_no, first_page, last_page, text`: pages joined by a blank line, in order, up to TARGET bytes.

    Blank pages are left out. A page above OVERSIZED bytes joins no other and is cut at blank lines, its paragraphs packed
    likewise; a paragraph is never cut. The pass in order, one after the other within a source, reads
    sizes only; texts are put together by chunk, so a source with a third of all pages is no large group.
    """
    whole = pages.select("source_id", "page_no", trimmed(F.col("text")).alias("text")).where("text <> ''")
    large = F.octet_length("text") > OVERSIZED
    usual = whole.where(~large).select("source_id", "page_no", F.lit(0).alias("part_no"), F.lit(0).alias("parts"), "text")
    cut = whole.where(large).select("source_id", "page_no", _paragraphs(F.col("text")).alias("cut"))
    parts = cut.select("source_id", "page_no", F.posexplode("cut").alias("part_no", "text"), F.size("cut").alias("parts")).select("source_id", "page_no", "part_no", "parts", "text")
    every = usual.unionByName(parts)
    sizes = every.select("source_id", "page_no", "part_no", F.octet_length("text").cast("long").alias("bytes"), _mark(F.col("part_no"), F.col("parts")).alias("fresh"))
    placed = sizes.repartition(shuffle_partitions(pages.sparkSession), "source_id").sortWithinPartitions("source_id", "page_no", "part_no").mapInArrow(_numbered, "source_id string, page_no int, part_no int, chunk_no int")
    joined = every.join(placed, ["source_id", "page_no", "part_no"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "part_no", "text"))), lambda x: x["text"]), "\n\n")
    return joined.groupBy("source_id", "chunk_no").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), text.alias("text"))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), trimmed), lambda x: x != "")


def _mark(part_no: Column, parts: Column) -> Column:
    """1 begins a chunk, -1 ends an oversized page, -2 does both."""
    last = part_no + 1 == parts
    return F.when(parts == 0, 0).when(part_no == 0, F.when(last, -2).otherwise(1)).when(last, -1).otherwise(0).cast("int")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk numbers of parts that come in order of source, page and part; only their sizes are read."""
    source, chunk, size, closed = object(), 0, 0, False
    for batch in batches:
        numbers = []
        for s, n, mark in zip(batch.column("source_id").to_pylist(), batch.column("bytes").to_pylist(), batch.column("fresh").to_pylist()):
            if s != source:
                source, chunk, size = s, 1, n
            elif closed or mark in (1, -2) or size + 2 + n > TARGET:
                chunk, size = chunk + 1, n
            else:
                size += 2 + n
            closed = mark < 0
            numbers.append(chunk)
        yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("page_no"), batch.column("part_no"), pa.array(numbers, pa.int32())], names=["source_id", "page_no", "part_no", "chunk_no"])


def chunk_sources(sources: DataFrame, strict: bool = True) -> DataFrame:
    """Further columns of `sources`, chunk_no, first_page, last_page, text: what pack_pages gives of the clean pages of each row's text; alone, whether
    a row gave only this chunk, and nth, its number among chunks with the same pages.

    For sources that have their whole text in a row: it is cut, cleaned and packed where it lies, and nothing is shuffled. Rows with the same source
    are taken one by one; a null text has no chunk. strict=False numbers pages after those at the beginning that cleaning leaves blank.
    """
    others = [c for c in sources.columns if c != "text"]
    none = F.array().cast("array<string>")
    cut = F.transform(F.split("text", "\f"), lambda p: F.when(F.length(p) > 0, _lines(p)).otherwise(none))
    paired = F.transform(cut, lambda c: F.transform(c, lambda x, i: F.struct(x.alias("line"), normal_line(x).alias("norm"), in_zone(i, F.size(c)).alias("edge"))))
    rows = sources.where("text IS NOT NULL").select(*others, paired.alias("_cut"))
    # The functions get fields without a lambda, since Spark loses functions over nested lambdas. They count as not deterministic, so that no filter is made of them.
    every = F.flatten("_cut")
    rows = rows.withColumn("_repeated", F.arrow_udf(_repeated, "array<binary>").asNondeterministic()(every.getField("norm").cast("array<binary>"), every.getField("edge")))
    rows = rows.withColumn("_repeated", F.col("_repeated").cast("array<string>"))
    rows = rows.select(*others, F.transform("_cut", lambda page: _without(page, F.col("_repeated"))).alias("_text"))
    blank = F.lit(0) if strict else F.coalesce(F.array_min(F.transform("_text", lambda t, i: F.when(F.trim(t) != "", i))), F.lit(0))
    rows = rows.select(*others, blank.alias("_blank"), F.transform("_text", trimmed).alias("_text"))
    large = lambda t: F.octet_length(t) > OVERSIZED
    split = F.transform("_text", lambda t, i: F.struct((i + 1 - F.col("_blank")).alias("page_no"), large(t).alias("large"), F.when(t == "", none).when(large(t), _paragraphs(t)).otherwise(F.array(t)).alias("texts")))
    mark = lambda page, k: _mark(k, F.when(page["large"], F.size(page["texts"])).otherwise(0))
    part = lambda page, t, k: F.struct(page["page_no"].alias("page_no"), F.octet_length(t).cast("long").alias("bytes"), mark(page, k).alias("fresh"), t.alias("text"))
    rows = rows.select(*others, F.flatten(F.transform(split, lambda page: F.transform(page["texts"], lambda t, k: part(page, t, k)))).alias("_parts"))
    spans = F.arrow_udf(_spans, "array<struct<at: int, n: int, first_page: int, last_page: int, nth: int>>").asNondeterministic()
    rows = rows.withColumn("_spans", spans(F.col("_parts.page_no"), F.col("_parts.bytes"), F.col("_parts.fresh")))
    rows = rows.select(*others, "_parts", (F.size("_spans") == 1).alias("alone"), F.posexplode("_spans").alias("_k", "_span"))
    text = F.array_join(F.slice("_parts", F.col("_span.at"), F.col("_span.n")).getField("text"), "\n\n")
    return rows.select(*others, (F.col("_k") + 1).alias("chunk_no"), "_span.first_page", "_span.last_page", text.alias("text"), "alone", "_span.nth")


def _repeated(norms: pa.Array, edges: pa.Array) -> pa.Array:
    """For each list of lines those that boilerplate() names; edges say which stand in the zone at a page's edge."""
    share, of = ZONE_SHARE
    lines = norms.flatten().dictionary_encode()
    many = max(1, len(lines.dictionary))
    key = pc.list_parent_indices(norms).to_numpy().astype(np.int64) * many + lines.indices.to_numpy()
    found, at, total = np.unique(key, return_inverse=True, return_counts=True)
    zone = np.bincount(at, weights=edges.flatten().to_numpy(zero_copy_only=False).astype(float), minlength=len(found))
    found = found[(total >= REPEATS) & (zone * of >= total * share)]
    offsets = np.searchsorted(found // many, np.arange(len(norms) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines.dictionary.take(pa.array(found % many)))


def _spans(pages: pa.Array, sizes: pa.Array, fresh: pa.Array) -> pa.Array:
    """Chunks of each list of parts: the first part, counted from 1, the number of parts, the pages, and the number among chunks with the same pages, which stand together."""
    owner, page = pc.list_parent_indices(sizes), pages.flatten()
    parts = pa.RecordBatch.from_arrays([owner, page, page, sizes.flatten(), fresh.flatten()], names=["source_id", "page_no", "part_no", "bytes", "fresh"])
    chunk = next(_numbered(iter([parts]))).column("chunk_no").to_numpy()
    owner, page = owner.to_numpy(), page.to_numpy()
    starts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
    n, of = np.diff(starts, append=len(owner)), owner[starts]
    first, last, k = page[starts], page[starts + n - 1], np.arange(len(starts))
    new = (np.diff(of, prepend=-1) != 0) | (np.diff(first, prepend=-1) != 0) | (np.diff(last, prepend=-1) != 0)
    columns = {"at": starts - np.searchsorted(owner, of) + 1, "n": n, "first_page": first, "last_page": last, "nth": k - np.maximum.accumulate(np.where(new, k, 0)) + 1}
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)), pa.int32()), spans)


def select_images(images: DataFrame, least_bytes: int = IMAGE_BYTES, most: int = IMAGES, stem: str = "source_id") -> DataFrame:
    """`source_id, page, idx, name, kept`: images large enough, each content once in a source, named by the slug of `stem` and page.

    Of equal contents the first by page and index counts. Images beyond the `most` first of a source come out with kept = false
    and no name, so that what is left out is counted.
    """
    sized = images.where(F.octet_length("content") >= least_bytes).select("source_id", F.col(stem).alias("stem"), "page", "idx", F.sha2("content", 256).alias("sha"))
    first = sized.groupBy("source_id", "sha").agg(F.min(F.struct("page", "idx")).alias("x"), F.first("stem").alias("stem")).select("source_id", "stem", "x.page", "x.idx")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("page", "idx")))
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("source_id", "page").orderBy("idx")))
    kept = F.col("n") <= most
    name = F.when(kept, F.concat(slug("stem"), F.format_string("-p%03d-%d.png", "page", "k")))
    return ranked.select("source_id", "page", "idx", name.alias("name"), kept.alias("kept"))


def chunk_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """`chunks` with `images`, e.g. `[a, b]`: names on the pages of each chunk, null if there are none.

    The only chunk of a source has all its images. Images on pages of no chunk are in none. A column `images` of chunks is replaced.
    """
    alone = F.count("*").over(Window.partitionBy("source_id")) == 1
    spans = chunks.select("source_id", "chunk_no", "first_page", "last_page", alone.alias("alone"))
    inside = F.col("alone") | F.col("page").between(F.col("first_page"), F.col("last_page"))
    found = spans.join(images.where("name IS NOT NULL").select("source_id", "page", "idx", "name"), "source_id").where(inside)
    names = found.groupBy("source_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("page", "idx", "name"))).alias("x"))
    listed = names.select("source_id", "chunk_no", image_names(F.col("x")).alias("images"))
    return chunks.drop("images").join(listed, ["source_id", "chunk_no"], "left")


def image_names(images: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(images, lambda v: v["name"]), ", "), F.lit("]"))
