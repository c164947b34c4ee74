"""What must hold of results that SQL can't make: one row for each thing that was checked, so that SQL can say what the rows have to be."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import encoding, mixture, scans, split, tokens
from corpuslens.llm.abuse import THRESHOLD, scored
from corpuslens.llm.bodies import header

_LETTERS = r"(?U)\s+"


def restored_otherwise_unchanged(docs: DataFrame) -> DataFrame:
    """`path, ok` of every document with content: its header stayed, and so did its content where nothing was found."""
    before = docs.where("path IS NOT NULL AND content IS NOT NULL").select("path", F.xxhash64("content").alias("was"), F.xxhash64(F.coalesce(header(), F.lit(""))).alias("head"), F.length(header()).alias("size")).distinct()
    after = encoding.restored(docs).where("path IS NOT NULL AND content IS NOT NULL")
    both = after.join(before, "path").withColumn("kept", F.xxhash64(F.expr("substring(content, 1, size)")) == F.col("head")).select("path", (F.col("kept") & ((F.col("found") > 0) | (F.xxhash64("content") == F.col("was")))).alias("ok"))
    return both.groupBy("path").agg(F.bool_and("ok").alias("ok"))


def repaired_otherwise_unchanged(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """`tbl, rec_key, ok` of every record with text: where no trace was found, only white space differs."""
    rows = scans.records(docs, chunks)
    bare = lambda c: F.xxhash64(F.regexp_replace(c, _LETTERS, ""))
    before = rows.select("tbl", "rec_key", bare(F.concat("head", "text")).alias("was")).distinct()
    after = scans.repaired(docs, chunks).select("tbl", "rec_key", (F.col("joined") + F.col("corrected") + F.col("heads") + F.col("pages")).alias("traces"), bare(F.col("text")).alias("now")).distinct()
    same = after.join(before, ["tbl", "rec_key"]).groupBy("tbl", "rec_key").agg(F.bool_or((F.col("traces") > 0) | (F.col("now") == F.col("was"))).alias("ok"))
    return same.select("tbl", "rec_key", "ok")


def pieces_joined(chunks: DataFrame, max_bytes: int = split.MAX_BYTES) -> DataFrame:
    """`source_id, chunk_no, bytes, md5, fits` of the oversized chunks: their pieces joined without overlaps, and whether each is within the limit."""
    pieces = split.split_chunks(chunks).where("pieces > 1")
    own = F.struct("piece_no", F.expr("substring(text, overlap_chars + 1)").alias("t"))
    joined = pieces.groupBy("source_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), "").alias("text"), F.bool_and(F.octet_length("text") <= max_bytes).alias("fits"))
    return joined.select("source_id", "chunk_no", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("md5"), "fits")


def ids_decoded(documents: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """`doc_id, bytes, md5` of the texts that the token ids stand for."""
    shared = tokens._file(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens._encoder(shared).token
        for batch in batches:
            texts = [b"".join([token[i] for i in ids]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return tokens.token_ids(documents, vocabulary).mapInArrow(run, "doc_id long, text binary").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("md5"))


def mixture_kept(documents: DataFrame, mix: DataFrame) -> DataFrame:
    """`source, target_share, max_repeats, ok` of every listed source.

    ok: no document is in more often than allowed, the report's tokens are those of the mixture, a source that is called met has its target
    to one in fifty, one that is short gave all it has as often as it may, an empty one nothing.
    """
    mixed, report = mixture.mixture(documents, mix)
    most = mixed.groupBy("source").agg(F.max("copies").alias("most"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"))
    both = report.join(most, "source", "left")
    allowed = F.coalesce(F.col("most"), F.lit(0)) <= F.col("max_repeats")
    told = F.col("tokens") == F.coalesce(F.col("mixed"), F.lit(0))
    reached = F.when(F.col("status") == "met", F.abs(F.col("tokens") - F.col("target_tokens")) <= 0.02 * F.col("target_tokens") + 2000).when(F.col("status") == "short", F.col("tokens") == F.col("available_tokens") * F.col("max_repeats")).otherwise(F.col("tokens") == 0)
    return both.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", (allowed & told & reached).alias("ok"))


def scores_counted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`source, documents, ok`: rows scored of each source, and whether all have a score from 0 to 1, 0 for texts without a character."""
    right = F.col("score").between(0, 1) & ((F.coalesce(F.length("text"), F.lit(0)) > 0) | (F.col("score") == 0))
    rows = scored(documents, labels).join(documents.select("doc_id", F.substring("text", 1, 1).alias("text")), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.bool_and(right & (F.lit(THRESHOLD) < 1)).alias("ok"))
