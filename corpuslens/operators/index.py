"""The inverted index: documents, postings, vocabulary."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import pages_start
from corpuslens.sources.tables import checkpointed, fresh, shuffle_partitions, spread

#: Positions kept of a term in a document.
POSITIONS = 16

_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def tokens_of(text: str) -> list[tuple[int, str]]:
    """(byte offset, lower-cased token) of the maximal runs of letters and digits."""
    if text.isascii():
        return [(m.start(), m.group().lower()) for m in _TOKEN.finditer(text)]
    out, at, offset = [], 0, 0
    for m in _TOKEN.finditer(text):
        offset += len(text[at : m.start()].encode())
        at = m.start()
        out.append((offset, m.group().lower()))
    return out


def body_column(content: str = "content", start: str = "body_start"):
    return F.expr(f"cast(substring(cast({content} AS BINARY), greatest(coalesce({start}, 0), 0) + 1) AS STRING)")


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", base: str | None = None) -> DataFrame:
    """`<key>, i, token, offset` of every token; offsets are bytes of the text, after `base` bytes if that column is named.

    A document's tokens come from its own row, so nothing is shuffled. Null and empty texts have no tokens; rows
    with the same key are taken one by one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, token, offset = [], [], [], []
            for k, (t, start) in enumerate(zip(batch.column("text").to_pylist(), batch.column("base").to_pylist())):
                for i, (at, word) in enumerate(tokens_of(t) if t else ()):
                    owner.append(k)
                    number.append(i)
                    token.append(word)
                    offset.append(start + at)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(token, pa.string()), pa.array(offset, pa.int64())], names=[key, "i", "token", "offset"])

    start = F.coalesce(F.col(base), F.lit(0)).cast("long") if base else F.lit(0).cast("long")
    return spread(docs.select(key, F.col(text).alias("text"), start.alias("base"))).mapInArrow(run, f"`{key}` {kind}, i int, token string, offset long")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", base: str | None = None, keep: int = POSITIONS) -> DataFrame:
    """`term, <key>, freq, positions`: all occurrences counted, the first `keep` byte offsets kept.

    Terms of a document are counted where its row lies; the one shuffle of an index is the one that puts equal terms
    together when it is written. Documents without tokens have no row; see lengths.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, terms, freqs, places = [], [], [], []
            for k, (t, start) in enumerate(zip(batch.column("text").to_pylist(), batch.column("base").to_pylist())):
                found: dict[str, list] = defaultdict(lambda: [0, []])
                for at, word in tokens_of(t) if t else ():
                    entry = found[word]
                    entry[0] += 1
                    if entry[0] <= keep:
                        entry[1].append(start + at)
                owner += [k] * len(found)
                terms += found
                freqs += [e[0] for e in found.values()]
                places += [e[1] for e in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column(key).take(pa.array(owner, pa.int64())), pa.array(freqs, pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["term", key, "freq", "positions"])

    start = F.coalesce(F.col(base), F.lit(0)).cast("long") if base else F.lit(0).cast("long")
    return spread(docs.select(key, F.col(text).alias("text"), start.alias("base"))).mapInArrow(run, f"term string, `{key}` {kind}, freq long, positions array<long>")


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`<key>, token_count` of every row, 0 for null and empty texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(_TOKEN.findall(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())], names=[key, "token_count"])

    return spread(docs.select(key, F.col(text).alias("text"))).mapInArrow(run, f"`{key}` {kind}, token_count long")


def counts(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: `documents, terms`."""
    n = docs.agg(F.count("*").alias("documents"))
    return n.withColumn("k", F.lit(1)).join(posted.agg(F.count_distinct("term").alias("terms")).withColumn("k", F.lit(1)), "k").select("documents", "terms")


def vocabulary(posted: DataFrame) -> DataFrame:
    """`term` of every different term."""
    return posted.select("term").distinct()


def next_in_family(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` with `next_stem`: the stem of the next document with the same parent, by first page, then by key.

    Documents without parent, or whose pages don't begin with a number, are in no family and have null.
    """
    start = fresh(docs, "_start")
    docs = docs.withColumn(start, pages_start("pages"))
    member = F.col("parent").isNotNull() & F.col(start).isNotNull()
    # only members are ordered by family; the others, which may be most, aren't brought together in one null family
    inside = docs.where(member).withColumn("next_stem", F.lead("stem").over(Window.partitionBy("parent").orderBy(start, key)))
    outside = docs.where(~member).withColumn("next_stem", F.lit(None).cast("string"))
    return inside.unionByName(outside).drop(start)


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", base: str | None = None, partitions: int | None = None) -> None:
    """Write `docs` (with token_count), `postings` and `vocab` below `path`.

    Texts are read by Python once; what comes of it is kept while the range partitioning samples it. postings are
    range-partitioned by term and document, so a term of a third of all postings fills many files, and sorted,
    so the files' statistics let a search read only the files of its terms.
    """
    spark = docs.sparkSession
    posted = checkpointed(postings(docs, key, text, base))
    n = partitions or shuffle_partitions(spark)
    posted.repartitionByRange(n, "term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("documents"), F.sum("freq").alias("occurrences")).write.mode("overwrite").parquet(f"{path}/vocab")
    sized = posted.groupBy(key).agg(F.sum("freq").alias("token_count"))  # a document's terms lie side by side
    docs.join(sized, key, "left").withColumn("token_count", F.coalesce("token_count", F.lit(0))).write.mode("overwrite").parquet(f"{path}/docs")
