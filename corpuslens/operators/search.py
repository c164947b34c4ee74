"""Keyword search over postings: term matching, ranking, excerpts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import PREFIX, PREFIX_EXTRA, matches, query_terms, score
from corpuslens.sources.tables import checked_broadcast, checkpointed, settled, shuffle_partitions

#: Hits shown, excerpts of a hit, bytes that count as near, and bytes of an excerpt before and after its anchor.
HITS, EXCERPTS, NEAR, BEFORE, AFTER = 20, 3, 500, 150, 300
#: Words that answer a search up to which they are kept by the driver and filter the files of postings.
MATCHES = 5000


def terms_frame(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """`query_id, qi, q`: the terms of each query in order; repeated terms are slots of their own."""
    rows = [(k, i, t) for k, q in queries.items() for i, t in enumerate(query_terms(q))]
    kinds = (("query_id", pa.int64()), ("qi", pa.int32()), ("q", pa.string()))
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds]))


def match_terms(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """`q, term`: the words of the vocabulary that answer each different query term.

    Terms of one or two bytes, and of three, are joined by key. Longer ones may stand anywhere in a word or be misspelt,
    so every word of the vocabulary is held against each of these terms, which come from the queries. Repeated
    terms are matched once.
    """
    asked = terms.select("q").distinct()
    size = F.octet_length("q")
    short = vocab.join(asked.where(size < PREFIX), F.col("term") == F.col("q")).select("q", "term")
    first = F.expr(f"substring(cast(term AS BINARY), 1, {PREFIX})")
    prefix = vocab.where(F.octet_length("term").between(PREFIX, PREFIX + PREFIX_EXTRA)).join(asked.where(size == PREFIX), first == F.expr("cast(q AS BINARY)")).select("q", "term")
    long = [r["q"] for r in asked.where(size > PREFIX).collect()]  # the terms of the queries at hand
    if not long:
        return short.unionByName(prefix)
    hits = F.filter(F.array(*[F.lit(q) for q in sorted(long)]), lambda q: matches(F.col("term"), q))
    return short.unionByName(prefix).unionByName(vocab.select(F.explode(hits).alias("q"), "term"))


def slots(posted: DataFrame, vocab: DataFrame, terms: DataFrame, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """`query_id, qi, <key>, freq, positions`: for each slot of a query, what its matched words have in each document.

    `found` is what match_terms gave, if it is at hand.
    """
    found = match_terms(vocab, terms) if found is None else found
    merged = posted.join(found, "term").groupBy("q", key).agg(F.sum("freq").alias("freq"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return merged.join(terms, "q").select("query_id", "qi", key, "freq", "positions")


def rank(docs: DataFrame, posted: DataFrame, vocab: DataFrame, terms: DataFrame, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """`query_id, rank, <key>, coverage, freq, token_count, score` of every document with any term.

    Coverage, the number of slots with a match, goes first, then the score, then the key.
    """
    return numbered(matched_documents(docs, posted, vocab, terms, key, found), key)


def matched_documents(docs: DataFrame, posted: DataFrame, vocab: DataFrame, terms: DataFrame, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """`query_id, <key>, coverage, freq, token_count, score` of every document with any term of a query, in no order."""
    found = match_terms(vocab, terms) if found is None else found
    per_term = posted.select("term", key, "freq").join(found, "term").groupBy("q", key).agg(F.sum("freq").alias("freq"))
    per_doc = per_term.join(terms, "q").groupBy("query_id", key).agg(F.count("*").alias("coverage"), F.sum("freq").alias("freq"))
    hits = per_doc.join(docs.select(key, "token_count"), key).withColumn("score", score(F.col("freq"), F.col("token_count")))
    return hits.select("query_id", key, "coverage", "freq", "token_count", "score")


def numbered(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """`hits` with `rank` within their query: by coverage and score, the highest first, then by key.

    Hits are put in order by range, so the millions of one query fill many tasks; a rank is the place in its partition added to the
    query's hits in the partitions before, which are a few numbers a partition.
    """
    order = ["query_id", F.desc("coverage"), F.desc("score"), key]
    n = shuffle_partitions(hits.sparkSession)
    ranged = checkpointed(hits.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("query_id", "_part").count()
    before = counts.select("query_id", F.col("_part"), (F.sum("count").over(Window.partitionBy("query_id").orderBy("_part")) - F.col("count")).alias("_before"))  # queries x partitions
    local = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(F.desc("coverage"), F.desc("score"), key))
    placed = ranged.withColumn("_local", local).join(F.broadcast(before), ["query_id", "_part"])
    return placed.select("query_id", (F.col("_local") + F.col("_before")).cast("int").alias("rank"), key, "coverage", "freq", "token_count", "score")


def top_hits(docs: DataFrame, posted: DataFrame, vocab: DataFrame, terms: DataFrame, key: str = "doc_id", hits: int = HITS, found: DataFrame | None = None) -> DataFrame:
    """The first `hits` of each query. Each task keeps only so many of each query before they are brought together."""
    every = matched_documents(docs, posted, vocab, terms, key, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("score"), key)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hits).select("query_id", "rank", key, "coverage", "freq", "token_count", "score")


def anchors(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """`query_id, <key>, anchors`: the positions of all slots, each with the number of slots near it, the best first."""
    lists = found.groupBy("query_id", key).agg(F.collect_list("positions").alias("slots"))
    every = F.array_sort(F.array_distinct(F.flatten("slots")))
    near = lambda p: F.size(F.filter("slots", lambda s: F.exists(s, lambda y: F.abs(y - p) <= NEAR)))
    ordered = F.array_sort(F.transform(every, lambda p: F.struct((-near(p)).alias("n"), p.alias("p"))))
    return lists.select("query_id", key, F.transform(ordered, lambda x: F.struct(x["p"].alias("p"), (-x["n"]).cast("int").alias("near"))).alias("anchors"))


def windows(anchored: DataFrame, starts: DataFrame, key: str = "doc_id", text_start: str = "body_start") -> DataFrame:
    """`query_id, <key>, windows`: byte ranges around the best anchors, at most EXCERPTS.

    An anchor within a range that is already taken is passed over; a range doesn't begin before the body.
    """
    joined = anchored.join(starts.select(key, F.coalesce(F.col(text_start), F.lit(0)).cast("long").alias("_low")), key)
    taken = F.aggregate(
        "anchors",
        F.expr("cast(array() AS array<struct<s: bigint, e: bigint>>)"),
        lambda acc, x: F.when((F.size(acc) >= EXCERPTS) | F.exists(acc, lambda w: (x["p"] >= w["s"]) & (x["p"] < w["e"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(F.greatest(x["p"] - BEFORE, F.col("_low")).alias("s"), (x["p"] + AFTER).alias("e"))))
        ),
    )
    return joined.select("query_id", key, taken.alias("windows"))


def excerpts(ranges: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`ranges` with `excerpts`: the ranges' text, cut characters and blanks at the ends trimmed. Only joined rows' texts are read."""
    cut = F.transform(
        "windows",
        lambda w: F.regexp_replace(F.make_valid_utf8(F.substring(F.col("_bytes"), (w["s"] + 1).cast("int"), (w["e"] - w["s"]).cast("int")).cast("string")), r"(?U)^[\s\x{FFFD}]+|[\s\x{FFFD}]+\z", ""),
    )
    return ranges.join(texts.select(key, F.col(text).cast("binary").alias("_bytes")), key).select(*ranges.columns, cut.alias("excerpts"))


def search(docs: DataFrame, posted: DataFrame, vocab: DataFrame, queries: dict[int, str], key: str = "doc_id", text: str = "text", text_start: str = "body_start", hits: int = HITS) -> DataFrame:
    """Ranked hits of each query with excerpts: `query_id, rank, <key>, coverage, freq, token_count, score, windows, excerpts`.

    The best hits are found from counts alone; positions and texts are read for them only. A query without terms has no hit.
    """
    terms = terms_frame(docs.sparkSession, queries)
    matched = settled(match_terms(vocab, terms), MATCHES)
    near = posted.where(F.col("term").isin(words)) if (words := _listed(matched)) is not None else posted
    best = settled(top_hits(docs, near, vocab, terms, key, hits, matched), 1000 * HITS)
    wanted = checked_broadcast(best.select(key).distinct())
    found = slots(near.join(wanted, key, "left_semi"), vocab, terms, key, matched).join(best.select("query_id", key), ["query_id", key], "left_semi")
    ranges = windows(anchors(found, key), docs, key, text_start)
    read = excerpts(ranges, docs.join(wanted, key, "left_semi"), key, text)
    return best.join(read, ["query_id", key])


def _listed(matched: DataFrame) -> list[str] | None:
    """The different words of `matched` for a filter that reaches the files, or null if they are many."""
    rows = matched.select("term").distinct().limit(MATCHES + 1).collect()
    return sorted(r["term"] for r in rows) if len(rows) <= MATCHES else None
