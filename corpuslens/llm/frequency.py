"""How often every distinct term occurs, and in how many documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.sources.tables import shuffle_partitions

#: Parts at least into which a term's documents are split by the document's hash; as many as there are shuffle partitions, if these are more.
DOC_PARTS = 256


def term_frequencies(postings: DataFrame, docs: DataFrame, rare_docs: int = 2, common_share: float = 0.25) -> DataFrame:
    """Occurrences and documents of every term, with a mark: `term, occurrences, documents, mark`.

    Last-seen counters: rows are hash-partitioned by term and a hash part of the document and ordered by
    document and block, so a term's counter needs only the row before: another document than the last seen one
    adds a document, another block adds its freq. Parts of a term hold different documents, so their
    counters are added; a term with a third of all rows is spread over as many tasks.

    Terms are equal after trimming blanks and lower-casing. Rows with the same term, doc_id and block_no count
    once, with the freq of the one indexed last (on a tie the larger freq). Left out: null terms and rows
    with null doc_id. A null freq counts 0; a null block_no is a block of its own. mark is `rare` in at most
    `rare_docs` documents, else `common` in at least `common_share` of the distinct doc_id of `docs`, else null.
    Empty tables give no rows; with an empty `docs` no term is common.
    """
    rows = postings.select(F.lower(F.trim("term")).alias("term"), F.col("doc_id").cast("long").alias("doc_id"), F.col("block_no").cast("long").alias("block_no"), F.coalesce("freq", F.lit(0)).cast("long").alias("freq"), "indexed_at")
    parts = max(DOC_PARTS, shuffle_partitions(postings.sparkSession))
    rows = rows.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).withColumn("part", F.pmod(F.hash("doc_id"), F.lit(parts)))
    seen = Window.partitionBy("term", "part").orderBy("doc_id", "block_no", F.desc_nulls_last("indexed_at"), F.desc("freq"))
    last_doc, last_block, first = F.lag("doc_id").over(seen), F.lag("block_no").over(seen), F.row_number().over(seen) == 1
    counted = rows.select("term", "part", "freq", (first | (F.col("doc_id") != last_doc)).alias("new_doc"), (first | (F.col("doc_id") != last_doc) | ~F.col("block_no").eqNullSafe(last_block)).alias("new_block"))
    # the same partitioning serves the counters of the parts; only one row a term and part is sent on
    parts = counted.groupBy("term", "part").agg(F.sum(F.when(F.col("new_block"), F.col("freq")).otherwise(0)).alias("occurrences"), F.sum(F.col("new_doc").cast("long")).alias("documents"))
    totals = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    least = common_share * docs.select("doc_id").where("doc_id IS NOT NULL").distinct().count()  # one number
    mark = F.when(F.col("documents") <= rare_docs, F.lit("rare")).when((F.lit(least) > 0) & (F.col("documents") >= F.lit(least)), F.lit("common"))
    return totals.withColumn("mark", mark)


def marked_terms(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Terms too rare or too common to be useful: `term, mark`."""
    return term_frequencies(postings, docs).where(F.col("mark").isNotNull()).select("term", "mark")
