"""Per-key results where a handful of keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.tables import shuffle_partitions

_STATE = "part int, term string, rows long, docs long, positions long, first_doc long, last_doc long"


def normal_term(column: str = "term"):
    """Terms are equal if they are equal after trimming blanks and lower-casing."""
    return F.lower(F.trim(F.col(column)))


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state for each term in a sorted partition, in one pass.

    The state of the last term of a batch stays open until another term comes, so a term has at most one state
    in a partition, however many batches it fills.
    """
    held: list | None = None  # the open state: part, term, rows, docs, positions, first_doc, last_doc
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, doc, npos = (batch.column(k) for k in ("term", "doc_id", "n_pos"))

        def changed(a: pa.Array, n: int = n) -> np.ndarray:
            return ~pc.fill_null(pc.equal(a.slice(1), a.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)

        known = pc.is_valid(doc).to_numpy(zero_copy_only=False)
        new_term = np.concatenate([[True], changed(term)])
        new_doc = known & (new_term | np.concatenate([[True], changed(doc)]))
        starts = np.flatnonzero(new_term)
        ends = np.append(starts[1:], n) - 1
        rows = ends - starts + 1
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        positions = np.add.reduceat(npos.to_numpy(zero_copy_only=False).astype(np.int64), starts)
        columns = [term.take(pa.array(starts)).to_pylist(), rows.tolist(), docs.tolist(), positions.tolist(), doc.take(pa.array(starts)).to_pylist(), doc.take(pa.array(ends)).to_pylist()]
        if held and held[0] == columns[0][0]:
            held[1] += columns[1][0]
            held[2] += columns[2][0] - int(held[5] is not None and held[5] == columns[4][0])
            held[3] += columns[3][0]
            held[5] = columns[5][0]
            columns = [c[1:] for c in columns]
        out = [[h, *c] for h, c in zip(held, columns)] if held else columns
        if not columns[0]:
            continue
        held = [c[-1] for c in columns]
        if len(out[0]) > 1:
            yield _state_batch([c[:-1] for c in out], batch.column("part")[0].as_py())
        part = batch.column("part")[0].as_py()
    if held:
        yield _state_batch([[h] for h in held], part)


def _state_batch(columns: list[list], part: int) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["part", "term", "rows", "docs", "positions", "first_doc", "last_doc"])


def term_totals(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows, documents and positions of every term: `term, rows, documents, positions`.

    The rows are range-partitioned on (term, doc_id, block_no) at sampled quantiles. The key is composite, so a
    term that holds a third of all rows is spread over a third of the partitions. Each partition is sorted
    and passed over once, giving one partial state for each term in it; the states of a term, few and small,
    are then stitched: sums are added, and a document whose blocks lie on both sides of a partition's
    boundary (last_doc of one state, first_doc of the next) is counted once.

    Every delivered row counts in rows and positions. A null term is left out; a row with null doc_id counts
    in rows and positions and is no document; null positions count 0. An empty table gives no row; further
    columns are ignored.
    """
    n = partitions or shuffle_partitions(postings.sparkSession)
    narrow = postings.select(
        normal_term().alias("term"), F.col("doc_id").cast("long").alias("doc_id"), F.col("block_no").cast("long").alias("block_no"), F.coalesce(F.size("positions"), F.lit(0)).alias("n_pos")
    ).where(F.col("term").isNotNull())
    narrow = narrow.withColumn("n_pos", F.greatest("n_pos", F.lit(0)))
    ranged = narrow.repartitionByRange(n, "term", "doc_id", "block_no").sortWithinPartitions("term", "doc_id", "block_no").select("term", "doc_id", "n_pos", F.spark_partition_id().alias("part"))
    states = ranged.mapInArrow(_partial_states, _STATE)
    # states of a term lie in neighbouring partitions: in order, each is compared with the one before
    state = F.struct("part", "rows", "docs", "positions", "first_doc", "last_doc")
    lists = states.groupBy("term").agg(F.array_sort(F.collect_list(state)).alias("s"))
    seam = F.size(F.filter(F.sequence(F.lit(2), F.size("s")), lambda i: F.get("s", i - 2)["last_doc"].eqNullSafe(F.get("s", i - 1)["first_doc"]) & F.get("s", i - 1)["first_doc"].isNotNull()))
    total = lambda name: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[name])
    return lists.select(
        "term", total("rows").alias("rows"), (total("docs") - F.when(F.size("s") > 1, seam).otherwise(0)).cast("long").alias("documents"), total("positions").alias("positions")
    )


def heavy_terms(postings: DataFrame, share: float = 0.02) -> DataFrame:
    """Terms that hold at least `share` of all rows of postings: `term, rows, share`.

    Null terms count in the total only. An empty table gives no row.
    """
    total = postings.count()  # one number, answered from the files' footers
    totals = term_totals(postings)
    return totals.where(F.col("rows") >= F.lit(share) * F.lit(total)).select("term", "rows", (F.col("rows") / F.lit(max(total, 1))).alias("share"))
