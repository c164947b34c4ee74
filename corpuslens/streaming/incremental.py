"""Postings of documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpuslens.operators.index import postings


def stream_postings(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """Append the postings of a stream of documents to the Parquet table at `path`.

    A document's postings depend on its own row only, so no state is kept. Each micro-batch is written under its own
    number, and a batch that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        posted = postings(batch, key, text)
        posted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
