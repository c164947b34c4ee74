"""What several operators need of the Markdown documents: body, header, site, one row a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.tables import checked_broadcast, checkpointed, fresh


def body(content: str = "content", start: str = "body_start") -> Column:
    """Content after the header's bytes; null content gives null, a null or negative start counts 0."""
    return F.expr(f"cast(substring(cast({content} AS BINARY), greatest(coalesce({start}, 0), 0) + 1) AS STRING)")


def header(content: str = "content", start: str = "body_start") -> Column:
    """The header's bytes of content."""
    return F.expr(f"cast(substring(cast({content} AS BINARY), 1, greatest(coalesce({start}, 0), 0)) AS STRING)")


def with_site(docs: DataFrame) -> DataFrame:
    """`docs` with `site`: the text of resource before the first slash, lower-cased and trimmed.

    A document with empty resource takes the site of the documents with its parent (the most frequent, on a
    tie the first by name), else null. Sites of parents are found from resource and parent alone, and only of parents that a document
    without resource has. Documents stay where they are while these are few, which is counted; those with null parent
    are never joined.
    """
    own = F.lower(F.trim(F.substring_index("resource", "/", 1)))
    docs = docs.withColumn("site", F.when(own != "", own))
    narrow = docs.where(F.col("parent").isNotNull()).select("parent", "site")
    wanted = narrow.where(F.col("site").isNull()).select("parent").distinct()
    known = narrow.where(F.col("site").isNotNull()).groupBy("parent", "site").count()
    sites = known.groupBy("parent").agg(F.min(F.struct(-F.col("count"), "site"))["site"].alias("_site")).join(wanted, "parent", "left_semi").withColumnRenamed("parent", "_parent")
    sites = checked_broadcast(checkpointed(sites))
    lost = F.col("site").isNull() & F.col("parent").isNotNull()
    found = docs.where(lost).drop("site").join(sites, F.col("parent") == F.col("_parent"), "left").withColumn("site", F.col("_site")).drop("_parent", "_site")
    return docs.where(~lost).unionByName(found)


def latest(docs: DataFrame, *columns: str) -> DataFrame:
    """`path` and `columns` of one row for each path: the one with the latest loaded_at, then the greatest content.

    Only rows of paths that come more than once are brought together; the others stay where they are. Null paths count as one.
    """
    rows = docs.select("path", *columns, F.col("loaded_at").alias(at := fresh(docs.select("path", *columns), "_at")))
    dups = checked_broadcast(checkpointed(docs.groupBy("path").count().where("count > 1").select(F.col("path").alias("_dup"))))
    same = F.col("path").eqNullSafe(F.col("_dup"))
    many = rows.join(dups, same, "left_semi").groupBy("path").agg(F.max_by(F.struct(*columns), F.struct(at, *[c for c in columns if c == "content"], *[c for c in columns if c != "content"])).alias("x"))
    return rows.join(dups, same, "left_anti").select("path", *columns).unionByName(many.select("path", *[F.col(f"x.`{c}`").alias(c) for c in columns]))
