"""Bundles of Markdown documents with a header: reading, parsing, rendering, naming, writing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import header_field, safe_name, slug
from corpuslens.sources.tables import fresh, shuffle_partitions

#: Value of a header's field where the field is missing; title takes the stem.
DEFAULT_TYPE = "uncategorised"


def header_block(content: str = "content") -> Column:
    """Text between the opening line and the next line that begins with three hyphens; null where content has no header."""
    rest = F.expr(f"substring({content}, 5)")
    return F.when(F.col(content).startswith("---\n") & rest.contains("\n---"), F.substring_index(rest, "\n---", 1))


def body_start(content: str = "content") -> Column:
    """Bytes before the body: up to the first line of three hyphens anywhere, else 0."""
    mark = "\n---\n"
    return F.when(F.col(content).contains(mark), F.octet_length(F.substring_index(content, mark, 1)) + len(mark)).otherwise(0).cast("int")


def stem_of(path: str = "path") -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"(?<=.)\.[^.]*$", "")


def image_list(value: Column) -> Column:
    """Names of a list such as `[a, b]`; empty where the field is missing."""
    inner = F.regexp_replace(F.regexp_replace(value, r"^\[+", ""), r"\]+$", "")
    return F.coalesce(F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def parse(files: DataFrame) -> DataFrame:
    """Documents of rows (path, content): path, stem, title, doc_type, resource, description, parent, pages, images, content, body_start.

    Missing fields have the defaults above: description, parent and pages null, resource empty, no images. Null content has no row.
    """
    rows = files.where("content IS NOT NULL").select("path", "content").withColumn("_b", header_block()).withColumn("stem", stem_of())
    field = lambda name: header_field("_b", name)
    return rows.select(
        "path",
        "stem",
        F.coalesce(field("title"), F.col("stem")).alias("title"),
        F.coalesce(field("type"), F.lit(DEFAULT_TYPE)).alias("doc_type"),
        F.coalesce(field("resource"), F.lit("")).alias("resource"),
        field("description").alias("description"),
        field("parent").alias("parent"),
        field("pages").alias("pages"),
        image_list(field("images")).alias("images"),
        "content",
        body_start().alias("body_start"),
    )


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the Markdown files of a folder, not of folders within; the extension's case doesn't matter.

    A missing folder is an error that names it. Files that aren't UTF-8 are left out; see unreadable. Spark's file
    sources pass over names that begin with a dot or an underscore.
    """
    files = _files(spark, folder)
    return parse(files.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content")))


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """`path` of the Markdown files that read_bundle leaves out."""
    return _files(spark, folder).where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """`path, content` and more of the Markdown files. Spark would make a task of every few small files, and keeps each task in the driver; here tasks follow the
    shuffle partitions, of which there are as many as the input needs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "false").load(folder)
    return files.coalesce(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))


def render(docs: DataFrame) -> Column:
    """A document with its header; fields that are null are left out. `docs` gives the columns at hand."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    fields = (("type", "doc_type"), ("title", "title"), ("description", "description"), ("resource", "resource"), ("parent", "parent"), ("pages", "pages"), ("images", "images"), ("tags", "tags"), ("timestamp", "timestamp"))
    lines = [F.concat(F.lit(f"{name}: "), has(column)) for name, column in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col("body"))


def tags(used_ocr: str = "used_ocr") -> Column:
    return F.when(F.coalesce(F.col(used_ocr), F.lit(False)), "[extracted, ocr, technical-note]").otherwise("[extracted, technical-note]")


def name_chunks(chunks: DataFrame) -> DataFrame:
    """`chunks` (source_id, stem, chunk_no, first_page, last_page) with name, title, parent and pages.

    The only chunk of a source bears its slug and has no parent. Others are named by pages; those with equal pages
    get a number from 2 in the order of chunks.
    """
    alone = F.count("*").over(Window.partitionBy("source_id")) == 1
    _alone, _base, _n = (fresh(chunks, c) for c in ("_alone", "_base", "_n"))
    rows = chunks.withColumn(_alone, alone)
    rows = rows.withColumn(_base, _base_name(F.col(_alone)))
    nth = F.row_number().over(Window.partitionBy(_base, "source_id").orderBy("chunk_no"))
    return with_names(rows.withColumn(_n, nth), F.col(_alone), F.col(_n)).drop(_alone, _base, _n)


def _base_name(alone: Column) -> Column:
    return F.when(alone, slug("stem")).otherwise(F.concat(slug("stem"), F.format_string("-p%03d-%03d", "first_page", "last_page")))


def with_names(chunks: DataFrame, alone: Column, nth: Column) -> DataFrame:
    """name_chunks of chunks of which it is known whether each is its source's only one, and its number among those with equal pages."""
    span = F.concat(F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"))
    return (
        chunks.withColumn("name", F.when(nth > 1, F.concat(_base_name(alone), F.lit("-"), nth.cast("string"))).otherwise(_base_name(alone)))
        .withColumn("title", F.when(alone, F.col("stem")).otherwise(F.concat("stem", F.lit(" (pages "), span, F.lit(")"))))
        .withColumn("parent", F.when(~alone, slug("stem")))
        .withColumn("pages", F.when(~alone, span))
    )


def collisions(named: DataFrame) -> DataFrame:
    """`name, sources` of names that several sources share; writing them, the last would replace the others."""
    return named.groupBy("name").agg(F.count_distinct("source_id").alias("sources")).where("sources > 1")


def file_system(folder: str):
    """(file system, path in it) of a folder: one named by a URI such as `hdfs://` or `s3://`, else the machine's own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(named: DataFrame, folder: str) -> None:
    """Write each row's `content` as `<name>.md`; for bundles that are read as files.

    Rows are written where they lie, so on a cluster the folder has to be one that all executors share, given as a URI or mounted on
    each; a folder of one machine is refused there. A file is written whole or not at all, so that a task may run again. Of rows with the
    same name, one stays.
    """
    master = named.sparkSession.sparkContext.master
    if "://" not in folder and not master.startswith("local") and not named.sparkSession.conf.get("corpuslens.shared.mount", None):
        raise ValueError(f"{folder}: on a cluster name the folder by a URI, or set corpuslens.shared.mount if it is mounted on all executors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        part, written = f"{path}/{uuid.uuid4().hex}.part", 0  # a task's own: another one may write a file of the same name at the same time
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not safe_name(name):
                    raise ValueError(f"unsafe name: {name!r}")
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, f"{path}/{name}.md")
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    valid = named.select(F.make_valid_utf8("name").alias("name"), F.make_valid_utf8("content").cast("binary").alias("content"))
    valid.mapInArrow(run, "files long").agg(F.sum("files")).collect()
