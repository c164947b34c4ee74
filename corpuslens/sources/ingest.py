"""From source files (PDF, office, text) to a bundle of documents."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import EXTENSIONS, kind_of
from corpuslens.operators.pages import chunk_sources, image_names, select_images
from corpuslens.sources.bundle import render, stem_of, tags, with_names


def _run(*command: str) -> bytes:
    done = subprocess.run(command, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr.decode(errors='replace')[:500]}")
    return done.stdout


def _on_file(content: bytes, suffix: str, work: Callable[[str], bytes]) -> bytes:
    with tempfile.TemporaryDirectory() as folder:  # scratch of one external program on the worker, gone with the call
        path = os.path.join(folder, f"source{suffix}")
        with open(path, "wb") as f:
            f.write(content)
        return work(path)


def layout_text(pdf: bytes) -> str:
    return _on_file(pdf, ".pdf", lambda p: _run("pdftotext", "-layout", p, "-")).decode("utf-8", "replace")


def ocr_pdf(pdf: bytes) -> bytes:
    def work(path: str) -> bytes:
        out = path + ".ocr.pdf"
        _run("ocrmypdf", "--skip-text", path, out)
        with open(out, "rb") as f:
            return f.read()

    return _on_file(pdf, ".pdf", work)


def office_to_pdf(content: bytes, suffix: str = ".docx") -> bytes:
    def work(path: str) -> bytes:
        folder = os.path.dirname(path)
        _run("soffice", "--headless", "--convert-to", "pdf", "--outdir", folder, path)
        with open(os.path.join(folder, "source.pdf"), "rb") as f:
            return f.read()

    return _on_file(content, suffix, work)


def pdf_images(pdf: bytes) -> list[tuple[int, int, bytes]]:
    """(page, index, PNG) of embedded images."""

    def work(path: str) -> list[tuple[int, int, bytes]]:
        folder = os.path.dirname(path)
        _run("pdfimages", "-png", "-p", path, os.path.join(folder, "img"))
        out = []
        for name in sorted(os.listdir(folder)):
            parts = name.rsplit(".", 1)[0].split("-")
            if name.startswith("img-") and len(parts) == 3 and parts[1].isdigit() and parts[2].isdigit():
                with open(os.path.join(folder, name), "rb") as f:
                    out.append((int(parts[1]), int(parts[2]), f.read()))
        return out

    return _on_file(pdf, ".pdf", work)  # type: ignore[arg-type,return-value]


@dataclass
class Extractors:
    """The external programs, each of which may be replaced. `plain` is a first reader of PDF text, if there is one."""

    plain: Callable[[bytes], str] | None = None
    layout: Callable[[bytes], str] = layout_text
    ocr: Callable[[bytes], bytes] = ocr_pdf
    office: Callable[[bytes], bytes] = office_to_pdf
    images: Callable[[bytes], list[tuple[int, int, bytes]]] = pdf_images


@dataclass
class Extracted:
    """Text, whether it was read by OCR, images, and the error of a source that can't be read."""

    text: str | None = None
    used_ocr: bool = False
    images: list[tuple[int, int, bytes]] = field(default_factory=list)
    error: str | None = None


def extract(kind: str, content: bytes, tools: Extractors, force_layout: bool = False) -> Extracted:
    """The text of one source. PDF text comes from the plain reader, from the layout reader if that is blank, from OCR if both are.

    Office files go through PDF, so that page breaks survive. A failing reader is the source's error; failing OCR
    leaves the text blank, failing images leave none.
    """
    try:
        if kind == "text":
            return Extracted(content.decode("utf-8"))
        if kind == "office":
            content, force_layout = tools.office(content), True
        text = tools.plain(content) if tools.plain and not force_layout else ""
        if not text.strip():
            text = tools.layout(content)
        used = False
        if not text.strip():
            try:
                text = tools.layout(tools.ocr(content))
                used = True
            except Exception:  # noqa: BLE001  the source then has no text, which is its error
                text = ""
        try:
            images = tools.images(content)
        except Exception:  # noqa: BLE001  images never keep a document out
            images = []
        return Extracted(text, used, images)
    except Exception as error:  # noqa: BLE001  one bad source doesn't end the batch
        return Extracted(error=f"{type(error).__name__}: {error}"[:500])


#: Names of the files that are taken in, with letters of either case.
_TAKEN = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """`path, kind, content` of the files at `path`; kind and content are null for files that aren't taken in, which aren't read."""
    files = spark.read.format("binaryFile").load(path)
    others = files.select("path").where(kind_of("path").isNull())  # names alone don't open a file
    taken = spark.read.format("binaryFile").option("pathGlobFilter", _TAKEN).load(path)
    return taken.select("path", kind_of("path").alias("kind"), "content").where("kind IS NOT NULL").unionByName(others.select("path", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("content")))


def extract_sources(files: DataFrame, tools: Extractors | None = None, force_layout: bool = False) -> DataFrame:
    """`source_id, stem, file, text, used_ocr, images, error` of the files with a kind, one by one where they lie."""
    tools = tools or Extractors()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [extract(k, bytes(c), tools, force_layout) for k, c in zip(frame["kind"], frame["content"])]
            yield pd.DataFrame({"path": frame["path"], "text": [d.text for d in done], "used_ocr": [d.used_ocr for d in done], "images": [[{"page": p, "idx": i, "content": c} for p, i, c in d.images] for d in done], "error": [d.error for d in done]})

    made = files.where("kind IS NOT NULL").select("path", "kind", "content").mapInPandas(run, "path string, text string, used_ocr boolean, images array<struct<page: int, idx: int, content: binary>>, error string")
    file = F.element_at(F.split("path", "/"), -1)
    return made.select(F.col("path").alias("source_id"), stem_of().alias("stem"), file.alias("file"), "text", "used_ocr", "images", "error")


def to_documents(sources: DataFrame, prefix: str, timestamp: str, description: str = "Extracted from a source file.", strict_pages: bool = False) -> DataFrame:
    """Rendered documents of extracted sources: `source_id, name, title, parent, pages, images, content`.

    Text read by OCR begins with its title, so that it can be found by it. strict_pages=False numbers pages after leading blank
    ones; True keeps their numbers. Texts are shuffled once, by source, when the names of images come to them, and not at all if they lie so already.
    """
    text = F.when(F.col("used_ocr"), F.concat("stem", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    good = sources.where("error IS NULL AND source_id IS NOT NULL").where(text.isNotNull())
    images = select_images(good.select("source_id", "stem", F.explode("images").alias("x")).select("source_id", "stem", "x.*"), stem="stem")
    shown = images.where("name IS NOT NULL").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page", "idx", "name"))).alias("_images"))
    chunks = chunk_sources(good.select("source_id", "stem", "file", "used_ocr", text.alias("text")).join(shown, "source_id", "left"), strict_pages)
    named = with_names(chunks, F.col("alone"), F.col("nth"))
    inside = F.filter("_images", lambda x: F.col("alone") | x["page"].between(F.col("first_page"), F.col("last_page")))
    linked = named.withColumn("_inside", inside).withColumn("images", F.when(F.size("_inside") > 0, image_names(F.col("_inside"))))
    full = linked.select("*", F.lit("technical-note").alias("doc_type"), F.lit(description).alias("description"), F.concat(F.lit(prefix.rstrip("/") + "/"), "file").alias("resource"), tags().alias("tags"), F.lit(timestamp).alias("timestamp"), F.col("text").alias("body"))
    return full.select("source_id", "name", "title", "parent", "pages", "images", render(full).alias("content"))


def failures(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """`source_id, error` of sources that gave no document: those that can't be read, and those without text."""
    empty = sources.where("error IS NULL").join(documents.select("source_id").distinct(), "source_id", "left_anti")
    said = F.when(F.col("used_ocr"), "no text, even by OCR").otherwise("no text")
    return sources.where("error IS NOT NULL").select("source_id", "error").unionByName(empty.select("source_id", said.alias("error")))


def summary(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """`status, sources`: how many sources gave documents and how many failed."""
    bad = failures(sources, documents).select("source_id", F.lit("failed").alias("status"))
    good = sources.select("source_id").join(bad, "source_id", "left_anti").select("source_id", F.lit("ok").alias("status"))
    return good.unionByName(bad).groupBy("status").agg(F.count("*").alias("sources"))
