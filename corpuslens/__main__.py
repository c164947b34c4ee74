"""python -m corpuslens ingest SOURCES OUT [--force-layout] | search QUERY --bundle FOLDER --index FOLDER | list --bundle FOLDER --index FOLDER"""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from pyspark.sql import SparkSession


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="corpuslens")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest", help="extract source files into a bundle of Markdown documents")
    ingest.add_argument("sources")
    ingest.add_argument("out")
    ingest.add_argument("--force-layout", action="store_true")
    ingest.add_argument("--prefix", default="sources")
    for name in ("search", "list"):
        c = sub.add_parser(name)
        own = os.environ.get("CORPUSLENS_BUNDLE")
        c.add_argument("--bundle", default=own, required=own is None, help="folder of Markdown documents; by default CORPUSLENS_BUNDLE")
        root = os.environ.get("CORPUSLENS_INDEX")
        c.add_argument("--index", default=root, required=root is None, help="folder for index versions, shared by all executors; by default CORPUSLENS_INDEX")
        if name == "search":
            c.add_argument("query")
    p.add_argument("--log-level", default=os.environ.get("CORPUSLENS_LOG_LEVEL", "WARN"), help="Spark's log level; by default CORPUSLENS_LOG_LEVEL, else WARN")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level.upper())
    if args.command == "ingest":
        from corpuslens.sources import ingest as I
        from corpuslens.sources.bundle import write_files

        files = I.read_sources(spark, args.sources)
        single = os.path.isfile(args.sources)
        if single and files.where("kind IS NOT NULL").isEmpty():
            print(f"not a kind of source that is taken in: {args.sources}", file=sys.stderr)
            return 1
        sources = I.extract_sources(files, force_layout=args.force_layout).persist()
        documents = I.to_documents(sources, args.prefix, datetime.datetime.now(datetime.UTC).isoformat())
        write_files(documents, args.out)
        for r in I.failures(sources, documents).toLocalIterator():
            print(f"{r['source_id']}: {r['error']}", file=sys.stderr)
        counts = {r["status"]: r["sources"] for r in I.summary(sources, documents).collect()}
        print(f"{counts.get('ok', 0)} extracted, {counts.get('failed', 0)} failed")
        return int(single and counts.get("failed", 0) > 0)
    from corpuslens.plans.service import KnowledgeBase

    kb = KnowledgeBase(spark, args.bundle, args.index)
    result = kb.render_search(args.query) if args.command == "search" else kb.list_docs()
    print(result.text)
    return int(result.is_error)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
