"""Command line: python -m lodestar.cli ingest FOLDER ROOT | search FOLDER QUESTION | queries | run NAME SF_DIR"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    """Runs one command."""
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="lodestar")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in {"ingest": ["folder", "root"], "search": ["folder", "question"], "queries": [], "run": ["name", "sf_dir"]}.items():
        own = commands.add_parser(name)
        for word in words:
            own.add_argument(word)
    given = parser.parse_args(args)
    from lodestar import catalog

    if given.command == "queries":
        print("\n".join(catalog.queries()))
        return
    spark = SparkSession.builder.appName("lodestar").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "run":
        catalog.queries()[given.name](spark, given.sf_dir).show(20, truncate=80)
        return
    from lodestar.agent import search
    from lodestar.plans.ingest import Index

    index = Index(spark, given.folder)
    if given.command == "ingest":
        print(index.ingest(given.root))
    else:
        for r in search(index, given.question):
            print(f"{r['score']:.4f} [{r['ref']}] {r['text'][:120]!r}")


if __name__ == "__main__":
    main()
