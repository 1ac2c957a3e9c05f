"""A thin command line over a service's tables: query, recall, info, verify, export.

python -m graphloom FOLDER query "FIND thoughts WHERE priority = 'P1' LIMIT 5" --format table
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .operators import reads, retrieval, store
from .plans.mql import Engine, QueryError
from .sources import snapshot
from .sources.services import Services


def run(spark: SparkSession, args: list[str]) -> str:
    """What a command prints."""
    line = argparse.ArgumentParser(prog="graphloom")
    line.add_argument("folder", help="the folder that holds the services")
    line.add_argument("--service", default="default")
    line.add_argument("--format", choices=("table", "json", "csv"), default="table")
    line.add_argument("--now", type=datetime.fromisoformat, default=None)
    verbs = line.add_subparsers(dest="verb", required=True)
    verbs.add_parser("query").add_argument("text")
    recall = verbs.add_parser("recall")
    recall.add_argument("text")
    recall.add_argument("--top", type=int, default=10)
    verbs.add_parser("info")
    verbs.add_parser("verify")
    verbs.add_parser("export").add_argument("path")
    told = line.parse_args(args)
    now = told.now or datetime.now(UTC).replace(tzinfo=None)
    tables = Services(spark, told.folder).open(told.service)
    show = lambda df: snapshot.formatted(df, told.format)
    if told.verb == "query":
        return show(Engine(spark, tables.table, now).run(told.text))
    if told.verb == "recall":
        found = retrieval.recall(tables.thought, tables.embedding, tables.edge, told.text, now=now, top_k=told.top)
        return show(found.rows.orderBy("rank"))
    if told.verb == "info":
        return show(reads.counts(tables.thought, tables.edge).orderBy("kind", "type", "status"))
    if told.verb == "verify":
        return show(store.verify_journal(tables.journal_entry))
    snapshot.export({name: tables.table(name) for name in ("thought", "edge", "embedding", "action")}, told.path)
    return f"written to {told.path}"


if __name__ == "__main__":
    try:
        print(run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
    except (QueryError, ValueError) as e:
        sys.exit(str(e))
