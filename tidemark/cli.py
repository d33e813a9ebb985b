"""Command line jobs, one per scheduled step of a run:

    python -m tidemark.cli init
    python -m tidemark.cli ingest cdc    --kafka HOST:PORT   (or --files DIR --format json)
    python -m tidemark.cli ingest clicks --kafka HOST:PORT [--topic clickstream.events]
    python -m tidemark.cli refresh [--mode dynamic|full] [--since YYYY-MM-DD] [--apply-deletes] [--parallel N]
    python -m tidemark.cli refresh --incremental [--apply-deletes]
    python -m tidemark.cli compact
    python -m tidemark.cli statistics
    python -m tidemark.cli check [--nonempty]

Tables live under ``--root`` or, by default, under the session's
``spark.checkpoint.dir``. A failed check exits with status 1.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--root", help="lakehouse root (default: spark.checkpoint.dir/lakehouse)")
    parser.add_argument("--prefix", default="", help="namespace prefix")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("init")
    ing = sub.add_parser("ingest")
    ing.add_argument("kind", choices=["cdc", "clicks"])
    ing.add_argument("--kafka", help="bootstrap servers")
    ing.add_argument("--topic", help="single topic (clicks); CDC uses the table pattern")
    ing.add_argument("--files", help="folder of envelope files instead of Kafka")
    ing.add_argument("--format", default="json")
    ing.add_argument("--checkpoint")
    ing.add_argument("--timeout", type=float, default=None, help="seconds to wait before stopping")
    ing.add_argument("--strict", action="store_true", help="dead-letter events that break the contract")
    ref = sub.add_parser("refresh")
    ref.add_argument("--mode", choices=["dynamic", "full"], help="one mode for all tables")
    ref.add_argument("--since", type=dt.date.fromisoformat)
    ref.add_argument("--apply-deletes", action="store_true")
    ref.add_argument("--parallel", type=int, default=1, help="concurrent builds per dependency level")
    ref.add_argument("--incremental", action="store_true", help="read only new bronze batches and rebuild the days they change")
    sub.add_parser("compact")
    sub.add_parser("statistics")
    chk = sub.add_parser("check")
    chk.add_argument("--nonempty", action="store_true")
    args = parser.parse_args(argv)

    from tidemark import schemas
    from tidemark.plans import compaction, incremental, refresh, statistics
    from tidemark.plans.catalog import REQUIRED_NONEMPTY, Lakehouse
    from tidemark.session import build_session
    from tidemark.sources import kafka
    from tidemark.streaming import ingest

    spark = build_session(f"tidemark-{args.cmd}")
    lh = Lakehouse(spark, root=args.root, prefix=args.prefix)

    if args.cmd == "init":
        lh.init().show(truncate=False)
    elif args.cmd == "ingest":
        if args.files:
            source = kafka.envelope_from_files(spark, args.files, args.format)
        elif args.kafka:
            if args.kind == "cdc":
                source = kafka.read_kafka_stream(spark, args.kafka, subscribe_pattern=kafka.CDC_TOPIC_PATTERN)
            else:
                source = kafka.read_kafka_stream(spark, args.kafka, subscribe=args.topic or kafka.CLICKSTREAM_TOPIC,
                                                 with_key=False).withColumn("key_json", F.lit(None).cast("string"))
        else:
            parser.error("give --kafka or --files")
        query = ingest.start_bronze_ingest(source, args.kind, lh, args.checkpoint, strict=args.strict)
        if not ingest.run_to_completion(query, args.timeout):
            print("ingest stopped at the timeout", file=sys.stderr)
            return 1
    elif args.cmd == "refresh" and args.incremental:
        if args.since or args.mode:
            parser.error("--incremental finds the days by itself")
        for table, days in incremental.refresh_incremental(lh, apply_deletes=args.apply_deletes).items():
            print(f"{table}: {len(days)} days changed")
    elif args.cmd == "compact":
        lh.init()
        for table in ("bronze.pg_cdc_raw", "bronze.clickstream_raw", "bronze.dlq_pg_cdc", "bronze.dlq_clickstream"):
            for row in incremental.bronze_batches(lh, table).select("ingest_id").distinct().collect():
                print(f"{table} {row.ingest_id}: up to batch {compaction.compact(lh, table, row.ingest_id)}")
    elif args.cmd == "statistics":
        lh.init()
        for table in [t for t in schemas.TABLES if not t.startswith("bronze.")]:
            print(f"{table}: {len(statistics.update_statistics(lh, table))} days read")
    elif args.cmd == "refresh":
        refresh.refresh_all(lh, mode=args.mode, since=args.since, apply_deletes=args.apply_deletes,
                            parallel=args.parallel, on_build=lambda t, s: print(f"{t}: {s:.1f}s"))
    elif args.cmd == "check":
        result = lh.check_nonempty(REQUIRED_NONEMPTY) if args.nonempty else lh.check_tables()
        rows = result.collect()  # one row per table: bounded by the registry
        for r in rows:
            print(r.asDict())
        bad = [r.table for r in rows if r.status != "ok" or (args.nonempty and not r.nonempty)]
        if bad:
            print(f"failed tables: {bad}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
