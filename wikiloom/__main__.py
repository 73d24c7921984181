"""Command line: ``python -m wikiloom run|validate --config FILE --tables DIR [--out DIR] [--mode full|updates] [--dry-run]``.

Tables are Parquet files named as in ``sources/tables.py``; ``cql_results`` is optional, and so is ``blobs``, a folder of
attachments named by id. ``run`` writes pages, attachments, metadata, snapshot, start page and checkpoints to the output
folder, which all executors must share (emptied first in full mode), and starts the configured hook at the end.
"""

from __future__ import annotations

import argparse
import os
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from wikiloom.operators import attachments, records
from wikiloom.plans import pipeline
from wikiloom.session import build_session
from wikiloom.sources import store
from wikiloom.sources.client import run_hook
from wikiloom.sources.config import Config
from wikiloom.sources.tables import read_table


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        config = Config.from_text(f.read())
    config.check()
    return config


TABLES = tuple(f"api_{t}" for t in ("pages", "comments", "attachments", "users"))


def read_inputs(spark: SparkSession, folder: str, config: Config, previous) -> pipeline.Inputs:
    tables = [read_table(spark, folder, t) for t in TABLES]
    related = read_table(spark, folder, "cql_results") if os.path.exists(f"{folder}/cql_results.parquet") else None
    limit = config.max_attachment_mb * 1024 * 1024
    blobs = attachments.read_blobs(spark, f"{folder}/blobs", limit) if config.download_attachments and os.path.isdir(f"{folder}/blobs") else None
    return pipeline.Inputs(*tables, config.seeds, related, previous, blobs)


def advanced(folder: str, mode: str, started: datetime, failed: int) -> dict:
    """Checkpoints after a run: completed always moves on, successful only when no page failed."""
    stamp = lambda at: at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    now = {"mode": mode, "started": stamp(started), "completed": stamp(datetime.now(timezone.utc))}
    return {**store.current(folder).get("checkpoints", {}), "completed": now, **({} if failed else {"successful": now})}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wikiloom", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("run", "validate"))
    parser.add_argument("--config", required=True)
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out")
    parser.add_argument("--mode", choices=records.MODES, default="full")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--run-id", type=int, default=1)
    args = parser.parse_args(argv)
    config = load(args.config)
    spark = build_session("wikiloom")
    out = args.out or config.output_dir
    if args.command == "validate":
        inputs = read_inputs(spark, args.tables, config, None)
        rows = {t: getattr(inputs, t).limit(1).count() for t in TABLES}
        print(f"readable: {', '.join(f'{t} ({n or "no"} row)' for t, n in rows.items())}; {len(config.seeds)} seeds, depth {config.max_depth}")
        return 0
    started = datetime.now(timezone.utc)
    previous = store.read_snapshot(spark, out) if args.mode == "updates" else None
    inputs = read_inputs(spark, args.tables, config, previous)
    result = pipeline.run(
        inputs,
        config.base_url(),
        started,
        args.mode,
        config.max_depth,
        config.max_attachment_mb,
        args.dry_run,
        download_attachments=config.download_attachments,
        max_queue=config.max_queue,
        follow_children=config.follow_children,
    )
    files = moved = None
    if not args.dry_run:
        # Checkpoints are read before a full run empties the folder; they are written after everything else.
        state = advanced(out, args.mode, started, result.failed)
        files = pipeline.export(result, inputs, out, args.run_id, lambda: state, clear=args.mode == "full")
        moved = not result.failed
    print(records.summary(args.mode, result.metrics, result.depths, args.dry_run, result.links, result.rewritten, files, moved))
    if config.post_hook_enabled:
        run_hook(config.post_hook, args.dry_run)
    return 1 if result.failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
