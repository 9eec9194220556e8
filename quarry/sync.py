"""The sync as a command: python -m quarry.sync --store FOLDER --snapshot FILE [options]."""

from __future__ import annotations

import argparse
import sys
import urllib.error
import urllib.request
from datetime import UTC, datetime

from pyspark.sql import functions as F

from quarry.plans import syncing
from quarry.session import session
from quarry.sources import fetch, tables
from quarry.sources.store import Store


def over_http(url: str) -> fetch.Answer:
    """A getter for live pages."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "quarry"}), timeout=60) as got:
            return fetch.Answer(got.status, got.url, got.read().decode("utf-8", "replace"))
    except urllib.error.HTTPError as error:
        return fetch.Answer(error.code, error.url or url)


def parsed(argv: list[str]) -> argparse.Namespace:
    args = argparse.ArgumentParser(prog="quarry.sync", description=__doc__)
    args.add_argument("--store", required=True, help="folder of the versioned tables")
    args.add_argument("--snapshot", help="a landed index snapshot, {count, data}; not needed to resume")
    args.add_argument("--site", default=fetch.SITE)
    args.add_argument("--batch-size", type=int, default=500)
    args.add_argument("--refresh-window", type=int, default=1000)
    args.add_argument("--mode", choices=("catchup", "nightly"), default="catchup")
    args.add_argument("--streams", type=int, default=1, help="polite streams of requests")
    for flag in ("resume", "dry-run", "force-new", "index-diff-only", "create"):
        args.add_argument(f"--{flag}", action="store_true")
    return args.parse_args(argv)


def main(argv: list[str], get: fetch.Getter = over_http) -> int:
    args = parsed(argv)
    if not args.resume and not args.snapshot:
        print("a snapshot is needed unless a run is resumed", file=sys.stderr)
        return syncing.REFUSED
    try:
        options = syncing.Options(args.batch_size, args.refresh_window, args.resume, args.dry_run, args.force_new, args.index_diff_only, args.mode, args.site, {"streams": args.streams})
        spark = session("sync")
        store = Store(spark, args.store, create=args.create)
    except (ValueError, tables.MissingTable) as error:
        print(error, file=sys.stderr)
        return syncing.REFUSED
    entries = None
    if args.snapshot and not args.resume:
        names = {"InquiryType": "inquiry_type", "VehicleData": "vehicle_data", "SubmissionDate": "submission_date", "ResolutionDate": "resolution_date"}
        entries = tables.index_snapshot(spark, args.snapshot).select("pos", "db_id", "database", "status", *[F.col(a).alias(b) for a, b in names.items()])
    result = syncing.Sync(store, lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")).run(get, entries, options)
    print("\n".join(syncing.lines(result, options)))
    return result.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
