"""Command line: ``python -m postroom --store DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from postroom.operators.aggregates import against_mailbox
from postroom.plans import jobs
from postroom.plans.config import EngineConfig, Limits
from postroom.plans.engine import MailEngine
from postroom.session import build_session
from postroom.sources import mailbox
from postroom.sources.store import MailStore


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="postroom")
    p.add_argument("--store", required=True)
    p.add_argument("--master")
    p.add_argument("--capabilities", help="capabilities document with model limits")
    p.add_argument("--dim", type=int, default=768)
    sub = p.add_subparsers(dest="command", required=True)
    sync = sub.add_parser("sync", help="store an export of messages (JSON lines)")
    sync.add_argument("account_id", type=int)
    sync.add_argument("path")
    sync.add_argument("--batch", type=int, required=True)
    sync.add_argument("--limit", type=int, help="take only so many messages")
    labels = sub.add_parser("labels", help="replace the labels of accounts (JSON lines: account_id, label_id, label_name)")
    labels.add_argument("path")
    sub.add_parser("compact", help="fold what is new into a snapshot")
    drop = sub.add_parser("drop-old", help="remove what only older snapshots name")
    drop.add_argument("--keep", type=int, default=1)
    tr = sub.add_parser("transform")
    tr.add_argument("account_id", type=int, nargs="?")
    tr.add_argument("--email-id", type=int)
    tr.add_argument("--force", action="store_true")
    tr.add_argument("--limit", type=int)
    reset = sub.add_parser("reset-transform")
    reset.add_argument("account_id", type=int, nargs="?")
    sub.add_parser("publish")
    check = sub.add_parser("validate", help="report per account; exit code 1 if a given mailbox total differs")
    check.add_argument("--total", action="append", default=[], metavar="ACCOUNT=MESSAGES")
    sub.add_parser("capabilities")
    get = sub.add_parser("get-email")
    get.add_argument("id")
    get.add_argument("--raw", action="store_true")
    get.add_argument("--full", action="store_true")
    find = sub.add_parser("search")
    find.add_argument("query", nargs="?", default="")
    find.add_argument("--filters", type=json.loads, default=[])
    find.add_argument("--mode", default="search", choices=["search", "count", "aggregate"])
    find.add_argument("--group-by")
    find.add_argument("--top-k", type=int, default=10)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session("postroom", args.master)
    store = MailStore(spark, args.store)
    limits = Limits.load(args.capabilities) if args.capabilities else Limits()
    config = EngineConfig(limits=limits, dim=args.dim)
    if args.command == "sync":
        n = jobs.full_sync(store, mailbox.read_export(spark, args.path), args.account_id, args.batch, args.limit)
        print(json.dumps({"new": n}))
    elif args.command == "transform":
        print(
            json.dumps(
                jobs.run_transform(
                    store, config, args.account_id, args.email_id, args.force, args.limit
                )
            )
        )
    elif args.command == "reset-transform":
        store.reset(args.account_id)
    elif args.command == "labels":
        jobs.sync_labels(store, spark.read.schema(jobs.LABELS).json(args.path))
    elif args.command == "compact":
        print(json.dumps({"snapshot": store.compact()}))
    elif args.command == "drop-old":
        print(json.dumps({"removed": store.drop_old(args.keep)}))
    elif args.command == "publish":
        store.publish()
    elif args.command == "capabilities":
        print(json.dumps(MailEngine.capabilities(), indent=2))
    else:
        labels = store.newest("labels", jobs.LABELS)
        engine = MailEngine(store.served(), labels, config, store.index())
        if args.command == "validate":
            report = MailEngine(store.emails(), labels, config).report()
            if args.total:
                pairs = [tuple(map(int, t.split("="))) for t in args.total]
                totals = spark.createDataFrame(pairs, "account_id int, messages_total long")
                report = against_mailbox(report, totals).join(totals.select("account_id"), "account_id")
            bad = False
            for line in report.orderBy("account_id").toJSON().toLocalIterator():
                print(line)
                bad |= not json.loads(line).get("matches", True)
            return int(bad)
        elif args.command == "get-email":
            found = engine.show(args.id, args.raw, args.full).toJSON().take(1)
            print(found[0] if found else "not found", file=sys.stdout if found else sys.stderr)
            return 0 if found else 1
        else:
            answer = engine.unified(
                args.query, None, args.filters, args.top_k, None, args.mode, args.group_by
            )
            print(json.dumps(answer))
    return 0


if __name__ == "__main__":
    sys.exit(main())
