"""``python -m veilscan scan --store DIR ROOT...``, ``deploy`` and ``watch``."""

from __future__ import annotations

import argparse
import os

from veilscan.plans import jobs
from veilscan.session import session
from veilscan.sinks.store import Bus, Store, console
from veilscan.sources.files import default_roots
from veilscan.sources.tokens import read_manifest


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilscan")
    parser.add_argument("--master")
    own = parser.add_subparsers(dest="command", required=True)
    scan = own.add_parser("scan", help="scan folders and store findings")
    scan.add_argument("roots", nargs="*")
    scan.add_argument("--store", required=True)
    scan.add_argument("--mode", choices=("compat", "strict"), default="compat")
    scan.add_argument("--mask-context", action="store_true")
    deploy = own.add_parser("deploy", help="write honeytokens and their manifest")
    deploy.add_argument("--home", required=True)
    deploy.add_argument("--seed", type=int, default=1)
    watch = own.add_parser("watch", help="alert on events that touch honeytokens")
    watch.add_argument("--events", required=True)
    watch.add_argument("--store", required=True)
    watch.add_argument("--checkpoint", required=True)
    watch.add_argument("--once", action="store_true", help="handle what is there and end")
    for command in (deploy, watch):
        command.add_argument("--manifest", required=True)
        command.add_argument("--key-variable", default="VEILSCAN_KEY", help="environment variable that holds the manifest's key")
    given = parser.parse_args(arguments)
    spark = session(given.master)
    if given.command == "scan":
        bus = Bus()
        bus.subscribe(jobs.FINDING_TOPIC, console(["severity", "detector", "entity_type", "masked_value", "file_path"]))
        result = jobs.scan(spark, given.roots or default_roots(os.path.expanduser("~")), Store(spark, given.store), bus, mode=given.mode, mask_context=given.mask_context)
        print(*(f"{k}: {n}" for k, n in sorted(result.outcomes.items())), sep="\n")
    elif given.command == "deploy":
        jobs.deploy(spark, given.home, given.seed, given.manifest, os.environ[given.key_variable]).select("path", "token_type").show(truncate=False)
    else:
        query = jobs.watch(spark, given.events, read_manifest(spark, given.manifest, os.environ[given.key_variable]), Store(spark, given.store), given.checkpoint, available_now=given.once)
        query.awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
