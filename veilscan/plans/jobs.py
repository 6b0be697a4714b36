"""Whole jobs: scan folders into a store, deploy honeytokens, watch for events on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.functions import paths
from veilscan.operators import detect, findings
from veilscan.sinks.store import Bus, Store, console
from veilscan.sources import files, tokens
from veilscan.streaming import alerts

FINDING_TOPIC = "FINDING_DISCOVERED"


@dataclass
class ScanResult:
    """What a scan found that the store did not have (see :meth:`Store.append`), and how many files came to which end."""

    findings: DataFrame
    outcomes: dict[str, int] = field(default_factory=dict)


def outcomes(listed: DataFrame, honeytokens: DataFrame | None = None) -> DataFrame:
    """The listed files with their one outcome: honeytoken, excluded, unsupported_extension, unreadable, too_large, no_parser or scanned."""
    parser = paths.triage(F.col("path"), F.col("head"))
    decision = paths.scan_decision(F.col("path"), F.col("table_names"))
    own = listed
    token = F.lit(False)
    if honeytokens is not None:
        known = honeytokens.select(paths.normalized(F.col("path")).alias("_token")).distinct()
        own = listed.join(known, paths.normalized(F.col("path")) == F.col("_token"), "left")
        token = F.col("_token").isNotNull()
    outcome = (
        F.when(token, "honeytoken")
        .when(decision != "scan", decision)
        .when(F.col("length").isNull() | F.col("head").isNull(), "unreadable")
        .when(~findings.within_size(F.col("length")), "too_large")
        .when(~parser.isin("text_parser", "sqlite_parser"), "no_parser")
        .otherwise("scanned")
    )
    return own.select(*listed.columns, outcome.alias("outcome"), parser.alias("parser"))


def file_counters(judged: DataFrame) -> DataFrame:
    """counter, n: files scanned, skipped and excluded, of files with their outcome."""
    kinds = {"files_scanned": ["scanned"], "files_skipped": ["unsupported_extension", "unreadable", "too_large", "no_parser"], "files_excluded": ["excluded", "honeytoken"]}
    return detect.as_rows(judged.agg(*(F.count_if(F.col("outcome").isin(own)).alias(name) for name, own in kinds.items())))


def scan(spark: SparkSession, roots: list[str], store: Store | None = None, bus: Bus | None = None, honeytokens: DataFrame | None = None, mode: str = "compat", mask_context: bool = False) -> ScanResult:
    """Scan folders: list, decide, parse, detect, store and publish what is new."""
    listed = outcomes(files.list_files(spark, roots), honeytokens).persist()
    try:
        counts = {r["outcome"]: r["n"] for r in listed.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        chunks = files.parse(listed.where("outcome = 'scanned'").select("path", "parser"))
        found = detect.detect(chunks, ["file_path"], content="content", path="file_path", mode=mode)
        rows = findings.to_findings(found, mask_context=mask_context)
        if store:
            rows = store.append("findings", rows)
        else:
            rows = rows.persist()
            rows.count()  # while the list of files is at hand
        if bus:
            bus.publish(FINDING_TOPIC, rows)
        return ScanResult(rows, counts)
    finally:
        listed.unpersist()


def deploy(spark: SparkSession, home: str, seed: int, manifest: str, key: str) -> DataFrame:
    """Write honeytokens below ``home`` where nothing is in their place, and the manifest that knows them."""
    made = tokens.manifest(spark, tokens.deploy(home, seed))
    known = tokens.read_manifest(spark, manifest, key)
    every = spark.createDataFrame(known.unionByName(made).collect(), known.schema)  # a handful of rows, read before they are replaced
    tokens.write_manifest(every, manifest, key)
    return every


def watch(spark: SparkSession, events: str, manifest: DataFrame, store: Store, checkpoint: str, bus: Bus | None = None, sysmon: Callable[[], DataFrame] | None = None, processes: Callable[[], DataFrame] | None = None, available_now: bool = False) -> StreamingQuery:
    """Alerts for events, dropped as JSON into the folder ``events``, on the manifest's files."""
    told = bus or Bus()
    if bus is None:
        told.subscribe(alerts.TOPIC, console(["timestamp", "severity", "incident_type", "honeytoken_path", "process_name", "attribution_source"]))
    return alerts.start(alerts.file_events(spark, events), manifest, store, told, checkpoint, sysmon, processes, available_now)
