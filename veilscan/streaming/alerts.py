"""Honeytoken alerts from a stream of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan import rules as R
from veilscan.functions.paths import normalized
from veilscan.operators import correlation
from veilscan.schemas import FILE_EVENTS, PROCESSES, SYSMON
from veilscan.sinks.store import Bus, Store

TOPIC = "HONEYTOKEN_TRIGGERED"


def file_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """File events that some watcher drops as JSON files into a folder."""
    return spark.readStream.schema(FILE_EVENTS).option("maxFilesPerTrigger", str(files_per_trigger)).json(folder)


def numbered(touched: DataFrame) -> DataFrame:
    """``touched`` with an alert_id: each event is one of its own, delivered again or not.

    An event that has an id is known by it.  Of those that have none, equal ones of a batch are told apart by a number, so a
    batch that is run again finds the same ids.
    """
    own = F.col("event_id").cast("string") if "event_id" in touched.columns else F.lit(None).cast("string")
    rows = touched.withColumn("_own", own)
    equal = Window.partitionBy("_own", "path", "event_type", "event_time", "token_id").orderBy("event_time")
    parts = [F.coalesce("_own", F.row_number().over(equal).cast("string")), F.when(F.col("_own").isNull(), "number").otherwise("id"), F.col("path"), F.col("token_id"), F.col("event_type"), F.unix_micros("event_time").cast("string")]
    return rows.withColumn("alert_id", F.sha2(F.concat_ws("\x1f", *parts), 256)).drop("_own").dropDuplicates(["alert_id"])


def attributed(touched: DataFrame, sysmon: DataFrame, processes: DataFrame) -> DataFrame:
    """Alerts for touched tokens: the system log first, then the process table."""
    return correlation.to_alerts(correlation.fall_back(correlation.nearest_in_time(numbered(touched), sysmon), processes))


def start(
    events: DataFrame,
    tokens: DataFrame,
    store: Store,
    bus: Bus,
    checkpoint: str,
    sysmon: Callable[[], DataFrame] | None = None,
    processes: Callable[[], DataFrame] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the alert stream.

    The join with the manifest is stream-static.  Attribution looks into the log and the process table as they are
    when a batch is handled, which delays no alert.  A batch that is run again after a failure finds its ids in the
    store and adds nothing.
    """
    spark = events.sparkSession
    touched = correlation.token_events(events, tokens)

    def handle(batch: DataFrame, number: int) -> None:  # noqa: ARG001
        log = sysmon() if sysmon else spark.createDataFrame([], SYSMON)
        running = processes() if processes else spark.createDataFrame([], PROCESSES)
        batch = batch.persist()
        try:
            alerts = attributed(batch, log, running).persist()
            store.append("honeycomb_alerts", alerts)
            bus.publish(TOPIC, alerts)
            alerts.unpersist()
        finally:
            batch.unpersist()

    writer = touched.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def correlated(touched: DataFrame, log: DataFrame, lateness: str = "1 minute", seconds: int = R.CORRELATION_SECONDS) -> DataFrame:
    """Both sides as streams: touched tokens meet log entries near in time, in slots as long as the interval.

    Watermarks bound the state.  One row per pair; the best entry of each alert is chosen by whoever takes the rows.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    left = touched.withWatermark("event_time", lateness).withColumn("slot", F.explode(F.array(*(slot(F.col("event_time")) + k for k in (-1, 0, 1)))))
    right = log.withWatermark("system_time", lateness).withColumn("log_slot", slot(F.col("system_time")))
    near = F.expr(f"system_time BETWEEN event_time - INTERVAL {seconds} SECONDS AND event_time + INTERVAL {seconds} SECONDS")
    path = F.lower(normalized(F.col("path")))
    named = F.contains(F.lower(normalized(F.col("target_filename"))), path) | F.contains(F.lower(normalized(F.col("command_line"))), path)
    return left.join(right, (F.col("slot") == F.col("log_slot")) & near & named).drop("slot", "log_slot")


def incidents(alerts: DataFrame, length: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Streaming counts of incidents in tumbling windows."""
    return correlation.incidents_by_window(alerts.withWatermark("timestamp", lateness), length)
