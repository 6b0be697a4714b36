"""Honeytoken events: which token, which process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.functions.paths import normalized


def unfolded(events: DataFrame) -> DataFrame:
    """One row per touched path: a move touches two.  Events on folders are left out."""
    moved = F.col("kind") == "moved"
    both = F.array(F.struct(F.col("src_path").alias("path"), F.col("kind").alias("event_type")), F.struct(F.col("dest_path").alias("path"), F.lit("moved_to").alias("event_type")))
    touched = F.when(moved, both).otherwise(F.slice(both, 1, 1))
    rows = events.where(~F.coalesce(F.col("is_directory"), F.lit(False))).withColumn("_t", F.explode(touched))
    return rows.select(*[c for c in events.columns if c not in ("kind", "src_path", "dest_path", "is_directory")], F.col("_t.path").alias("path"), F.col("_t.event_type").alias("event_type")).where("path is not null")


def incident(event_type: Column) -> Column:
    chain = None
    for kind, name in R.INCIDENTS.items():
        chain = F.when(event_type == kind, name) if chain is None else chain.when(event_type == kind, name)
    return chain


def token_events(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Touched paths that are honeytokens, with the token and the kind of incident."""
    known = tokens.select(normalized(F.col("path")).alias("_norm"), "token_id", "token_type")
    rows = unfolded(events).withColumn("_norm", normalized(F.col("path")))
    return rows.join(known, "_norm").drop("_norm").withColumn("incident_type", incident(F.col("event_type")))


#: Up to so many touched paths are looked for in each log row; a manifest has far fewer.
NAMED_PATHS = 2_000


def nearest_in_time(alerts: DataFrame, sysmon: DataFrame, seconds: int = R.CORRELATION_SECONDS) -> DataFrame:
    """Each alert (alert_id, event_time, path) with the process that the system log names within some seconds, if any.

    First it is found out which of the touched paths, few and broadcast, a log row names.  What remains is an interval join on
    equal paths: both sides are cut into slots as long as the interval, alerts go to the slot before, their own and
    the next, and equal slots and paths meet.  Where more paths are touched than a broadcast should hold, slots alone
    meet and the names are tested there.  A log entry whose target is the path comes before one whose command line
    has it; of the former the newest counts, of the latter the oldest.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    plain = lambda c: F.coalesce(F.lower(normalized(F.col(c))), F.lit(""))
    log = sysmon.where("system_time is not null").select(
        slot(F.col("system_time")).alias("_slot"), "system_time", plain("target_filename").alias("_file"), plain("command_line").alias("_command"), "image", F.col("process_id").alias("_pid"), F.col("user").alias("_user")
    )
    own = alerts.select("alert_id", "event_time", F.lower(normalized(F.col("path"))).alias("_path"))
    spread = own.withColumn("_slot", F.explode(F.sequence(slot(F.col("event_time")) - 1, slot(F.col("event_time")) + 1)))
    target, command = F.contains("_file", F.col("_path")), F.contains("_command", F.col("_path"))
    touched = own.select("_path").distinct()
    if touched.limit(NAMED_PATHS + 1).count() <= NAMED_PATHS:
        named = log.join(F.broadcast(touched), target | command)
        met = spread.join(named, ["_slot", "_path"]).withColumn("_target", target)
    else:
        met = spread.join(log, "_slot").withColumn("_target", target).where(F.col("_target") | command)
    # micros, not seconds: the bound is inclusive and exact
    met = met.where(F.abs(F.unix_micros("event_time") - F.unix_micros("system_time")) <= seconds * 1_000_000)
    age = F.when(F.col("_target"), -F.unix_micros("system_time")).otherwise(F.unix_micros("system_time"))
    best = met.groupBy("alert_id").agg(F.min(F.struct((~F.col("_target")).alias("later"), age.alias("age"), F.col("_pid"), F.col("image"), F.col("_user"))).alias("b"))
    named = best.select(
        "alert_id",
        F.regexp_extract(normalized(F.col("b.image")), r"([^/]*)$", 1).alias("process_name"),
        F.col("b._pid").alias("process_id"),
        F.col("b._user").alias("username"),
        F.col("b.image").alias("process_path"),
    )
    out = alerts.join(named.withColumn("attribution_source", F.lit("SYSMON")), "alert_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("UNKNOWN")) for c in ("process_name", "username", "process_path", "attribution_source")})


def fall_back(alerts: DataFrame, processes: DataFrame) -> DataFrame:
    """Alerts that the log told nothing about get the first process (least pid) that has the file open, if any."""
    opened = processes.select(F.explode("open_files").alias("_file"), "pid", "name", "username", "exe")
    first = opened.groupBy(normalized(F.col("_file")).alias("_norm")).agg(F.min(F.struct("pid", "name", F.col("username").alias("owner"), "exe")).alias("p"))
    unknown = F.col("attribution_source") == "UNKNOWN"
    key = F.when(unknown, normalized(F.col("path"))).otherwise(F.concat(F.lit("\x00"), F.col("alert_id").cast("string")))  # known ones are spread, not looked up
    joined = alerts.withColumn("_norm", key).join(first, "_norm", "left")
    found = unknown & F.col("p").isNotNull()
    told = lambda other: F.col("p.pid") if other == "pid" else F.coalesce(F.col(f"p.{other}"), F.lit("UNKNOWN"))
    pick = lambda own, other: F.when(found, told(other)).otherwise(F.col(own)).alias(own)
    rest = [c for c in alerts.columns if c not in ("process_name", "process_id", "username", "process_path", "attribution_source")]
    return joined.select(*rest, pick("process_name", "name"), pick("process_id", "pid"), pick("username", "owner"), pick("process_path", "exe"), F.when(found, "FALLBACK").otherwise(F.col("attribution_source")).alias("attribution_source"))


def newest(log: DataFrame, n: int = R.SYSMON_LOOKBACK, by: str = "system_time", tie: str = "event_id") -> DataFrame:
    """The ``n`` newest entries: a top-n, which keeps n rows of each partition."""
    return log.orderBy(F.desc(by), F.desc(tie)).limit(n)


def to_alerts(attributed: DataFrame) -> DataFrame:
    """Stored alerts; the id is a digest of what the alert is about."""
    nothing = F.lit(None).cast("string")
    return attributed.select(
        F.sha2(F.concat_ws("\x1f", F.col("path"), F.col("token_id"), F.col("event_type"), F.unix_micros("event_time").cast("string"), F.col("alert_id").cast("string")), 256).alias("event_id"),
        F.col("event_time").alias("timestamp"),
        F.lit("CRITICAL").alias("severity"),
        "event_type",
        F.lit("honeycomb").alias("source"),
        nothing.alias("raw_extract"),
        nothing.alias("vault_ref"),
        F.col("path").alias("honeytoken_path"),
        "token_id",
        "token_type",
        "incident_type",
        F.lit(1.0).alias("confidence"),
        "process_name",
        F.col("process_id").cast("int").alias("process_id"),
        "username",
        "process_path",
        "attribution_source",
    )


def incidents_by_window(alerts: DataFrame, length: str = "5 minutes", time: str = "timestamp") -> DataFrame:
    """Alerts of each kind in tumbling windows."""
    rows = alerts.groupBy(F.window(time, length).alias("w"), "incident_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "incident_type", "n")
