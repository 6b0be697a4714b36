"""From candidates to stored findings, and the counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.functions import paths, text

EVENT_TYPE, SOURCE = "finding_discovered", "tracking_engine"


def to_findings(candidates: DataFrame, path: str | None = "file_path", ordinal: list[str] | None = None, mask_context: bool = False) -> DataFrame:
    """Masked findings with the stored schema.

    ``event_id`` is a digest of what identifies the finding (path, detector, entity, value, offsets and the columns
    named in ``ordinal``), so that a repeated run finds the same ids.  ``validated`` says that the rule asks for
    validation.  With ``mask_context`` the raw value is masked inside its context too.
    """
    where = F.coalesce(F.col(path) if path else F.lit(None).cast("string"), F.lit(""))
    where = F.when(where == "", F.coalesce("raw_value", F.lit(""))).otherwise(where)
    parts = [where, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("detector", "rule_name", "entity_type", "raw_value", "start", "end", *(ordinal or [])))]
    masked = text.mask(F.col("raw_value"))
    context = F.replace(F.col("context"), F.col("raw_value"), masked) if mask_context else F.col("context")
    nothing = F.lit(None).cast("string")
    return candidates.select(
        F.sha2(F.concat_ws("\x1f", *parts), 256).alias("event_id"),
        F.current_timestamp().alias("timestamp"),
        text.severity(F.col("category")).alias("severity"),
        F.lit(EVENT_TYPE).alias("event_type"),
        F.lit(SOURCE).alias("source"),
        nothing.alias("raw_extract"),
        nothing.alias("vault_ref"),
        where.alias("file_path"),
        "detector",
        "entity_type",
        masked.alias("masked_value"),
        context.alias("context"),
        "confidence",
        F.lit(None).cast("int").alias("line_number"),
        F.col("requires_validation").alias("validated"),
    )


def within_size(length: Column) -> Column:
    """Whether a file is small enough to be scanned."""
    return length <= R.MAX_FILE_BYTES


def decisions(files: DataFrame, path: str = "path", tables: str | None = None) -> DataFrame:
    """The files with their scan decision."""
    return files.withColumn("decision", paths.scan_decision(F.col(path), F.col(tables) if tables else None))


def scan_statistics(files: DataFrame) -> DataFrame:
    """decision and n over a table with a decision column."""
    return files.groupBy("decision").agg(F.count("*").alias("n"))


def drop_known(df: DataFrame, tokens: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is none of a honeytoken's: an anti join; the side to broadcast is left to the size Spark sees."""
    known = tokens.select(paths.normalized(F.col("path")).alias("_known")).distinct()
    return df.join(known, paths.normalized(F.col(path)) == F.col("_known"), "left_anti")


def outermost_roots(roots: DataFrame, path: str = "path") -> DataFrame:
    """Roots that do not lie below another one: each root's proper ancestors are looked up among the roots."""
    own = roots.select(F.col(path).alias("root")).distinct()
    parts = F.split("root", "/")
    above = own.select("root", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))).alias("above"))
    above = above.where(F.col("above") != F.col("root")).select("root", F.when(F.col("above") == "", "/").otherwise(F.col("above")).alias("above"))
    nested = above.join(own.select(F.col("root").alias("above")), "above", "left_semi").where("above <> root").select("root")
    return own.join(nested, "root", "left_anti")


def metrics(candidates: DataFrame) -> list[Column]:
    """Counters to observe while a plan runs."""
    return [F.count("*").alias("candidates"), F.count_if(F.col("detector") == "regex").alias("regex"), F.count_if(F.col("detector") == "entropy").alias("entropy"), F.count_if(F.col("requires_validation")).alias("regex_validated")]
