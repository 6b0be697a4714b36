"""Where findings and alerts go: Parquet tables that only grow, and callbacks on topics."""

from __future__ import annotations

import logging
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.schemas import ALERTS, FINDINGS

LOG = logging.getLogger(__name__)
SCHEMAS = {"findings": FINDINGS, "honeycomb_alerts": ALERTS}


class Store:
    """Tables below one folder, in folders by the first digits of their ids.  New columns are added by writing them:
    reading merges the files' schemas."""

    #: Hexadecimal digits of an id that name its folder: a batch looks for known ids in the folders of its own only.
    DIGITS = 2

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._batch: str | None = None

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _stored(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(self, table: str) -> DataFrame:
        """The table; empty, with its schema, where nothing was written yet."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        rows = self._stored(table)
        return empty if rows is None else empty.unionByName(rows.drop("id_digits"), allowMissingColumns=True)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add the rows whose event_id is not there yet, each once.

        These are returned, from a place of their own that lasts until the next call: a cached frame would be
        worked out anew, and against itself, as soon as the table has grown.
        """
        rows = rows.dropDuplicates(["event_id"]).withColumn("id_digits", F.concat(F.lit("x"), F.left("event_id", F.lit(self.DIGITS)))).persist()
        new, known = rows, self._stored(table)
        if known is not None:
            touched = [r["id_digits"] for r in rows.select("id_digits").distinct().collect()]  # at most 16 ** DIGITS
            new = rows.join(known.where(F.col("id_digits").isin(touched)).select("event_id"), "event_id", "left_anti").select(rows.columns)
        self._drop_batch()
        self._batch = f"{self.folder}/_batches/{table}-{uuid.uuid4().hex}"
        new.write.parquet(self._batch)
        rows.unpersist()
        new = self.spark.read.schema(new.schema).parquet(self._batch)
        new.write.mode("append").partitionBy("id_digits").parquet(self.path(table))
        return new.drop("id_digits")

    def _drop_batch(self) -> None:
        if self._batch:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._batch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Bus:
    """Topics and their subscribers; one that fails does not keep others from being told."""

    def __init__(self) -> None:
        self.subscribers: dict[str, list[Callable[[DataFrame], None]]] = defaultdict(list)

    def subscribe(self, topic: str, callback: Callable[[DataFrame], None]) -> None:
        self.subscribers[topic].append(callback)

    def publish(self, topic: str, rows: DataFrame) -> int:
        """How many subscribers were told without an error."""
        told = 0
        for callback in self.subscribers.get(topic, ()):
            try:
                callback(rows)
                told += 1
            except Exception:
                LOG.exception("a subscriber of %s failed", topic)
        return told


def console(columns: list[str], rows: int = 20) -> Callable[[DataFrame], None]:
    """A subscriber that prints some columns of the first rows."""

    def show(df: DataFrame) -> None:
        df.select(*columns).show(rows, truncate=False)

    return show
