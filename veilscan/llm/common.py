"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of characters that are none of the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark's own reader whatever the store is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where that is unset
    and all run on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors have no folder to share")
        configured = f"file://{tempfile.mkdtemp(prefix='veilscan-')}"
        spark.sparkContext.setCheckpointDir(configured)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder name inside the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Remove the scratch tables of this program, whose results must have been written by then; how many there were."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that a lost executor doesn't repeat what made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the value's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


#: Rows of texts that a worker turns into Python objects at once.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of a few rows, so that a worker holds the objects of one part only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to the rows of ``df``, a few at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(rows)


#: Rows that a Python worker is sent at once; texts make these large.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, kind: str, batch_rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and nothing of the old layout is assumed.

    ``batch_rows`` bounds what Python workers are sent at once while the table is made.
    """
    spark = df.sparkSession
    path = scratch(spark, kind)
    usual = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, usual)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): one row (id, root) per linked id, root being the least id.

    By contraction: in each round every node goes over to the one of itself and its neighbours that has the least hash,
    another hash each time, and links are drawn anew between what nodes went over to, until none is left.  A star takes
    two rounds, a chain as many as the logarithm of its length, as a good part of its nodes goes each time.
    Then the rounds are followed back.  All are partial aggregates and equi-joins, so a node with very many
    links is combined before the shuffle or split by adaptive execution.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, salt=f"round {len(rounds)}": F.struct(F.xxhash64(F.lit(salt), c).alias("rank"), F.col(c).alias("id"))
        over = written(edges.groupBy("a").agg(F.least(F.min(rank("b")), rank("a"))["id"].alias("over")), "over")
        rounds.append(over)
        from_a = edges.join(over, "a").select(F.col("over").alias("x"), "b")
        drawn = from_a.join(over.select(F.col("a").alias("b"), "over"), "b").where("x <> over")
        edges = written(drawn.select(F.col("x").alias("a"), F.col("over").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    last = rounds.pop()
    for over in reversed(rounds):
        last = over.join(last.select(F.col("a").alias("over"), F.col("over").alias("later")), "over", "left").select("a", F.coalesce("later", "over").alias("over"))
    last = written(last, "ends")
    least = last.groupBy("over").agg(F.min("a").alias("root"))
    return written(last.join(least, "over").select(F.col("a").alias("id"), "root"), "components")


#: A bitmap row has this many bits; all rows together are at most 2 ** 30 bits, 128 MB, however many ids there are.
_BITMAP_BITS, _LEAST_BITS, _MOST_BITS = 32_768, 20, 30


def unused(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mark_members(df: DataFrame, key: str, ids: DataFrame, mark: str) -> DataFrame:
    """``df`` with a boolean column: false only for rows whose ``key`` is surely none of ``ids`` (one column, long).

    The ids' hashes set bits of a bitmap whose size is bounded, so it can be broadcast whatever their number; rows
    that are told apart by it need no shuffle.
    """
    column = ids.columns[0]
    n = max(1, ids.count())
    bits = min(_MOST_BITS, max(_LEAST_BITS, (16 * n).bit_length()))

    def spot(c: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(F.lit("bitmap"), c.cast("long")), F.lit(1 << bits))

    def row(c: F.Column) -> F.Column:
        return F.floor(spot(c) / _BITMAP_BITS)

    at = spot(F.col(column)) % _BITMAP_BITS
    line, bits_of = unused("line", df), unused("bits", df)
    bitmap = ids.groupBy(row(F.col(column)).alias(line)).agg(F.bitmap_construct_agg(at).alias(bits_of))
    place = spot(df[key]) % _BITMAP_BITS
    byte = F.conv(F.hex(F.col(bits_of).substr((F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place % 8).cast("int") + 1)
    member = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    marked = df.join(F.broadcast(bitmap), row(df[key]) == F.col(line), "left")
    return marked.select(*(df[c] for c in df.columns), member.alias(mark))
