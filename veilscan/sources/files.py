"""Files below root folders, as a Spark data source written in Python.

Spark's own ``binaryFile`` silently leaves out names that begin with a dot, such as ``.env``, so folders are walked
here: excluded folders are pruned before they are entered, and subtrees, cut as deep as it takes, are partitions.  Listing
gives path, length and the first bytes; contents are read later, only for files that are to be scanned.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilscan import rules as R
from veilscan.functions import paths
from veilscan.operators.findings import within_size
from veilscan.schemas import CHUNKS

FILES = "path string, length bigint, head binary, table_names array<string>"


def plain_excluded(path: str) -> bool:
    """Whether a folder is to be pruned: the policy for one path, as the reader needs it while it walks."""
    low = path.replace("\\", "/").lower()
    parts = [p for p in low.split("/") if p]
    name = parts[-1] if parts else ""
    return (
        name.startswith("$")
        or name == "system volume information"
        or not set(parts).isdisjoint(R.EXCLUDED_COMPONENTS)
        or name in R.EXCLUDED_FILES
        or any(p.endswith(".app") for p in parts)
        or ("downloads" in parts and any(os.path.splitext(p)[1] in R.DISTRIBUTION_EXTENSIONS for p in parts))
        or any(part in low for part in R.EXCLUDED_PATH_PARTS)
    )


def opened(path: str) -> closing[sqlite3.Connection]:
    """An SQLite file, read-only, closed in the end."""
    return closing(sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True))


def table_names(path: str) -> list[str]:
    """Tables of an SQLite file, opened read-only; none where it is no such file."""
    try:
        with opened(path) as db:
            return sorted(row[0] for row in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))
    except sqlite3.Error:
        return []


#: Folders that a walk is shared out by, at least, if there are so many.
PARTITIONS = 256


def subfolders(folder: str) -> list[str]:
    try:
        return sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not plain_excluded(e.path))
    except OSError:
        return []


class _Subtree(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [r for r in options.get("roots", "").split(os.pathsep) if r]

    def partitions(self) -> list[_Subtree]:
        out = []
        for root in map(os.path.abspath, self.roots):
            if not os.path.isdir(root):
                continue
            # breadth first, until there are folders enough to share out; each is a task for its own files or for all below it
            level = [root]
            while level and len(out) + len(level) < PARTITIONS:
                out += (_Subtree(folder, False) for folder in level)
                level = [below for folder in level for below in subfolders(folder)]
            out += (_Subtree(folder, True) for folder in level)
        return out

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        for folder, below, names in os.walk(partition.path):
            below[:] = sorted(d for d in below if not plain_excluded(os.path.join(folder, d))) if partition.deep else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    with open(path, "rb") as f:
                        head = f.read(512)
                    length = os.stat(path).st_size
                except OSError:
                    head = length = None
                yield path, length, head, table_names(path) if name.lower().endswith((".db", ".sqlite", ".sqlite3")) else None


class FilesDataSource(DataSource):
    """``spark.read.format("veilscan_files").option("roots", "/a:/b")``"""

    @classmethod
    def name(cls) -> str:
        return "veilscan_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _FilesReader(self.options)


def default_roots(home: str) -> list[str]:
    return [os.path.join(home, name) for name in ("Desktop", "Documents", "Downloads")]


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    spark.dataSource.register(FilesDataSource)
    return spark.read.format("veilscan_files").option("roots", os.pathsep.join(roots)).load()


def eligible(files: DataFrame) -> DataFrame:
    """Files that the policy scans, of a size that is scanned, with the parser that their first bytes ask for."""
    rows = files.withColumn("decision", paths.scan_decision(F.col("path"), F.col("table_names")))
    rows = rows.where((F.col("decision") == "scan") & within_size(F.col("length")))
    return rows.withColumn("parser", paths.triage(F.col("path"), F.col("head"))).where("parser <> 'SKIP'")


def decode_text(data: bytes) -> tuple[str, str]:
    """Text and the encoding it was read by: a byte order mark's, else strict UTF-8, else cp1252, else latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "ignore"), name
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"


def sqlite_cells(path: str) -> Iterator[tuple[str, int, int, str]]:
    """(table, row, column, text) of all text cells; a table that can't be read is left out."""
    with opened(path) as db:
        db.text_factory = lambda b: b.decode("utf-8", "ignore")
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
            try:
                quoted = name.replace('"', '""')
                for row_no, row in enumerate(db.execute(f'SELECT * FROM "{quoted}"')):
                    yield from ((name, row_no, col_no, cell) for col_no, cell in enumerate(row) if isinstance(cell, str))
            except sqlite3.Error:
                continue


def parse_one(path: str, parser: str) -> tuple[str, dict[str, str]]:
    try:
        if parser == "sqlite_parser":
            return "\n".join(cell for *_, cell in sqlite_cells(path)), {"tables": str(len(table_names(path)))}
        with open(path, "rb") as f:
            text, encoding = decode_text(f.read(R.MAX_FILE_BYTES))
        return text, {"encoding": encoding}
    except (OSError, sqlite3.Error):
        return "", {}


def parse(files: DataFrame) -> DataFrame:
    """One chunk (file_path, content, metadata) per file with a parser for it; unreadable files have empty content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file_path", pa.string()), ("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for path, parser in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content, about = parse_one(path, parser)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content]), pa.array([list(about.items())], kinds.field(2).type)], schema=kinds)

    return files.where(F.col("parser").isin("text_parser", "sqlite_parser")).select("path", "parser").mapInArrow(run, CHUNKS)


def cells(files: DataFrame) -> DataFrame:
    """file_path, table_name, row_no, col_no, cell of all text cells of SQLite files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("file_path", pa.string()), ("table_name", pa.string()), ("row_no", pa.int64()), ("col_no", pa.int32()), ("cell", pa.string())]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for cell in sqlite_cells(path):
                    rows.append((path, *cell))
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return files.select("path").mapInArrow(run, "file_path string, table_name string, row_no bigint, col_no int, cell string")


#: Bytes of what a worker makes that it holds before it hands them on, and of a stream that it unpacks at once.
PART_BYTES = 1 << 20


def in_parts(batch: pa.RecordBatch, made: Iterable[tuple[int, str | bytes]], kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(first column of the row, what was made of it) for each (row, what was made of it), a few at a time."""

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(values, kind)], names=names)

    rows: list[int] = []
    values: list[str | bytes] = []
    held = 0
    for row, value in made:
        rows.append(row)
        values.append(value)
        held += len(value)
        if held >= PART_BYTES:
            yield part()
            rows, values, held = [], [], 0
    if rows:
        yield part()


def inflate(data: memoryview) -> bytes:
    """What the gzip stream that begins here holds, up to the size limit of files; what is behind it is not copied."""
    import zlib

    stream, out, left = zlib.decompressobj(31), [], R.MAX_FILE_BYTES
    for at in range(0, len(data), PART_BYTES):
        out.append(stream.decompress(data[at : at + PART_BYTES], left))
        left -= len(out[-1])
        if stream.eof or left <= 0:
            break
    return b"".join(out)


def gzip_variants(df: DataFrame, keep: str, content: str) -> DataFrame:
    """Readable texts of gzip streams inside a binary column: (keep, variant).  Opt-in; text columns hold no gzip bytes.
    Of a stream no more than the size limit of files is unpacked.  A worker holds one row's bytes and few texts at once."""
    import zlib

    def unpack(data: bytes) -> Iterator[str]:
        at = data.find(b"\x1f\x8b")
        while at >= 0:
            try:
                text = inflate(memoryview(data)[at:]).decode("utf-8")
                if text and sum(c.isprintable() or c in "\n\r\t" for c in text) / len(text) > R.PRINTABLE_SHARE:
                    yield text
            except (zlib.error, UnicodeDecodeError):
                pass
            at = data.find(b"\x1f\x8b", at + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((row, text) for row, data in enumerate(batch.column(1)) for text in unpack(data.as_py() or b""))
            yield from in_parts(batch, texts, pa.string(), [keep, "variant"])

    return df.select(keep, content).mapInArrow(run, f"`{keep}` {df.schema[keep].dataType.simpleString()}, variant string")
