"""URL filters over memory-mapped sorted arrays of 64-bit digests.

The entries of a list (host, or host and path prefix) are hashed with 64-bit xxhash, range-sorted by digest, and each
range is written by its own task as one file: the sorted keys, then for each key the offset of its full string, then
the strings.  The files lie in the shared folder and go from there to every executor as Spark files, where they are
memory-mapped: workers of one executor share their pages, and nothing is unpickled per task, so a list of many million
entries costs its files' size once on each executor's disk, about 40 bytes an entry.  A batch of urls is
probed with a vectorised binary search, and each hit is confirmed against the stored string.

An entry fits its host and all subdomains, where the url's path starts with the entry's path.  For a url, every
suffix of its host at a dot is probed first, which says what path lengths the list has below that host; then the
host with each such part of the path is.  The longest entry wins, of equally long ones that with the longer
host.

Defined results: a url that is null or has no ``://`` has an empty host and path and fits nothing; urls without a
fitting entry get the default verdict; of entries with the same host and path the first in a Python list holds, in a table
that with the least verdict; null entries are left out; repeated rows are judged one by one; an empty table gives an empty result;
columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import scratch, written

#: The production rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts that are blocked where no rule fits, a sample list for the synthetic pages; any other url is allowed.  A
#: real list is given as a table, see :func:`read_hosts`.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win") for top in ("com", "net", "org"))
#: Entries that one file of an index holds, about.
FILE_ENTRIES = 2_000_000
_URL = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_MAGIC = b"VSURL002"
#: Within a file, what an entry's string begins with: a host's list of path lengths, or an entry with its value.
_LENGTHS, _ENTRY = "L", "E"
#: Spark's own seed of xxhash64, so that keys are made inside the JVM and found again here.
_SEED = 42


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _URL.match(rest).group()
    return host.translate(_LOWER), _PATH.match(rest, len(host)).group()


def key(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest((kind + text).encode("utf-8", "surrogatepass"), _SEED)


def file_bytes(keys: np.ndarray, strings: list[bytes]) -> Iterator[bytes]:
    """An index file from sorted keys (as signed numbers) and their strings, each with its value after a zero byte."""
    yield _MAGIC + np.array([len(keys)], "<i8").tobytes()
    yield keys.astype("<i8").tobytes()
    yield np.cumsum([0, *map(len, strings)]).astype("<i8").tobytes()
    for at in range(0, len(strings), 1 << 16):
        yield b"".join(strings[at : at + (1 << 16)])


class IndexFile:
    """One file, memory-mapped."""

    def __init__(self, path: str) -> None:
        head = np.memmap(path, dtype="<i8", mode="r", shape=(2,))
        if head[:1].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no digest index")
        n = int(head[1])
        self.keys = np.memmap(path, dtype="<i8", mode="r", offset=16, shape=(n,)) if n else np.empty(0, "<i8")
        self.offsets = np.memmap(path, dtype="<i8", mode="r", offset=16 + 8 * n, shape=(n + 1,))
        at = 16 + 8 * n + 8 * (n + 1)
        self.strings = np.memmap(path, dtype=np.uint8, mode="r", offset=at) if os.path.getsize(path) > at else np.empty(0, np.uint8)

    def value(self, spot: int, wanted: int, text: str) -> str | None:
        """The value of ``text`` among the entries from ``spot`` on whose digest is the one wanted."""
        while spot < len(self.keys) and self.keys[spot] == wanted:  # equal digests lie side by side
            stored, _, value = self.strings[int(self.offsets[spot]) : int(self.offsets[spot + 1])].tobytes().decode("utf-8", "surrogatepass").partition("\0")
            if stored == text:
                return value
            spot += 1
        return None


class DigestIndex:
    """The files of a list, each with a range of digests."""

    def __init__(self, paths: list[str]) -> None:
        self.files = sorted((f for f in map(IndexFile, paths) if len(f.keys)), key=lambda f: int(f.keys[0]))
        self.last = np.array([f.keys[-1] for f in self.files], dtype="<i8")

    def probe(self, kind: str, texts: list[str]) -> list[str | None]:
        """The value stored for each text, or None: binary searches for all at once, then the stored strings confirm."""
        out: list[str | None] = [None] * len(texts)
        if not texts or not self.files:
            return out
        wanted = np.fromiter((key(kind, t) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
        of_file = np.searchsorted(self.last, wanted)
        for n in np.unique(of_file[of_file < len(self.files)]):
            file, own = self.files[n], np.flatnonzero(of_file == n)
            spots = np.searchsorted(file.keys, wanted[own])
            for i, spot in zip(own[(hit := file.keys[spots] == wanted[own])], spots[hit], strict=True):
                out[i] = file.value(int(spot), int(wanted[i]), kind + texts[i])
        return out

    def longest(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each (host, path) the longest entry that fits, with its value."""
        hosts = list({h for h, _ in urls if h})
        suffixes = {h: [h] + [h[i + 1 :] for i, c in enumerate(h) if c == "."] for h in hosts}
        unique = list({s for each in suffixes.values() for s in each})
        known = {s: [int(n) for n in v.split(",")] for s, v in zip(unique, self.probe(_LENGTHS, unique), strict=True) if v is not None}
        tries: list[tuple[int, str]] = []
        for i, (host, path) in enumerate(urls):
            for s in suffixes.get(host, ()):
                tries += ((i, s + path[:n]) for n in known.get(s, ()) if len(path) >= n)
        out: list[tuple[str, str] | None] = [None] * len(urls)
        for (i, text), value in zip(tries, self.probe(_ENTRY, [t for _, t in tries]), strict=True):
            if value is not None and (out[i] is None or len(text) > len(out[i][0])):
                out[i] = text, value
        return out


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """A list of blocked hosts, or hosts and paths, from text files with one a line; empty lines and those after # are no entries."""
    return spark.read.text(path).select(F.lit("block").alias("value"), F.trim("value").alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))


def _frame(spark: SparkSession, entries: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
    """(value, text), each text once."""
    if not isinstance(entries, DataFrame):
        first: dict[str, str] = {}
        for value, text in entries:
            first.setdefault(text, value)
        entries = spark.createDataFrame([(v, t) for t, v in first.items()], "value string, text string")
    return entries.where("text is not null and value is not null").groupBy("text").agg(F.min("value").alias("value"))


def publish(spark: SparkSession, name: str, entries: DataFrame | Iterable[tuple[str, str]]) -> list[str]:
    """Write the index of (value, host and path) entries to the shared folder, a file for each range of digests, and
    hand the files to all executors; the names that they have there."""
    folder = scratch(spark, f"urls-{name}")
    rows = _frame(spark, entries)
    slash = F.locate("/", F.col("text"))
    host = F.when(slash > 0, F.left("text", slash - 1)).otherwise(F.col("text"))
    lengths = rows.groupBy(host.alias("host")).agg(F.array_join(F.sort_array(F.collect_set(F.length("text") - F.length(host))).cast("array<string>"), ",").alias("value"))
    stored = rows.select(F.concat(F.lit(_ENTRY), "text").alias("text"), "value").unionAll(lengths.select(F.concat(F.lit(_LENGTHS), "host").alias("text"), "value"))
    stored = written(stored.select(F.xxhash64("text").alias("key"), F.concat("text", F.lit("\0"), "value").alias("stored")), f"entries-{name}")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, strings = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            strings += [s.encode("utf-8", "surrogatepass") for s in batch.column(1).to_pylist()]
        if strings:
            task = TaskContext.get()
            store, root = pyarrow.fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            path = f"{root}/{name}-{os.path.basename(root)}-{task.partitionId()}-{task.taskAttemptId()}.idx"  # an attempt of its own, as two may run at once
            with store.open_output_stream(path, compression=None) as out:
                for part in file_bytes(np.concatenate(keys), strings):
                    out.write(part)
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)], pa.string())], names=["file"])

    ranges = max(1, -(-stored.count() // FILE_ENTRIES))
    files = written(stored.repartitionByRange(ranges, "key").sortWithinPartitions("key", "stored").mapInArrow(write, "file string"), f"files-{name}")
    names = sorted(r["file"] for r in files.collect())  # one row for each file
    for file in names:
        spark.sparkContext.addFile(f"{folder}/{file}")
    return names


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str]] = RULES, blocked: DataFrame | Iterable[str] = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule (of ``rules``, else null), verdict, and listed: the blocked host that decided, if one did.

    Lists are Python lists or tables (value, text).
    """
    spark = pages.sparkSession
    rule_files = publish(spark, "rules", rules)
    host_files = publish(spark, "hosts", blocked if isinstance(blocked, DataFrame) else [("block", h) for h in blocked])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_host = (DigestIndex([SparkFiles.get(f) for f in files]) for files in (rule_files, host_files))
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            rows = by_rule.longest(urls)
            hosts = by_host.longest([("", "") if r else u for r, u in zip(rows, urls, strict=True)])
            verdicts = [r[1] if r else h[1] if h else "allow" for r, h in zip(rows, hosts, strict=True)]
            columns = ([h for h, _ in urls], [p for _, p in urls], [r and r[0] for r in rows], verdicts, [h and h[0] for h in hosts])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict", "listed"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, listed string")
