"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queue up, once for each repeat that its target may need; a
document's virtual finish time is its source's words up to and with it, divided by the source's target.  A document
longer than a packet, which is a ten-thousandth of its source's target, queues in packets, as fair queueing has it, so
that no document holds up the others.  All sources together are range-sorted by finish time, words are summed along that
line, and the line is truncated at the total budget, within a packet if need be: every source gets its target
but for about a packet.

Running sums have two parts, the sums of whole ranges (an aggregate) and a window inside one range, so no task
ever holds a source or the line: a range has about an even share of all rows.

Targets: see :func:`allocate`.  Sources are expected to be few enough for one row each on the driver, about 100
bytes (a million sources would be 100 MB).

Defined results: a null text has size 0 and takes 0; size-0 documents take nothing; null sources form one
source, last in order; repeated rows queue one after the other; empty tables give empty results; other columns
than ``doc_id``, ``text`` and ``source`` are ignored by :func:`mix` and carried along by :func:`keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import WORD_PATTERN, written

#: Production parameters.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2.0
#: Packets that a source's target is served in, at least.
PACKETS = 10_000


def allocate(sizes: list[float], weights: list[float], total: float, repeats: float) -> list[float]:
    """Targets by weight, none above ``repeats`` times its size; what is above is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, repeats * sum(sizes))
    while open_ and left > 1e-9:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= repeats * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = repeats * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def by_code_point(source: str | None) -> tuple[bool, list[int]]:
    return source is None, [ord(c) for c in source or ""]


def by_code_point(source: str | None) -> tuple[bool, list[int]]:
    return source is None, [ord(c) for c in source or ""]


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[dict]:
    """For each source, in order: source, source_size, target, packet (words), and how many hash ranges its rows fall into."""
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: by_code_point(r["source"]))
    sizes = [int(r["size"] or 0) for r in rows]
    targets = allocate(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), repeats)
    ranges = 2 * int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, sum(r["n"] for r in rows))
    return [
        {"source": r["source"], "source_size": s, "target": t, "packet": max(1, math.ceil(t / PACKETS)), "ranges": max(1, -(-ranges * r["n"] // every))} for r, s, t in zip(rows, sizes, targets, strict=True)
    ]


def spot(doc_id: F.Column, text: F.Column, seed: int) -> F.Column:
    """A document's place in its source's shuffled line: a hash of its id and text as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("long"), text), 11).cast("double") / F.lit(float(1 << 53))


def n_words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def queued(docs: DataFrame, targets: list[dict]) -> DataFrame:
    """doc_id, source, size, spot, source_size, target, packet, first: the words of its source before it, from ``docs``
    (doc_id, source, size, spot)."""
    own = docs.sparkSession.createDataFrame([tuple(t.values()) for t in targets], "s string, source_size long, target double, packet long, ranges long")
    rows = docs.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # one row for each source
    rows = rows.withColumn("range", F.floor(F.col("spot") * F.col("ranges")))
    of_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = of_range.withColumn("before", F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("inside", F.sum("size").over(inside))
    joined = running.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return joined.select("doc_id", "source", "size", "spot", "source_size", "target", "packet", (F.col("before") + F.col("inside") - F.col("size")).alias("first"))


def served(queue: DataFrame, targets: list[dict], repeats: float, budget: float | None) -> DataFrame:
    """What the line serves before the budget ends: doc_id, source, size, spot, first, lap, took (words), finish."""
    total = sum(t["target"] for t in targets)
    budget = total if budget is None else min(budget, total)
    # all queues are served at once, so the budget ends near this time; packets that begin well after it are not made
    late = (budget / total if total else 0.0) + 2 * max([0.0, *(t["packet"] / t["target"] for t in targets if t["target"])])
    laps = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(repeats) - 1)))
    lined = queue.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("lap", laps).withColumn("ahead", F.col("lap") * F.col("source_size") + F.col("first"))
    lined = lined.where(F.col("ahead") <= late * F.col("target")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("packet")))))
    lined = lined.withColumn("offset", F.col("part") * F.col("packet")).where(F.col("ahead") + F.col("offset") <= late * F.col("target"))
    words = F.least(F.col("packet"), F.col("size") - F.col("offset"))
    order = ("finish", "source", "lap", "first", "offset")
    lined = lined.select("doc_id", "source", "size", "spot", "first", "lap", "offset", words.alias("words"), ((F.col("ahead") + F.col("offset") + words) / F.col("target")).alias("finish"))
    lined = written(lined.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "line")

    sums, ahead = [], 0
    for r in sorted(lined.groupBy("range").agg(F.sum("words").alias("words")).collect(), key=lambda r: r["range"]):
        sums.append((r["range"], ahead))
        ahead += r["words"]
    before = queue.sparkSession.createDataFrame(sums, "range int, before long")  # one row for each partition of the line
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lined.withColumn("inside", F.sum("words").over(inside)).join(F.broadcast(before), "range")
    rest = F.lit(math.floor(budget + 1e-6)).cast("long") - (F.col("before") + F.col("inside") - F.col("words"))
    return running.withColumn("took", F.least(F.col("words"), rest)).where("took > 0").select("doc_id", "source", "size", "spot", "first", "lap", "took", "finish")


def _line(docs: DataFrame, weights: tuple[float, ...], share: float, repeats: float, seed: int, budget: float | None) -> tuple[DataFrame, DataFrame]:
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), spot(F.col("doc_id"), F.col("text"), seed).alias("spot")), "sized")
    targets = source_targets(sized, weights, share, repeats)
    queue = written(queued(sized, targets), "queue")
    return queue, served(queue, targets, repeats, budget)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: int = 4, budget: float | None = None) -> DataFrame:
    """For each document: doc_id, size, source_size, target, taken (words), times (how often it is taken in whole or
    in part), finish (the virtual time at which the mix first has all that it takes of it in one lap; null where it takes nothing).

    The total budget is the sum of the targets unless a smaller one is given.
    """
    queue, line = _line(docs, weights, share, repeats, seed, budget)
    # a document is known by its place in its source's line; what is empty has none and takes nothing
    laps = line.groupBy("source", "first", "lap").agg(F.sum("took").alias("took"), F.max("finish").alias("finish"))
    takes = laps.groupBy(F.col("source").alias("s"), F.col("first").alias("f")).agg(F.sum("took").alias("took"), F.count("*").alias("n"), F.min("finish").alias("finish"))
    some = queue.where("size > 0").join(takes, F.col("source").eqNullSafe(F.col("s")) & (F.col("first") == F.col("f")), "left")
    zero = F.lit(0).cast("long")
    out = some.select("doc_id", "size", "source_size", "target", F.coalesce("took", zero).alias("taken"), F.coalesce("n", zero).cast("int").alias("times"), "finish")
    return out.unionAll(queue.where("size = 0").select("doc_id", "size", "source_size", "target", zero.alias("taken"), F.lit(0).alias("times"), F.lit(None).cast("double").alias("finish")))


def beginning(text: F.Column, words: F.Column) -> F.Column:
    """The text up to the end of a word, counted from 1."""
    pairs = F.arrays_zip(F.split(text, WORD_PATTERN, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)).alias("word"))
    return F.array_join(F.transform(F.slice(pairs, F.lit(1), words), lambda p: F.concat(p["gap"], p["word"])), "")


def keep(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: int = 4, budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that the mix takes, each as often as it takes it.

    A source's documents are taken in line, so in each lap one of them, or one group of equal ones, is the last; only
    those are moved.  A document that is taken in part is cut after the last word that is taken, and its ``n_chars``,
    if there is such a number, with it.  A row travels as one struct, so its columns' names clash with nothing.
    """
    queue, line = _line(docs, weights, share, repeats, seed, budget)
    of_spot = line.groupBy("source", "lap", "spot").agg(F.sum("took").alias("took"))
    last = of_spot.groupBy("source", "lap").agg(F.max(F.struct("spot", "took")).alias("last")).select(F.col("source").alias("s"), F.struct("lap", "last.spot", "last.took").alias("lap"))
    lasts = written(last.groupBy("s").agg(F.array_sort(F.collect_list("lap")).alias("laps")), "ends")
    place = spot(docs["doc_id"], docs["text"], seed)
    rows = docs.where(docs["text"].rlike(WORD_PATTERN)).select(docs["source"].cast("string").alias("source"), place.alias("spot"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = rows.join(F.broadcast(lasts), F.col("source").eqNullSafe(F.col("s"))).withColumn("lap", F.explode(F.filter("laps", lambda e: F.col("spot") <= e["spot"])))  # one row for each source
    whole, ends = rows.where("spot < lap.spot"), rows.where("spot = lap.spot")
    size = n_words(F.col("row.text"))
    inside = Window.partitionBy("source", "lap.lap", "spot").orderBy("row.doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("size", size).withColumn("took", F.least(F.col("size"), F.col("lap.took") - F.sum("size").over(inside) + F.col("size"))).where("took > 0")
    text = F.when(F.col("took") < F.col("size"), beginning(F.col("row.text"), F.col("took").cast("int"))).otherwise(F.col("row.text"))
    numbers = {f.name for f in docs.schema.fields if f.dataType.typeName() in ("long", "integer")}

    def column(name: str) -> F.Column:
        own = F.col("row")[name]
        if name == "text":
            return text.alias(name)
        if name == "n_chars" and name in numbers:
            return F.when(F.col("took") < F.col("size"), F.length(text)).otherwise(own).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return whole.select("row.*").unionAll(ends.select(*map(column, docs.columns)))
