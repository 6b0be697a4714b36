"""Near-duplicate detection by Order MinHash (Marçais, DeBlasio, Pandey, Kingsford 2019).

K-mers are runs of five words, labelled with their occurrence number, so that each is unique in its text.  For
each of ``TABLES`` hash functions a text's sketch is its ``ELL`` k-mers of least hash *in text order*; texts whose
sketches agree in a table are candidates.  Unlike plain MinHash the order makes the sketch follow edit
similarity: a text with its passages shuffled does not collide.  Candidates are verified over their whole texts
by banded alignment of their words: common k-mers off the diagonal by no more than the band that the threshold allows
are chained, the longest increasing chain stands, and words between its members are aligned by their longest common
subsequence.  The similarity is aligned / (n_a + n_b - aligned) words, 0.8 or more making a link; texts that have
no run of five words in common (shorter ones: the whole text) are not similar.

Equal word sequences form one class first (aggregates only), so thousands of copies cost as much as one.  Then, in
rounds, each bucket whose members are in several components elects a hub, the member of its largest component that
meets most others over all tables; members of other components are aligned with it, links are merged, and the hub, which
has met all, leaves the bucket.  A round moves each text once a hub, however large the bucket.  When rounds no
longer settle many members, those left outside their bucket's largest component are held against all members of other
components of about their length, block by block, so that no task holds more than two blocks: a bound from hashed
word counts (two texts have at least as many words that are not aligned as their counts differ by) leaves those few
that can pass, and these are aligned too: of one bucket the nearest by that bound first, as one link settles a member,
then more, and in the end, for members still outside, all.

Defined results: a null text is alone in its class; a row without a doc_id has the class of its equals, if any;
texts without a word are copies of each other; texts of fewer than five words have one k-mer, the whole text;
repeated rows are copies; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import WORDS, components, mark_members, written

K = 5
ELL = 3
TABLES = 24
SIMILARITY = 0.8
#: Members of a hub that one run of rows holds; its text is sent once for each run.
RUN = 512
#: Rounds go on as long as each leaves at most this share of the open members.
PROGRESS = 0.7
#: Words are counted in so many cells for the bound; blocks of members outside and of all members that meet at once.
CELLS, COARSE = 256, 32
#: The share of two texts' words that may be left unaligned.
MOST_APART = (1 - SIMILARITY) / (1 + SIMILARITY)
OUTSIDE_BLOCK, MEMBER_BLOCK = 128, 512
#: Partners in each block that a member still outside is aligned with, round by round; the last has no limit.
NEAREST_FIRST = (4, None)
#: Lengths within one class differ by less than this factor, which is above 1 / SIMILARITY.
LENGTH_CLASS = 1.26
#: Rows of texts that a worker is sent at once, and words that it sketches at once.
TEXT_ROWS, WORDS_AT_ONCE = 256, 1 << 17

_MIX1, _MIX2, _MIX3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S1, _S2 = np.uint64(30), np.uint64(27)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _MIX2
    x = (x ^ (x >> _S2)) * _MIX3
    return x ^ (x >> np.uint64(31))


#: Odd factors: k-mers are mixed already, and a product's order depends on all their bits.
_FACTORS = _mix(np.arange(1, 129, dtype=np.uint64) * _MIX1) | np.uint64(1)


class Hasher:
    """64-bit hashes of words, kept within a bound."""

    MAX_WORDS = 120_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.MAX_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def kmers(hashes: np.ndarray, lengths: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of several texts, each in text order, and how many each text has.

    ``hashes`` has the texts' words one after the other, ``lengths`` (each at least 1) their numbers.
    """
    counts = np.maximum(1, lengths - k + 1)
    firsts = np.cumsum(lengths) - lengths
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(counts.sum()) - starts[text] + firsts[text]
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), dtype=np.uint64)
        width = np.minimum(lengths, k)[text] if (lengths < k).any() else None
        for j in range(k):
            if width is None:
                out = _mix(out * _MIX1 + hashes[at + j])
            else:
                inside = width > j
                out[inside] = _mix(out[inside] * _MIX1 + hashes[at[inside] + j])
        of_text = out ^ _mix(text.astype(np.uint64) * _MIX1)
        order = np.argsort(of_text, kind="stable")
        held = of_text[order]
        same = held[1:] == held[:-1]
        if same.any():
            heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
            labels = np.empty(len(out), dtype=np.uint64)
            labels[order] = (np.arange(len(out)) - np.repeat(heads, np.diff(np.append(heads, len(out))))).astype(np.uint64)
            out = np.where(labels > 0, _mix(out + labels * _MIX1), out)
    return out, counts


def sketch(labelled: np.ndarray, counts: np.ndarray, ell: int = ELL, tables: int = TABLES) -> np.ndarray:
    """One bucket key for each text and table."""
    keys = np.empty((len(counts), tables), dtype=np.uint64)
    starts = np.cumsum(counts) - counts
    some = np.flatnonzero(counts >= ell)
    few = np.flatnonzero(counts < ell)
    sizes = counts[some]
    held = labelled[np.repeat(counts >= ell, counts)] if len(few) else labelled
    text = np.repeat(np.arange(len(some)), sizes)
    heads = np.cumsum(sizes) - sizes
    # the least are looked for among hashes below a bound that hardly any text has too few of
    share = np.minimum(1.0, (4 * ell + 8) / np.maximum(sizes, 1))
    bound = np.repeat(np.where(share < 1, (share * 2.0**63).astype(np.uint64) * np.uint64(2), _NEVER), sizes)
    with np.errstate(over="ignore"):
        for t in range(tables):
            if len(some):
                hashed = held * _FACTORS[t]
                low = np.flatnonzero(hashed <= bound)
                order = low[np.lexsort((hashed[low], text[low]))]
                own = np.bincount(text[low], minlength=len(some))
                first = np.cumsum(own) - own
                least = order[np.minimum(first[:, None] + np.arange(ell), len(order) - 1)]
                for i in np.flatnonzero(own < ell):
                    least[i] = heads[i] + np.argsort(hashed[heads[i] : heads[i] + sizes[i]], kind="stable")[:ell]
                key = np.full(len(some), _FACTORS[t])
                for at in np.sort(least, axis=1).T:  # in text order
                    key = _mix(key * _MIX1 + held[at])
                keys[some, t] = key
            for i in few:
                key = _FACTORS[t]
                for g in labelled[starts[i] : starts[i] + counts[i]]:
                    key = _mix(key * _MIX1 + g)
                keys[i, t] = key
    return keys


def cells(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, counts of words by hash, up to 255.  Their absolute differences, summed, are at most the number
    of words of either text that an alignment leaves."""
    at = np.repeat(np.arange(len(lengths)), lengths) * CELLS + (hashes % np.uint64(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(lengths) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the word sequence (of its own for each null text), keys: a bucket key for each table (none
    without words), n: the number of words, cells: their counts by hash."""
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary())

    def table(ids: list, digests: list, lengths: list, hashes: list) -> pa.RecordBatch:
        n = np.array(lengths, dtype=np.int64)
        some = np.flatnonzero(n > 0)
        keys: list = [[]] * len(ids)
        counted = [b""] * len(ids)
        if len(some):
            words = np.concatenate(hashes)
            found = sketch(*kmers(words, n[some])).view(np.int64)
            for i, own, c in zip(some.tolist(), found, cells(words, n[some]), strict=True):
                keys[i], counted[i] = own, c.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, digests, keys, lengths, counted), kinds, strict=True)], names=["doc_id", "digest", "keys", "n", "cells"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: tuple[list, list, list, list] = ([], [], [], [])
        room = WORDS_AT_ONCE
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                words = WORDS.findall(text) if text is not None else []
                digest = f"null {doc}".encode() if text is None else xxhash.xxh3_128_digest("\n".join(words).encode("utf-8", "surrogatepass"))
                for column, value in zip(held, (doc, digest, len(words)), strict=False):
                    column.append(value)
                if words:
                    held[3].append(hasher.words(words))
                room -= len(words)
                if room <= 0:
                    yield table(*held)
                    held, room = ([], [], [], []), WORDS_AT_ONCE
        if held[0]:
            yield table(*held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest binary, keys array<long>, n long, cells binary")


def labelled_kmers(words: list[str], k: int = K) -> list[tuple]:
    """The k-mers as tuples of words with their occurrence number."""
    if not words:
        return []
    grams = list(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [tuple(words)]
    if len(set(grams)) == len(grams):
        return [(g, 0) for g in grams]
    seen: dict[tuple, int] = {}
    out = []
    for g in grams:
        seen[g] = n = seen.get(g, -1) + 1
        out.append((g, n))
    return out


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits (Hyyrö 2004)."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if (at := where.get(w)) is not None:
            met = row & at
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


class Side:
    """One text of many comparisons: its words, and where its k-mers stand."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.place = {g: i for i, g in enumerate(labelled_kmers(words))}

    def alignment(self, other: list[str], least: float = SIMILARITY) -> float:
        """Similarity by banded alignment; 0.0 where it does not reach ``least``."""
        a, b = self.words, other
        total = len(a) + len(b)
        need = least / (1 + least) * total - 1e-9  # aligned words that the threshold asks for
        if not a or not b or min(len(a), len(b)) < need:
            return 0.0
        band = total - 2 * need  # more insertions and deletions than this do not pass
        place = self.place
        met = [(i, j) for j, g in enumerate(labelled_kmers(b)) if (i := place.get(g, -1)) >= 0 and abs(i - j) <= band]
        if not met:
            return 0.0
        runs, gaps = chained(met, min(K, len(a), len(b)), len(a), len(b))
        # what can still be aligned, from lengths first, then from common words, then for certain
        bounds = [min(x1 - x0, y1 - y0) for x0, x1, y0, y1 in gaps]
        possible = runs + sum(bounds)
        for n, (x0, x1, y0, y1) in enumerate(gaps):
            if possible < need:
                return 0.0
            if bounds[n] > 8:
                common = (Counter(a[x0:x1]) & Counter(b[y0:y1])).total()
                possible -= bounds[n] - common
                bounds[n] = common
        for bound, (x0, x1, y0, y1) in zip(bounds, gaps, strict=True):
            if possible < need:
                return 0.0
            if bound:
                possible -= bound - common_words(a[x0:x1], b[y0:y1])
        return possible / (total - possible) if possible >= need else 0.0


def chained(met: list[tuple[int, int]], width: int, n_a: int, n_b: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Words covered by the longest increasing chain of common k-mers, and the gaps (from, to in a, from, to in b) beside it."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(met)
    for n, (i, _) in enumerate(met):
        at = bisect_left(tails, i)
        if at == len(tails):
            tails.append(i)
            ends.append(n)
        else:
            tails[at], ends[at] = i, n
        before[n] = ends[at - 1] if at else -1
    chain = []
    n = ends[-1]
    while n >= 0:
        chain.append(met[n])
        n = before[n]
    x = y = covered = 0
    gaps = []
    for i, j in reversed(chain):
        late = max(0, x - i, y - j)
        if late < width:
            if i + late > x and j + late > y:
                gaps.append((x, i + late, y, j + late))
            covered += width - late
            x, y = i + width, j + width
    if x < n_a and y < n_b:
        gaps.append((x, n_a, y, n_b))
    return covered, gaps


def alignment(a: str, b: str, least: float = SIMILARITY) -> float:
    """Similarity of two texts; 0.0 where it does not reach ``least``."""
    return Side(WORDS.findall(a)).alignment(WORDS.findall(b), least)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (hub, id, size: of about how many for the hub) with whether their whole texts (of ``texts``: id, text)
    are similar.

    Rows come in runs of one hub and up to about RUN members; each run begins with the hub's text, so a worker holds
    one text of either side.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Side([])
        for batch in batches:
            hubs, ids, similar = [], [], []
            for hub, member, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = WORDS.findall(text.as_py())
                if member is None:
                    side = Side(words)
                else:
                    hubs.append(hub)
                    ids.append(member)
                    similar.append(side.alignment(words) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(ids, pa.int64()), pa.array(similar, pa.bool_())], names=["hub", "id", "similar"])

    each = pairs.groupBy("hub", "id").agg(F.max("size").alias("size"))
    runs = written(each.select("hub", "id", F.pmod(F.xxhash64(F.lit("run"), "id"), F.ceil(F.col("size") / RUN)).cast("int").alias("run")), "runs")
    heads = runs.select("hub", "run").distinct()
    ids = runs.select("id").unionAll(heads.select("hub")).distinct()
    own = mark_members(texts, "id", ids, "in_pairs").where("in_pairs").drop("in_pairs")
    members = runs.join(own, "id").select("hub", "id", "text", "run")
    first = heads.join(own, heads["hub"] == own["id"]).select("hub", F.lit(None).cast("long").alias("id"), "text", "run")
    rows = first.unionAll(members).repartition("hub", "run").sortWithinPartitions("hub", "run", F.asc_nulls_first("id"))
    return written(rows.select("hub", "id", "text").mapInArrow(run, "hub long, id long, similar boolean"), "tested", TEXT_ROWS)


def may_pass(n_a, n_b):
    """Whether the numbers of words allow the threshold."""
    return F.least(n_a, n_b) >= SIMILARITY * F.greatest(n_a, n_b)


def still_open(held: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members (key, id, n, met, root, main, size) of buckets that hold several components; main is the largest of these."""
    rows = held.withColumn("root", F.col("id")) if roots is None else held.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = rows.groupBy("key", "root").agg(F.count("*").alias("k"), F.max("met").alias("top"))
    main = groups.groupBy("key").agg(F.max(F.struct("k", "top", (-F.col("root")).alias("minus_root"))).alias("best"), F.count("*").alias("groups"), F.sum("k").alias("size")).where("groups > 1")
    return written(rows.join(main.select("key", (-F.col("best.minus_root")).alias("main"), "size"), "key").select("key", "id", "n", "met", "root", "main", "size"), "open")


def elected(members: DataFrame) -> DataFrame:
    """key, hub, hub_n: of each bucket's main component the member that meets most others."""
    best = F.max(F.when(F.col("root") == F.col("main"), F.struct("met", (-F.col("id")).alias("minus_id"), "n"))).alias("best")
    return members.groupBy("key").agg(best, F.max("main").alias("hub_root")).select("key", (-F.col("best.minus_id")).alias("hub"), F.col("best.n").alias("hub_n"), "hub_root")


def outside_pairs(members: DataFrame, counted: DataFrame, nearest: int | None = None) -> DataFrame:
    """Pairs (hub, id) over components that the counts' bound leaves, from open buckets (see :func:`still_open`).

    A bucket's members outside its main component meet all its members of about their length in blocks; each task
    holds two.  With ``nearest`` each does so in the one bucket where most others are, and of each block only so
    many partners are taken, those that the bound puts nearest.
    """
    rows = members.join(counted, "id").withColumn("length", F.floor(F.log("n") / F.log(F.lit(LENGTH_CLASS))).cast("int"))
    rows = written(rows.select("key", "id", "root", "main", "size", "n", "cells", "length"), "outside")
    near = F.explode(F.array(*(F.col("length") + d for d in (-1, 0, 1))))  # lengths that can pass are at most one class apart
    outside = rows.where("root <> main")
    if nearest:
        best = outside.groupBy("id").agg(F.max(F.struct("size", "key")).alias("best"))
        best = written(best.select("id", F.col("best.key").alias("key")), "best")
        outside = outside.join(best, ["id", "key"]).select(rows.columns)
        rows = rows.join(best.select("key").distinct(), "key", "left_semi")
    outside = written(outside.withColumn("length", near), "outside")
    n_out = outside.groupBy("key", "length").agg(F.ceil(F.count("*") / OUTSIDE_BLOCK).cast("int").alias("n_out"))
    n_all = rows.groupBy("key", "length").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("n_all"))
    blocks = n_out.join(n_all, ["key", "length"])
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["key", "length", "id", "root", "main", "n", "cells"]
    left = outside.join(blocks, ["key", "length"]).select(*columns, own("out", F.col("n_out")).alias("o"), every(F.col("n_all")).alias("m"))
    right = rows.join(blocks, ["key", "length"]).select(*columns, own("all", F.col("n_all")).alias("m"), every(F.col("n_out")).alias("o"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        y.columns = [c.removesuffix("_") for c in y.columns]
        if len(x) and len(y):
            ids, roots, n = (y[c].to_numpy() for c in ("id", "root", "n"))
            counts = np.frombuffer(b"".join(y["cells"]), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16)
            in_main = roots == y["main"].to_numpy()
            coarse = counts.reshape(len(ids), -1, CELLS // COARSE).sum(axis=2, dtype=np.int32)  # sums of cells bound as well, for less
            for i, root, m, c in zip(x["id"], x["root"], x["n"], x["cells"], strict=True):
                near = np.flatnonzero((roots != root) & (in_main | (ids > i)) & (np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)))
                cell = np.frombuffer(c, dtype=np.uint8).astype(np.int16)
                apart = np.abs(coarse[near] - cell.reshape(-1, CELLS // COARSE).sum(axis=1, dtype=np.int32)).sum(axis=1)
                near = near[apart <= MOST_APART * (n[near] + m) + 1e-9]
                share = np.abs(counts[near] - cell).sum(axis=1, dtype=np.int64) / (n[near] + m)
                able = np.flatnonzero(share <= MOST_APART + 1e-12)
                if nearest and len(able) > nearest:
                    able = able[np.lexsort((ids[near[able]], share[able]))[:nearest]]
                found += ((i, j) for j in ids[near[able]].tolist())
        return pd.DataFrame(found, columns=["hub", "id"], dtype="int64")

    keys = ["key", "length", "o", "m"]
    right = right.select(*(F.col(c).alias(f"{c}_") for c in right.columns))
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"{c}_" for c in keys))).applyInPandas(meet, "hub long, id long").select("hub", "id", F.lit(nearest or RUN).alias("size"))


def near_classes(docs: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, class_id, the least doc_id of the class) and links (a, b) that span them, between the least
    doc_ids of different texts."""
    texts = (docs if texts is None else texts).select(F.col("doc_id").cast("long").alias("id"), "text")
    base = written(sketches(docs), "sketches", TEXT_ROWS)
    facts = base.groupBy("digest").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("keys", "n", "cells")))
    distinct = written(facts, "distinct")

    entries = distinct.where((F.size("keys") > 0) & F.col("id").isNotNull()).select("id", "n", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(entries.join(sizes, "key"), "buckets")
    met = buckets.groupBy("id").agg(F.sum("size").alias("met"))
    held = written(buckets.join(met, "id").select("key", "id", "n", "met"), "held")
    # all texts that any round compares, each once however many documents have it
    members = written(held.select("id").distinct(), "ids")
    wanted = mark_members(texts, "id", members, "held").where("held").drop("held").join(members, "id", "left_semi")
    wanted = written(wanted.dropDuplicates(["id"]), "texts")

    links = None
    roots, left = None, None
    while True:
        members = still_open(held, roots)
        now = members.where("root <> main").count()
        if not now or (left is not None and now > PROGRESS * left):
            break
        left = now
        met_hub = written(members.join(elected(members), "key").where("id <> hub"), "hubs")
        pairs = met_hub.where((F.col("root") != F.col("hub_root")) & may_pass(F.col("n"), F.col("hub_n"))).select("hub", "id", "size")
        links = _with(links, linked(pairs, wanted).where("similar"))
        roots = components(links)
        held = met_hub.select("key", "id", "n", "met")
    tested = None
    for nearest in NEAREST_FIRST if now else ():
        pairs = outside_pairs(members, distinct.select("id", "cells"), nearest)
        new = linked(pairs if tested is None else pairs.join(tested, ["hub", "id"], "left_anti"), wanted)
        tested = new.select("hub", "id") if tested is None else tested.unionAll(new.select("hub", "id"))
        more = new.where("similar")
        if not more.isEmpty():
            links = _with(links, more)
            roots = components(links)
            members = still_open(held, roots)
            if members.isEmpty():
                break

    named = distinct.select("digest", "id")
    named = named.withColumn("class_id", F.col("id")) if roots is None else named.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("class_id"))
    classes = base.select("doc_id", "digest").join(written(named.select("digest", "class_id"), "classes"), "digest").select("doc_id", "class_id")
    return classes, links if links is not None else base.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false")


def _with(links: DataFrame | None, more: DataFrame) -> DataFrame:
    more = more.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))
    return more if links is None else links.unionAll(more)


def keep(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (all columns) for each class: that with the least doc_id, one of its repetitions.

    Rows without a doc_id stay.  Where texts share a doc_id, each is judged for itself, under a number of its own.
    Rows that are not in question are not moved; the others meet the list of what goes.  A row travels as one struct,
    so its columns' names clash with nothing.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    key = F.coalesce(F.md5(rows["text"].cast("binary")), F.lit("null"))
    ids = written(rows.where("doc_id is not null").select("doc_id", key.alias("key")).distinct(), "ids")
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _kept(rows).select("row.*")
    # numbers in the order of the ids
    ids = written(ids.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("number", F.monotonically_increasing_id()), "ids")
    numbered = rows.withColumn("key", key).join(ids, ["doc_id", "key"], "left").select(F.col("number").alias("doc_id"), "text", "row")
    return _kept(written(numbered, "numbered")).select("row.*")


def _kept(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, row) that stay where a doc_id has one text."""
    classes = written(near_classes(rows)[0].where("doc_id is not null"), "classes")
    dropped = written(classes.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    marked = mark_members(rows, "doc_id", dropped, "in_question")
    rows = marked.where("not in_question").unionAll(marked.where("in_question").join(dropped, "doc_id", "left_anti").select(marked.columns))
    again = written(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "again")
    if again.isEmpty():
        return rows
    marked = mark_members(rows.drop("in_question"), "doc_id", again.select("doc_id"), "in_question")
    return marked.where("not in_question").unionAll(marked.where("in_question and doc_id is not null").dropDuplicates(["doc_id"]).unionAll(marked.where("in_question and doc_id is null")))
