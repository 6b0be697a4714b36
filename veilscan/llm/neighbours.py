"""Approximate nearest neighbours in low-dimensional stable projections indexed by a kd-tree (SRS, Sun et al. 2014).

Vectors are projected on a few Gaussian directions (2-stable: a projected squared distance, over the true one, is
chi-square with as many degrees of freedom).  A kd-tree over the projections, split at medians of a sample, has every
vector in one leaf, a cell; a cell's box is that of all its vectors.  A query goes to its few nearest cells first,
which gives it a distance to beat, and then only to cells whose box passes the chi-square test: those in which a
nearer vector would not have a projected distance that a chi-square variable exceeds with a small probability only.
Within a cell it takes projected neighbours in order of projected distance, verifies them on the original vectors,
and stops by the same test.  The largest inner product is a nearest distance after one more dimension brings all
vectors to the same length (Bachrach et al. 2014).

Vectors are moved once for each of the two passes and never copied; a cell of very many rows is cut into blocks by hash, and
queries stream past a block, so a task holds one block and one batch of queries.  Equal vectors of a block are
verified once, with their least ids, so a vector that a third of the rows share costs as much as one.

Defined results: vectors that are null, all zeros, or hold a null or non-finite component take no part, nor do
those whose length is not the most frequent one (the least of these on a tie), as they have no inner product with the others; of a
query id that several vectors share the least vector is the query; rows with the query's own id are never its
neighbours; repeated rows are candidates by their ids, each for itself; a table without a valid vector gives an empty result;
ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import written

NEAREST = 20
DIMENSIONS = 16
#: Probability, under chi-square, with which a nearer vector is still unseen when a query stops.
MISS = 0.1
#: About so many projected vectors are a sample for the tree's splits, which are all that is learned from it.
SAMPLE = 65_536
#: A cell has about CELL rows as long as there are at most MOST_CELLS; a block of a cell, about BLOCK.
CELL, MOST_CELLS, BLOCK = 2_048, 8_192, 32_768
#: Cells that a query goes to first.
FIRST = 4
#: Queries whose projected distances to a block are computed at once.
QUERIES_AT_ONCE = 64


def chi_square_quantile(p: float, k: int) -> float:
    """Upper quantile: the value that a chi-square variable with ``k`` degrees of freedom exceeds with probability ``p``."""

    def beyond(x: float) -> float:
        # the regularised lower gamma function by its series
        a, h = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= h / n
            total += term
        return 1 - total * math.exp(a * math.log(h) - h - math.lgamma(a))

    low, high = 1e-9, 20.0 * k + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > p else (low, mid)
    return high


def directions(width: int, dimensions: int = DIMENSIONS, seed: int = 10) -> np.ndarray:
    """Gaussian directions, scaled so that along each axis of space, the one that lengthens vectors among them, projected
    squared distances are right on average: what many differences have in common is not distorted."""
    axes = np.random.default_rng(seed).standard_normal((width, dimensions))
    return axes * np.sqrt(dimensions / (axes * axes).sum(axis=1, keepdims=True))


def projected(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Projections of the vectors, brought to the length ``longest`` by one more dimension."""
    lift = np.sqrt(np.maximum(0.0, longest * longest * (1 + 1e-12) - (vectors * vectors).sum(axis=1)))
    return np.hstack([vectors, lift[:, None]]) @ directions(vectors.shape[1] + 1)


class Splits:
    """The inner nodes of a complete kd-tree of ``2 ** depth`` cells, each split at the median of the widest axis."""

    def __init__(self, points: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.at = np.zeros((1 << depth) - 1)
        held = {0: np.arange(len(points))}
        for node in range(len(self.axis)):
            own = held.pop(node)
            if len(own):
                axis = int(np.argmax(np.ptp(points[own], axis=0)))
                self.axis[node], self.at[node] = axis, np.median(points[own, axis])
            beyond = points[own, self.axis[node]] > self.at[node]
            held[2 * node + 1], held[2 * node + 2] = own[~beyond], own[beyond]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


class Block:
    """Vectors of a cell, and the search among them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float) -> None:
        order = np.lexsort((ids,))
        self.ids, vectors = ids[order], vectors[order] + 0.0  # no negative zeros
        _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.members = np.argsort(inverse, kind="stable")  # by distinct vector, then by id
        self.starts = np.searchsorted(inverse[self.members], np.arange(len(first) + 1))
        self.distinct = vectors[first]
        self.points = projected(self.distinct, longest)
        self.longest = longest

    def search(self, query_ids: np.ndarray, queries: np.ndarray, beat: np.ndarray, k: int = NEAREST, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The best ``k`` for each query of those that reach ``beat``: query ids, ids, inner products, and how many
        vectors were verified."""
        limit = chi_square_quantile(miss, self.points.shape[1])
        out_q, out_i, out_s, verified = [], [], [], 0
        squares = (self.points * self.points).sum(axis=1)
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            own = slice(start, start + QUERIES_AT_ONCE)
            axes = queries[own] @ directions(queries.shape[1] + 1)[:-1]  # a query is not lifted
            apart = squares[None, :] + (axes * axes).sum(axis=1)[:, None] - 2 * axes @ self.points.T
            for query_id, query, far, least in zip(query_ids[own], queries[own], apart, beat[own], strict=True):
                i, s, n = self._one(query_id, query, far, least, k, limit)
                verified += n
                out_q.append(np.full(len(i), query_id))
                out_i.append(i)
                out_s.append(s)
        return np.concatenate(out_q or [np.empty(0, np.int64)]), np.concatenate(out_i or [np.empty(0, np.int64)]), np.concatenate(out_s or [np.empty(0)]), verified

    def _one(self, query_id: int, query: np.ndarray, far: np.ndarray, beat: float, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
        length = float(query @ query) + self.longest * self.longest * (1 + 1e-12)
        slack = 1e-12 * length
        least, verified = beat, 0
        near = np.flatnonzero(far <= limit * (length - 2 * least) + slack) if least > -math.inf else np.arange(len(far))
        near = near[np.argsort(far[near], kind="stable")]
        got_i, got_s = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 4 * k
        while at < len(near):
            # a vector that beats the k-th best would be projected this far with probability miss only
            if least > -math.inf and far[near[at]] > limit * max(length - 2 * least, 0.0) + slack:
                break
            chosen = near[at : at + step]
            at += step
            step *= 2
            verified += len(chosen)
            if least > -math.inf:
                chosen = chosen[self.distinct[chosen] @ query >= least - slack]  # a fast product screens with some room for rounding
            if not len(chosen):
                continue
            # row by row in one order of summation, so that equal vectors have equal scores in every block
            scores = (self.distinct[chosen] * query).sum(axis=1)
            # the k + 1 least ids of each distinct vector, the query's own left out
            counts = np.minimum(self.starts[chosen + 1] - self.starts[chosen], k + 1)
            rows = np.repeat(self.starts[chosen], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            new_i, new_s = self.ids[self.members[rows]], np.repeat(scores, counts)
            wanted = (new_i != query_id) & (new_s >= beat)
            got_i, got_s = np.append(got_i, new_i[wanted]), np.append(got_s, new_s[wanted])
            best = np.lexsort((got_i, -got_s))[:k]
            got_i, got_s = got_i[best], got_s[best]
            if len(got_i) == k:
                least = float(got_s[-1])
        return got_i, got_s, verified


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _met(vectors: DataFrame, queries: DataFrame, width: int, longest: float, k: int, verified: Accumulator | None) -> DataFrame:
    """query_id, vec_id, score from queries (cell, block, id, v, beat) and the vectors (cell, block, id, v) of their blocks.

    A block's rows come in one run, vectors first; queries stream past them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            place = np.stack([batch.column(j).to_numpy() for j in range(3)])
            ids, rows, beat = batch.column(3).to_numpy(), _numbers(batch.column(4), width), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if key != (own := tuple(place[:2, start])):
                    key, parts, block = own, [], None
                if place[2, start] == 0:
                    parts.append((ids[start:end], rows[start:end].copy()))
                    continue
                if block is None and parts:
                    block, parts = Block(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), longest), []
                if block is not None:
                    q, i, s, n = block.search(ids[start:end], rows[start:end], beat[start:end], k)
                    if verified is not None:
                        verified.add(n)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    never = F.lit(-math.inf)
    rows = vectors.select("cell", "block", F.lit(0).alias("kind"), "id", "v", never.alias("beat")).unionAll(queries.select("cell", "block", F.lit(1).alias("kind"), "id", "v", "beat"))
    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "id").mapInArrow(run, "query_id long, vec_id long, score double")


def _sent(queries: DataFrame, boxes: dict[str, np.ndarray], width: int, longest: float, nearest: bool) -> DataFrame:
    """A row (cell, block, id, v, beat) for each block that a query (id, v, beat) goes to: those of its FIRST nearest
    cells, or of all other cells that pass the chi-square test."""
    limit = chi_square_quantile(MISS, DIMENSIONS)
    low, high, blocks = boxes["low"], boxes["high"], boxes["blocks"]

    def targets(query: np.ndarray, axes: np.ndarray, beat: float) -> np.ndarray:
        gap = np.maximum(0.0, np.maximum(low - axes, axes - high))
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        if nearest:
            return order[:FIRST]
        if beat == -math.inf:
            return order[FIRST:]
        length = float(query @ query) + longest * longest * (1 + 1e-12)
        rest = order[FIRST:]
        return rest[far[rest] <= limit * max(length - 2 * beat, 0.0) + 1e-12 * length]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, at: list[int], cells: list[np.ndarray]) -> pa.RecordBatch:
            counts = blocks[np.concatenate(cells)]
            block = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            cell = np.repeat(boxes["cell"][np.concatenate(cells)], counts)
            own = pa.array(np.repeat(np.repeat(at, [len(c) for c in cells]), counts))
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(block, pa.int64()), *(batch.column(j).take(own) for j in range(3))], names=["cell", "block", "id", "v", "beat"])

        for batch in batches:
            queries, beat = _numbers(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
            axes = queries @ directions(width + 1)[:-1]
            at, cells = [], []
            for n in range(batch.num_rows):
                at.append(n)
                cells.append(targets(queries[n], axes[n], beat[n]))
                if sum(map(len, cells[-64:])) > 4_096 or len(cells) == 512 or n == batch.num_rows - 1:
                    if any(map(len, cells)):
                        yield rows(batch, at, cells)
                    at, cells = [], []

    return queries.select("id", "v", "beat").mapInArrow(run, "cell long, block long, id long, v array<double>, beat double")


def search(vectors: DataFrame, is_query: F.Column, k: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding", verified: Accumulator | None = None) -> DataFrame:
    """The ``k`` nearest found for each row where ``is_query`` (of column ``id``) holds: query_id, rank, vec_id, score.

    ``verified`` counts the vectors that were verified on their original components.
    """
    rows = valid_vectors(vectors, id_column, vector_column)
    length = F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    facts = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), length.alias("longest")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not facts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, longest = facts[0]["width"], facts[0]["n"], facts[0]["longest"]
    rows = rows.where(F.size("v") == width)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projected(_numbers(batch.column(1), width), longest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(points), pa.list_(pa.float64()))], names=["id", "v", "p"])

    projections = written(rows.mapInArrow(project, "id long, v array<double>, p array<double>"), "projected")
    sample = projections.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(-(-n // SAMPLE))) == 0).select("p").toPandas()["p"]
    depth = max(0, min(MOST_CELLS, n // CELL).bit_length() - 1)
    splits = Splits(np.stack(sample.to_numpy()) if len(sample) else np.empty((0, DIMENSIONS)), depth)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splits.cell(_numbers(batch.column(2), DIMENSIONS)), pa.int64())], names=["id", "v", "p", "cell"])

    assigned = projections.mapInArrow(assign, "id long, v array<double>, p array<double>, cell long")
    axis = range(DIMENSIONS)
    bounds = [f(F.col("p")[i]) for f in (F.min, F.max) for i in axis]
    found = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.array(*bounds[:DIMENSIONS]).alias("low"), F.array(*bounds[DIMENSIONS:]).alias("high")).toPandas().sort_values("cell")
    boxes = {"cell": found["cell"].to_numpy(), "low": np.stack(found["low"].to_numpy()), "high": np.stack(found["high"].to_numpy()), "blocks": -(-found["n"].to_numpy() // BLOCK)}
    cut = vectors.sparkSession.createDataFrame(list(zip(boxes["cell"].tolist(), boxes["blocks"].tolist(), strict=True)), "cell long, blocks long")  # at most MOST_CELLS rows
    placed = assigned.join(F.broadcast(cut), "cell").select("cell", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).alias("block"), "id", "v")
    placed = written(placed, "cells")

    queries = written(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = written(best(_met(placed, _sent(queries.withColumn("beat", F.lit(-math.inf)), boxes, width, longest, True), width, longest, k, verified)), "first")
    to_beat = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("beat"))
    going = queries.join(to_beat, "id", "left").select("id", "v", F.coalesce("beat", F.lit(-math.inf)).alias("beat"))
    second = _met(placed, _sent(going, boxes, width, longest, False), width, longest, k, verified)
    return best(first.select("query_id", "vec_id", "score").unionAll(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
