from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import MIDDLE, table
from veilscan.llm import neighbours as N
from veilscan.llm import registry

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, vectors, query_id, k=20):
    scores = vectors @ vectors[ids.index(query_id)]
    return sorted(((-s, i) for i, s in zip(ids, scores, strict=True) if i != query_id))[:k]


def test_query_recall_and_scores(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table(spark, "embeddings", MIDDLE).orderBy("vec_id").collect()]
    ids, vectors = [i for i, _ in rows], np.stack([v for _, v in rows])
    got = {}
    for r in registry.op10_neighbours(spark, MIDDLE).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        for r in found:
            assert r["score"] == pytest.approx(vectors[ids.index(r["vec_id"])] @ vectors[ids.index(q)], abs=1e-12)
        hits += len({r["vec_id"] for r in found} & {i for _, i in brute(ids, vectors, q)})
    assert hits >= 0.95 * 20 * len(got)


def measured(spark, vectors, every):
    """Recall against brute force and the share of all vectors that a query verifies."""
    ids = np.arange(len(vectors))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(vectors)}), SCHEMA)
    verified = spark.sparkContext.accumulator(0)
    found = N.search(df, F.col("id") % every == 0, verified=verified).toPandas()
    queries = ids[::every]
    wide = vectors.astype(np.float32).astype(float)
    scores = wide[queries] @ wide.T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    own = found.groupby("query_id")["vec_id"].apply(set)
    assert len(own) == len(queries) and (found.groupby("query_id").size() == 20).all()
    return np.mean([len(own[q] & set(b.tolist())) / 20 for q, b in zip(queries, best, strict=True)]), verified.value / (len(queries) * len(vectors))


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 32)) * 2
    vectors = centres[rng.integers(0, 200, 40_000)] + 0.3 * rng.standard_normal((40_000, 32))
    recall, share = measured(spark, vectors.astype(np.float32) / np.linalg.norm(vectors, axis=1, keepdims=True), 400)
    assert recall >= 0.95 and share <= 0.15


def test_vectors_without_structure_stop_by_the_chi_square_test(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((20_000, 48)).astype(np.float32)
    recall, share = measured(spark, vectors / np.linalg.norm(vectors, axis=1, keepdims=True), 400)
    assert recall >= 0.93 and share <= 0.8


def test_cells_hold_each_point_once():
    rng = np.random.default_rng(6)
    points = np.vstack([rng.standard_normal((3_000, 4)), np.ones((500, 4))])
    splits = N.Splits(points, 4)
    cell = splits.cell(points)
    assert cell.min() >= 0 and cell.max() < 16 and np.bincount(cell, minlength=16).max() < 1_000 and len(set(cell[3_000:].tolist())) == 1
    assert N.Splits(np.empty((0, 4)), 2).cell(points).max() < 4 and (N.Splits(points, 0).cell(points) == 0).all()


def test_chi_square_quantile():
    assert N.chi_square_quantile(0.05, 8) == pytest.approx(15.507, abs=1e-3) and N.chi_square_quantile(0.01, 1) == pytest.approx(6.635, abs=1e-3)


def test_ties_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 40)
    monkeypatch.setattr(N, "BLOCK", 30)
    monkeypatch.setattr(N, "FIRST", 1)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else rng.standard_normal(3).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in N.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    vectors = np.array([np.array(v, dtype=np.float32) for _, v in rows], dtype=float)
    assert set(got) == set(range(0, 300, 20)) and all(len(found) == 20 for found in got.values())
    for q in range(0, 300, 60):  # the frequent vector itself: every nearest one is a tie or better
        assert [i for _, i in got[q]] == [i for _, i in brute(list(range(300)), vectors, q)]


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (1, [None, 1.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0, 0.0]), (None, [1.0, 1.0]), (4, [1.0]), (5, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("block", F.lit(2))
    found = N.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 3, 2.0), (0, 2, 2, 0.5), (0, 3, 2, 0.5)]
    assert N.search(df.where("false"), F.col("id") % 20 == 0).count() == 0
    assert N.search(df.where("vec_id = 40"), F.col("id") % 20 == 0).count() == 0
