from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import MIDDLE, clashing, documents, empty, odd
from veilscan.llm import mixing


def shares(sizes, weights, total, cap):
    """Rounds as stated: share by weight, stop at the cap, share the excess again."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}
    left = total
    while left > 1e-9 and open_:
        unit = left / sum(weights[i] for i in open_)
        left = 0.0
        for i in list(open_):
            out[i] += unit * weights[i]
            if out[i] >= cap * sizes[i]:
                left += out[i] - cap * sizes[i]
                out[i] = cap * sizes[i]
                open_.discard(i)
    return out


def test_targets_equal_rounds():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 100, 1000, rng.randrange(5000)]) for _ in range(rng.randrange(1, 12))]
        weights = [rng.choice([5.0, 2.0, 1.0]) for _ in sizes]
        assert mixing.allocate(sizes, weights, 1.5 * sum(sizes), 2.0) == pytest.approx(shares(sizes, weights, 1.5 * sum(sizes), 2.0), abs=1e-6)


def test_mix_takes_the_budget_near_every_target(spark):
    docs = documents(spark, MIDDLE)
    rows = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    by_source = defaultdict(list)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source"]].append(r)
    names = sorted(by_source)
    sizes = [sum(r["size"] for r in by_source[n]) for n in names]
    targets = shares(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2.0)
    for n, s, t in zip(names, sizes, targets, strict=True):
        assert {(r["source_size"], round(r["target"], 6)) for r in by_source[n]} == {(s, round(t, 6))}
        assert abs(sum(r["taken"] for r in by_source[n]) - t) <= t / mixing.PACKETS + 2
    assert sum(r["taken"] for r in rows) == int(sum(targets) + 1e-6)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark)
    first = sorted(mixing.mix(docs).collect())
    assert first == sorted(mixing.mix(docs.repartition(7)).collect())


def brute_line(docs, weights=(5, 2, 1), budget=None):
    """Fair queueing by hand: documents in hash order, in packets, finish times, one global order, cut at the budget.

    Words taken by (doc_id, lap).
    """
    queue, sizes = defaultdict(list), defaultdict(int)
    hashed = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), mixing.spot(F.col("doc_id"), F.col("text"), 4).alias("spot")).collect()
    for r in sorted(hashed, key=lambda r: (r["spot"], r["doc_id"] or 0, r["size"])):
        queue[r["source"]].append((r["doc_id"], r["size"]))
        sizes[r["source"]] += r["size"]
    names = sorted(queue, key=mixing.by_code_point)
    target = dict(zip(names, shares([sizes[n] for n in names], [weights[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2.0), strict=True))
    line = []
    for s in names:
        packet, ahead = max(1, math.ceil(target[s] / mixing.PACKETS)), 0
        for lap in (0, 1):
            for doc, size in queue[s]:
                for offset in range(0, size, packet):
                    words = min(packet, size - offset)
                    line.append(((ahead + offset + words) / target[s], (s is not None, s or ""), lap, ahead, offset, doc, words))
                ahead += size
    left, taken = int((budget if budget else sum(target.values())) + 1e-6), Counter()
    for *_, lap, _, _, doc, words in ((x[0], x[1], x[2], x[3], x[4], x[5], x[6]) for x in sorted(line, key=lambda x: x[:5])):
        taken[doc, lap] += min(words, left)
        left -= min(words, left)
    return {k: n for k, n in taken.items() if n}


@pytest.mark.parametrize(("packets", "budget"), [(10_000, None), (20, None), (50, 7_000)])
def test_line_equals_brute_force(spark, monkeypatch, packets, budget):
    monkeypatch.setattr(mixing, "PACKETS", packets)
    docs = documents(spark)
    truth = brute_line(docs, budget=budget)
    rows = mixing.mix(docs, budget=budget).collect()
    by_doc = Counter()
    for (doc, _), n in truth.items():
        by_doc[doc] += n
    assert {r["doc_id"]: r["taken"] for r in rows if r["taken"]} == by_doc
    assert {r["doc_id"]: r["times"] for r in rows if r["times"]} == Counter(doc for doc, _ in truth)
    kept = Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mixing.keep(docs, budget=budget).collect())
    assert kept == Counter((doc, n) for (doc, _), n in truth.items())


def test_kept_rows_are_cut_after_a_word_and_equal_rows_are_taken_one_by_one(spark):
    text = "  one two\tthree \n four"
    rows = [(1, text, "en", "a", len(text))] * 3 + [(None, text, "en", "a", len(text)), (2, "x " * 40, "en", "b", 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r for r in mixing.keep(docs, budget=17).collect() if r["source"] == "a"]
    taken = sum(len(r["text"].split()) for r in kept)
    assert taken == sum(r["taken"] for r in mixing.mix(docs, budget=17).collect() if r["source_size"] == 16)
    assert all(text.startswith(r["text"]) and r["n_chars"] == len(r["text"]) and not r["text"].endswith((" ", "\n", "\t")) for r in kept) and 4 < taken < 16


def test_smaller_budget(spark):
    docs = documents(spark)
    rows = mixing.mix(docs, budget=10_000).collect()
    assert 9_900 < sum(r["taken"] for r in rows) <= 10_000


def test_odd_rows(spark):
    docs = clashing(odd(spark))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] == 0 for r in rows if not r["size"])
    assert mixing.mix(empty(spark)).count() == 0
    kept = mixing.keep(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert mixing.keep(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_source_order():
    assert sorted(["b", None, "", "a", "Z", "ä", "😀", "\uffff"], key=mixing.by_code_point) == ["", "Z", "a", "b", "ä", "\uffff", "😀", None]
