from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import MIDDLE, clashing, documents, empty, odd, table
from veilscan.llm import quality_rules as Q
from veilscan.llm import registry


def brute(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é😀\x1c\x85"), max_size=120))
def test_statistics_equal_brute_force(text):
    assert Q.statistics(text)[:5] == brute(text)


def test_query_equals_brute_force_over_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, MIDDLE).collect()}
    rows = registry.op5_quality_rules(spark, MIDDLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_list_agrees_with_labels(spark):
    rows = registry.op5_quality_rules(spark, MIDDLE).join(table(spark, "labels", MIDDLE), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    poor = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(not r["kept"] for r in poor) >= 0.9 * len(poor)


def test_learns_planted_rules():
    rng = np.random.default_rng(1)
    data = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((data["a"] > 0.8) & (data["b"] <= 0.3)) | (data["c"] > 0.95)
    rules = Q.learn(data, bad)
    covered = np.logical_or.reduce([r.mask(data) for r in rules])
    assert (covered == bad).mean() > 0.97 and all(len(r.conditions) <= 4 for r in rules)


def test_one_kind_of_labels_teaches_nothing():
    data = {"a": np.arange(5.0)}
    assert Q.learn(data, np.ones(5, bool)) == Q.learn(data, np.zeros(5, bool)) == Q.learn({"a": np.empty(0)}, np.empty(0, bool)) == []


def test_expression_equals_masks(spark):
    stats = Q.text_statistics(documents(spark))
    data = stats.select("doc_id", *(c.alias(n) for n, c in Q.measures().items())).toPandas()
    rules = [Q.Rule((Q.Condition("symbol_ratio", True, 0.05),)), Q.Rule((Q.Condition("n_words", False, 60.5), Q.Condition("upper_ratio", True, 0.04)))]
    fired = {r["doc_id"]: r["f"] for r in stats.select("doc_id", Q.fired_rule(rules).alias("f")).collect()}
    masks = [r.mask({n: data[n].to_numpy() for n in Q.measures()}) for r in rules]
    assert fired == {i: 0 if a else 1 if b else None for i, a, b in zip(data["doc_id"], *masks, strict=True)}


def test_odd_rows(spark):
    docs = clashing(odd(spark))
    rows = Q.judge(docs, []).collect()
    assert len(rows) == docs.count()
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    kept = Q.keep(docs, [])
    assert kept.columns == docs.columns and kept.count() == 0
    assert Q.keep(documents(spark), []).schema == documents(spark).schema
    none = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert Q.fit(docs, none) == [] and Q.judge(empty(spark), []).count() == 0
