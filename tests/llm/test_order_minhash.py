from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import MIDDLE, clashing, documents, empty, odd
from veilscan.llm import order_minhash as O
from veilscan.llm import registry


def similarity(a, b):
    """By a full table: the most words that both have in the same order."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=60), st.lists(st.sampled_from("abcdef"), max_size=60))
def test_common_words_equals_full_table(a, b):
    n = O.common_words(a, b)
    assert not a or not b or n / (len(a) + len(b) - n) == similarity(a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=80), st.lists(st.tuples(st.integers(0, 79), st.integers(0, 41), st.sampled_from("cid")), max_size=12))
def test_alignment_holds_and_is_the_full_tables(words, edits):
    """Never above what a full table finds; equal to it where texts have few repeated words."""
    other = list(words)
    for at, w, kind in edits:
        if other:
            at %= len(other)
            other[at : at + (kind != "i")] = [w] * (kind != "d")
    a, b = [f"w{x}" for x in words], [f"w{x}" for x in other]
    true, got = similarity(a, b), O.alignment(" ".join(a), " ".join(b))
    assert got == 0 or got >= 0.8 and got <= true
    distinct = list(dict.fromkeys(a))
    changed = [w if n % 9 else "new" for n, w in enumerate(distinct)]
    shared = set(O.labelled_kmers(distinct)) & set(O.labelled_kmers(changed))
    true = similarity(distinct, changed)
    assert O.alignment(" ".join(distinct), " ".join(changed)) == (true if true >= 0.8 and shared else 0.0)


def test_alignment_over_long_texts_is_the_full_one():
    rng = random.Random(3)
    for share in (0.01, 0.05, 0.1, 0.12, 0.3):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(100, 3_000))]
        other = [w for x in base for w in (([], [x, "new"], [f"v{rng.randrange(400)}"])[rng.randrange(3)] if rng.random() < share else [x])]
        n = O.common_words(base, other)
        true = n / (len(base) + len(other) - n)
        assert O.alignment(" ".join(base), " ".join(other)) == (true if true >= 0.8 else 0.0)
    assert O.alignment("a b c d", "a b c d") == 1.0 and O.alignment("a b c d", "a b c") == 0.0 and O.alignment("", "a") == 0.0


def one(words):
    hashes = O.Hasher().words(words)
    return O.kmers(hashes, np.array([len(words)]))


def test_order_counts():
    words = [f"w{i}" for i in range(200)]
    turned = words[100:] + words[:100]
    a, b = O.labelled_kmers(words), O.labelled_kmers(turned)
    shared = len(set(a) & set(b))
    assert shared / (len(a) + len(b) - shared) > 0.9 and O.alignment(" ".join(words), " ".join(turned)) < 0.8
    assert (O.sketch(*one(words)) == O.sketch(*one(turned))).mean() < 0.75


def test_sketches_of_many_texts_are_those_of_each():
    """Least hashes in text order, by a loop over each text; k-mers are as unique as the labelled tuples."""
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(37)}" for _ in range(n)] for n in (1, 2, 4, 5, 6, 7, 300, 3, 40, 2_000)]
    hasher = O.Hasher()
    hashes = np.concatenate([hasher.words(t) for t in texts])
    lengths = np.array([len(t) for t in texts])
    labelled, counts = O.kmers(hashes, lengths)
    assert counts.tolist() == [len(O.labelled_kmers(t)) for t in texts]
    keys = O.sketch(labelled, counts)
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            own = labelled[starts[i] : starts[i] + counts[i]]
            assert len(set(own.tolist())) == len(own) and (own == one(text)[0]).all()
            for t in range(O.TABLES):
                hashed = own * O._FACTORS[t]
                key = O._FACTORS[t]
                for j in sorted(np.argsort(hashed)[: O.ELL]):
                    key = O._mix(key * O._MIX1 + own[j])
                assert keys[i, t] == key


def test_counts_bound_the_difference():
    rng = random.Random(5)
    for _ in range(50):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(5, 400))]
        other = [w if rng.random() > 0.05 else "z" for w in words]
        x, y = (O.cells(O.Hasher().words(w), np.array([len(w)]))[0].astype(int) for w in (words, other))
        assert np.abs(x - y).sum() <= len(words) + len(other) - 2 * O.common_words(words, other)


def brute(rows):
    words = {i: O.WORDS.findall(t) for i, t in rows.items() if t is not None}
    holders, pairs = defaultdict(list), []
    for i, own in words.items():
        shared = set()
        for g in O.labelled_kmers(own):
            shared.update(holders[g])
            holders[g].append(i)
        for j in shared:
            if min(len(own), len(words[j])) >= 0.8 * max(len(own), len(words[j])):
                n = O.common_words(own, words[j])
                if n / (len(own) + len(words[j]) - n) >= 0.8:
                    pairs.append((j, i))
    blank = [i for i, k in words.items() if not k]
    return classes(pairs + list(zip(blank, blank[1:], strict=False)), rows), pairs


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in documents(spark, MIDDLE).collect()}
    assert {r["doc_id"]: r["class_id"] for r in registry.op8_order_minhash(spark, MIDDLE).collect()} == brute(rows)[0]


def test_recall_of_copies_by_share_of_words_changed(spark):
    """Each text has one copy in which every word is changed with a probability; figures are in the README."""
    rng = random.Random(11)
    least = {0.01: 1.0, 0.03: 0.99, 0.05: 0.98, 0.08: 0.9}
    rows, pairs = [], {}
    for share in least:
        for _ in range(100):
            base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(100, 400))]
            pairs[len(rows)] = share
            rows += [base, [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base]]
    found, _ = O.near_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    for share, least_caught in least.items():
        own = [i for i, s in pairs.items() if s == share]
        assert sum(got[i] == got[i + 1] == i for i in own) >= least_caught * len(own), share
    assert all(c in (i, i - 1) for i, c in got.items())


def family(rng, n_words, copies, edits):
    base = [f"v{rng.randrange(5000)}" for _ in range(n_words)]
    out = [base]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(1, edits + 1)):
            own[rng.randrange(n_words)] = f"e{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(w) for w in out]


def test_large_family_passages_and_copies(spark):
    rng = random.Random(6)
    texts = family(rng, 150, 120, 5)
    texts += [t for _ in range(20) for t in family(rng, 120, 3, 2)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    texts += [texts[0]] * 150
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    found, links = O.near_classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    truth, pairs = brute(rows)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == truth
    assert {(r["a"], r["b"]) for r in links.collect()} <= {(min(p), max(p)) for p in pairs}


def revisions(rng, n):
    """Each text is near its next predecessors only; the ids are shuffled along the line."""
    words, texts = [f"v{i}" for i in range(60)], []
    for k in range(n):
        words[k * 7 % 60] = f"r{k}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_members_outside_meet_all_others_in_blocks(spark, monkeypatch):
    """After a single round of hubs, blocks of a few rows still find every link."""
    monkeypatch.setattr(O, "OUTSIDE_BLOCK", 3)
    monkeypatch.setattr(O, "MEMBER_BLOCK", 4)
    monkeypatch.setattr(O, "PROGRESS", 0.0)
    monkeypatch.setattr(O, "RUN", 2)
    rows = revisions(random.Random(7), 60)
    found, _ = O.near_classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == brute(rows)[0]


def test_odd_rows(spark):
    docs = clashing(odd(spark))
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in O.near_classes(docs)[0].collect())
    assert got == sorted([(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (5, 5), (6, 5), (0, 0), (7, 7), (8, 8)])
    kept = O.keep(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 7, 8]
    assert O.near_classes(empty(spark))[0].count() == 0 and O.keep(empty(spark)).count() == 0


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from veilscan.llm import common

    path = common.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert common.drop_scratch(spark) > 0 and common.drop_scratch(spark) == 0
    assert not os.path.exists(path.removeprefix("file://"))


def test_bitmap_marks_all_members_and_few_others(spark):
    from veilscan.llm.common import mark_members

    ids = spark.range(0, 30_000, 3).withColumnRenamed("id", "member")
    marked = mark_members(clashing(spark.range(30_000).withColumnRenamed("id", "doc_id")), "doc_id", ids, "maybe").where("maybe").select("doc_id").collect()
    found = {r["doc_id"] for r in marked}
    assert set(range(0, 30_000, 3)) <= found and len(found) < 11_500
    assert mark_members(spark.range(5), "id", ids.where("false"), "maybe").where("maybe").count() == 0


def test_components_of_shuffled_chains(spark):
    from veilscan.llm.common import components

    rng = random.Random(8)
    ids = rng.sample(range(10**6), 3_300)
    chain, ends, star = ids[:3_000], sorted(ids[3_000:3_200])[::2] + sorted(ids[3_000:3_200])[1::2][::-1], ids[3_200:]
    pairs = list(zip(chain, chain[1:], strict=False)) + list(zip(ends, ends[1:], strict=False)) + [(star[50], s) for s in star if s != star[50]]
    links = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs] + [(chain[0], chain[0])], "a long, b long")
    assert {r["id"]: r["root"] for r in components(links).collect()} == {i: min(own) for own in (chain, ends, star) for i in own}
    assert components(links.where("false")).count() == 0


def test_serial_revisions_are_one_class(spark):
    rows = revisions(random.Random(9), 240)
    truth, _ = brute(rows)
    found, _ = O.near_classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert set(truth.values()) == {0}
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == truth


def test_texts_that_share_an_id_are_judged_for_themselves(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, d), (3, d), (4, b), (5, None), (5, c), (None, a)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = O.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (5, None), (None, a)], key=str)
