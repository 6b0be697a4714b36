from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import MIDDLE, clashing, documents, empty, odd, table
from veilscan.llm import registry, toxicity
from veilscan.llm.toxicity import Entry, LexiconAutomaton, Model, Scorer


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=7), min_size=1, max_size=6, unique=True), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=12), st.integers(0, 2), st.booleans())
def test_automaton_equals_brute_force(terms, words, edits, stem):
    automaton = LexiconAutomaton([Entry(t, edits, stem) for t in terms])
    for w in words:
        best = min((min(distance(w[:k], t) for k in (range(len(w) + 1) if stem else [len(w)])), i) for i, t in enumerate(terms))
        found = automaton.match(w)
        if best[0] <= edits:
            # a stem may be reached at several places; the fewest edits count
            assert found is not None and found[1] == best[0]
        else:
            assert found is None


def test_states_are_bounded():
    automaton = LexiconAutomaton([Entry("disgusting", 2, False)], max_states=50)
    rng = random.Random(1)
    words = ["".join(rng.choices("disgutn", k=10)) for _ in range(300)] + ["disgustin", "disgustting"]
    assert [automaton.match(w) is not None for w in words] == [distance(w, "disgusting") <= 2 for w in words]


def test_context_separates_quotation():
    scorer = Scorer(Model((Entry("idiot", 1, False),)))
    spans = {t: scorer.spans(t)[0] for t in ("you are an idiot", 'he used "idiot" there', "she said idiot once", 'a "b" idiot "c"', "you idi0t")}
    assert [(s["quoted"], s["addressed"], s["edits"]) for s in spans.values()] == [(False, True, 0), (True, True, 0), (True, True, 0), (False, False, 0), (False, True, 1)]
    scores = [scorer.score(scorer.features(t)) for t in ("you are an idiot", "you are an idiott", "you are kind", 'the "idiot" entry')]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 4


def test_quotation_never_raises_a_score(spark):
    model = toxicity.fit(documents(spark, MIDDLE), table(spark, "labels", MIDDLE))
    for own in (model, Model((Entry("idiot", 1, False),))):
        scorer = Scorer(own)
        score = lambda t: scorer.score(scorer.features(t))
        for quoted in ('they wrote "idiot" there', "he called him an idiot", "das Zitat: „idiot“ steht da"):
            assert score(quoted) <= score("nothing at all")
            assert score(quoted) < toxicity.THRESHOLD <= score("you idiot, you idiot")


def brute_score(model, text):
    """A whole text's score by plain tables of distances, word by word."""
    words = [(m.group(), m.start(), m.end()) for m in toxicity.TOKEN.finditer(text.lower())]
    different = {w for w, _, _ in words}
    plain, shared = [e for e in model.entries if not e.share], {e.text: e for e in model.entries if e.share}

    def best(word):
        found = []
        for n, e in enumerate(plain):
            d = min(distance(word[:k], e.text) for k in (range(len(word) + 1) if e.stem else [len(word)]))
            if d <= e.edits:
                found.append((d, n))
        return (plain[min(found)[1]], min(found)[0]) if found else None

    hits = {w: h for w in different if (h := best(w))}
    begun, plainly = {t: {w for w in different if w.startswith(t)} for t in shared}, dict(hits)
    for t in sorted(shared, key=len):  # the longest beginning that is frequent enough wins
        if len(begun[t]) >= 2 and 1000 * len(begun[t]) >= shared[t].share * len(different):
            hits |= {w: (shared[t], 0) for w in begun[t] - plainly.keys()}
    sums, entries = Counter(), set()
    for i, (w, start, end) in enumerate(words):
        if w in hits:
            entry, edits = hits[w]
            before, after = [x for x, _, _ in words[max(0, i - 6) : i]], [x for x, _, _ in words[i + 1 : i + 7]]
            if set(before) & toxicity.REPORTING or Scorer._in_quotes(text.lower()[max(0, start - 160) : start], text.lower()[end : end + 160]):
                sums["quoted"] += entry.weight
                continue
            sums["near" if edits else "exact"] += entry.weight
            if not edits:
                entries.add(entry.text)
                sums["addressed"] += bool(set(before + after) & toxicity.ADDRESS)
    values = [math.log1p(sums[n]) for n in ("exact", "near", "quoted", "addressed")] + [math.log1p(max(0, len(entries) - 1))]
    return 1 / (1 + math.exp(-model.weights[0] - sum(w * v for w, v in zip(model.weights[1:], values, strict=True))))


def test_scores_of_whole_texts_equal_brute_force(spark):
    docs = documents(spark).where("length(text) < 1500").limit(60)
    docs = docs.unionAll(spark.createDataFrame([(9_000 + k, t, "en", "x", len(t)) for k, t in enumerate(["You IDIOT, stupidd!", 'he said "moron" and you moron', "pathetic worthles l0ser you", "trash trashy", ""])], docs.schema))
    model = toxicity.fit(documents(spark, MIDDLE), table(spark, "labels", MIDDLE))
    model = Model((*model.entries, Entry("trash", 1, True), Entry("anti", 0, True, 1.0, 4)), model.weights)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(brute_score(model, texts[r["doc_id"]]), abs=1e-9), r["doc_id"]


def test_held_out_accuracy(spark):
    scored = registry.op1_toxicity(spark, MIDDLE).join(table(spark, "labels", MIDDLE), "doc_id").where("held_out").collect()
    positive = [r for r in scored if r["predicted"]]
    assert positive and all(r["toxic"] == 1 for r in positive)
    # some labels say toxic without anything in the text that does
    assert sum(r["toxic"] == 0 and not r["predicted"] for r in scored) == sum(r["toxic"] == 0 for r in scored)


def test_labels_of_the_held_out_quarter_are_not_used(spark):
    from pyspark.sql import functions as F

    from veilscan.llm.common import crc_bucket

    labels = table(spark, "labels", MIDDLE)
    turned = labels.withColumn("toxic", F.when(crc_bucket("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = documents(spark, MIDDLE)
    assert toxicity.fit(docs, labels.where(crc_bucket("doc_id", 4) != 2)) == toxicity.fit(docs, turned.where(crc_bucket("doc_id", 4) != 2))


def test_odd_rows(spark):
    model = Model((Entry("seven", 1, False),))
    docs = odd(spark)
    rows = toxicity.score(clashing(docs), model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_id.values()) and by_id[1] == by_id[2] == by_id[3] != by_id[5]
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.keep(clashing(docs), model).columns == clashing(docs).columns
    assert {r["doc_id"] for r in toxicity.keep(docs, model, threshold=0.2).collect()} == {1, 2, 3, 4, None, 7, 8}
    assert {r["entry"] for r in toxicity.hits(docs, model).collect()} == {"seven"}


def test_no_labels_give_the_default_lexicon(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), none)
    assert [e.text for e in model.entries] == list(toxicity.DEFAULT_TERMS)
    assert toxicity.fit(empty(spark), none) == model


def test_greedy_cover_ignores_what_adds_nothing():
    positive = {i: {"idio", "idiot$"} | ({"copy$"} if i < 20 else set()) for i in range(40)}
    entries = toxicity.choose_entries(positive, dict.fromkeys(itertools.chain.from_iterable(positive.values()), 1.0), 5)
    assert [(e.text, e.stem) for e in entries][0] == ("idiot", False)


def test_default_terms_stay_and_few_rows_teach(spark):
    """One very common word explains most rows; the default terms, rarer words and beginnings of few rows hold too."""
    rng = random.Random(11)
    known = ["".join(rng.choices("bcdfglmnrtuv", k=8)) for _ in range(300)]
    word = lambda: rng.choice(known)
    rows = []
    for i in range(330):
        words = [word() for _ in range(150)]
        extra = ["trash"] if i < 20 else ["gribblk"] if i < 23 else ["hexoma" + word() for _ in range(4)] if i < 26 else ["hexoma" + word()] if 30 <= i < 60 else []
        for e in extra:
            words.insert(rng.randrange(len(words)), e)
        rows.append((i, " ".join(words), int(i < 26)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("text").join(docs.select("doc_id", "text"), "doc_id"), docs.select("doc_id", "toxic"))
    assert {"trash", "gribblk"} <= {e.text for e in model.entries if not e.share} and set(toxicity.DEFAULT_TERMS) <= {e.text for e in model.entries}
    assert any(e.text.startswith("hexo") and e.share for e in model.entries)
    scorer = Scorer(model)
    scores = {r[0]: scorer.score(scorer.features(r[1])) for r in rows}
    assert {i for i, s in scores.items() if s >= toxicity.THRESHOLD} == set(range(26))
    assert scorer.score(scorer.features("you are an idiot")) >= toxicity.THRESHOLD


def test_copied_passages_teach_nothing(spark):
    passage = " ".join(f"passage{chr(97 + i)}" for i in range(20))
    rows = [(i, f"{passage} plain{i}", int(i < 8)) for i in range(8)] + [(i, f"plain{i} other words here", 0) for i in range(8, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    # the last word stands before a different one each time
    assert not [e.text for e in model.entries if e.text.startswith("passage") and e.text not in ("passage", "passaget")]


def test_recall_by_language(spark):
    rows = registry.op1_toxicity(spark, MIDDLE).join(table(spark, "labels", MIDDLE).where("toxic = 1"), "doc_id").join(documents(spark, MIDDLE).select("doc_id", "lang"), "doc_id").collect()
    caught = {lang: [r["predicted"] for r in rows if r["lang"] == lang] for lang in ("de", "en", "es", "fr")}
    # a few labels say toxic without anything in the text that does
    assert {lang: (sum(c), len(c)) for lang, c in caught.items()} == {"de": (6, 6), "en": (33, 36), "es": (4, 4), "fr": (3, 5)}
