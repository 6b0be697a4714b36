from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from tests.llm import test_mixing, test_order_minhash
from tests.llm.helpers import MIDDLE, SMALL, clashing, documents, empty, odd, table
from veilscan.llm import mixing, quality_rules, registry, toxicity
from veilscan.llm.common import crc_bucket

TOKENIZER = Tokenizer.from_file(registry.vocabulary("word_bpe_49k.json"))


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def n_tokens(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids) + 1


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "packing"]
    assert registry.queries()["pipeline"] and corpus_pipeline.ORACLE_SQL is None


def expected(spark, name, docs, sf_dir):
    """What a stage leaves of its input, worked out on the driver: (doc_id, text) as often as it is kept."""
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    if name == "toxicity":
        model = toxicity.fit(docs, table(spark, "labels", sf_dir).where(crc_bucket("doc_id", 4) != 2))
        scorer = toxicity.Scorer(model)
        return Counter((i, t) for i, t in rows.items() if scorer.score(scorer.features(t)) < 0.3)
    if name == "quality_rules":
        kept = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, "labels", sf_dir))).where("kept").collect()
        assert all(n_words(rows[r["doc_id"]]) == r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"] for r in kept)
        return Counter((r["doc_id"], rows[r["doc_id"]]) for r in kept)
    if name == "near_duplicates":
        classes, _ = test_order_minhash.brute(rows)
        return Counter((i, t) for i, t in rows.items() if classes[i] == i)
    words = {i: list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows.items()}
    return Counter((doc, rows[doc] if n == len(words[doc]) else rows[doc][: words[doc][n - 1].end()]) for (doc, _), n in test_mixing.brute_line(docs).items())


def test_each_stage_equals_brute_force_on_its_own_input(spark, tmp_path):
    docs = documents(spark, MIDDLE)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        truth = expected(spark, name, docs, MIDDLE)
        stage(spark, docs, MIDDLE).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert docs.columns == columns and Counter((r["doc_id"], r["text"]) for r in rows) == truth, name
        assert set(truth) < {(i, r["text"]) for i, r in before.items()} or name == "mixing"
        for r in rows:
            own = before[r["doc_id"]]
            assert (r["lang"], r["source"]) == (own["lang"], own["source"]) and r["n_chars"] == (own["n_chars"] if r["text"] == own["text"] else len(r["text"]))
    texts = Counter((r["doc_id"], n_tokens(r["text"])) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE).collect()
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == texts
    run = corpus_pipeline.run(spark, MIDDLE).collect()
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in run if p["start"] == 0) == texts
    assert sum(p["length"] for p in run) == sum(n * k for (_, n), k in texts.items())


def test_odd_rows(spark):
    docs = clashing(odd(spark))
    ids = lambda df: sorted(r["doc_id"] or 0 for r in df.collect())
    out = {name: stage(spark, docs, SMALL) for name, stage in corpus_pipeline.STAGES}
    assert all(out[name].columns == docs.columns for name in out if name != "packing")
    assert ids(out["toxicity"]) == ids(docs)
    assert ids(out["quality_rules"]) == []  # all of these texts are short, blank or repeat themselves
    assert ids(out["near_duplicates"]) == [0, 1, 2, 4, 5, 7, 8]
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    kept = Counter()
    for r in out["mixing"].collect():
        kept[r["doc_id"]] += n_words(r["text"])
    assert kept == +taken and sum(taken.values()) > 60_000
    pieces, total = Counter(), Counter()
    for p in out["packing"].collect():
        pieces[p["doc_id"]] += p["length"]
    for r in docs.collect():
        total[r["doc_id"]] += n_tokens(r["text"])
    assert pieces == total


def test_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), SMALL)
        assert out.collect() == [] and (name == "packing" or out.columns == empty(spark).columns)
