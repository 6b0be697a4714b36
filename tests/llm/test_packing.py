from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import MIDDLE, ODD, clashing, documents, empty, odd
from veilscan.llm import packing, registry
from veilscan.llm.packing import Example, Limits, Packer

PATH = registry.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aB é'sSre \n12.,!-İß\u00a0\x1cﬁ<|endoftext|>"), max_size=40))
def test_ids_of_any_text(library, words, text):
    assert words.encode(text).tolist() == ids(library, text)


def test_ids_where_the_library_is_asked_for_words(library):
    asked = packing.WordIds(PATH)
    assert asked.known.merge.__self__.exact
    asked.known.merge.__self__.exact = False
    text = "Ändern we'll sit 12 x... déjà-vu"
    assert asked.encode(text).tolist() == ids(library, text)


def check(pieces, wanted, limits):
    """Every id once, sequences without gaps and within all limits; the padding."""
    sequences, cover, padding = defaultdict(list), defaultdict(list), 0
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        cover[p["doc_id"]].append((p["start"], p["length"]))
        data = np.array(wanted[p["doc_id"]][p["start"] : p["start"] + p["length"]], dtype="<u4")
        assert p["ids_crc32"] == zlib.crc32(data.tobytes()) and p["length"] == len(data) > 0 and p["doc_tokens"] == len(wanted[p["doc_id"]])
    for doc, all_ids in wanted.items():
        at = 0
        for start, length in sorted(cover[doc]):
            assert start == at
            at += length
        assert at == len(all_ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(p["loss_tokens"] for p in own) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding, len(sequences)


def test_query(spark, library):
    wanted = {r["doc_id"]: [*ids(library, r["text"]), 1] for r in documents(spark, MIDDLE).collect()}
    padding, sequences = check(registry.op7_packing(spark, MIDDLE).collect(), wanted, Limits())
    assert padding == 0 and sequences <= sum(map(len, wanted.values())) / 2048 + 40


def test_loss_limits_hold(spark, library):
    docs = documents(spark).withColumn("answer_from", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 50))
    limits = Limits(tokens=512, segments=7, loss_tokens=300)
    rows = packing.pack(docs, PATH, limits, loss_from="answer_from").collect()
    wanted = {r["doc_id"]: [*ids(library, r["text"]), 1] for r in docs.collect()}
    check(rows, wanted, limits)
    firsts = {r["doc_id"]: r["answer_from"] or 0 for r in docs.collect()}
    for r in rows:
        assert r["loss_tokens"] == max(0, min(r["length"], r["start"] + r["length"] - firsts[r["doc_id"]]))


def test_conversations_under_all_three_limits(spark, library):
    """Instruction data: of each conversation only what follows its first turn bears loss."""
    turns = spark.read.parquet(f"{MIDDLE}/conversations.parquet").where("text is not null")
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).collect()
    rows = [(r["conv_id"], "\n".join(x["text"] for x in r["t"]), len(ids(library, r["t"][0]["text"]))) for r in talks]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer_from int")
    limits = Limits(tokens=1024, segments=6, loss_tokens=400)
    found = packing.pack(docs, PATH, limits, loss_from="answer_from").collect()
    check(found, {i: [*ids(library, t), 1] for i, t, _ in rows}, limits)
    full = defaultdict(lambda: [0, 0, 0])
    for r in found:
        for k, n in enumerate((r["length"], 1, r["loss_tokens"])):
            full[r["sequence_id"]][k] += n
    # each of the three limits is what closes some sequence
    assert any(t > 0.95 * 1024 for t, _, _ in full.values()) or any(n == 6 for _, n, _ in full.values())
    assert any(loss > 0.9 * 400 for _, _, loss in full.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 6), st.integers(1, 64), st.integers(1, 12))
def test_packer_places_everything(sizes, segments, loss, window):
    limits = Limits(64, segments, loss)
    packer, out = Packer(limits, window), []
    for i, n in enumerate(sizes):
        bears = np.arange(n) % 2 == 0 if i % 2 else np.ones(n, bool)
        out += packer.put(Example(i, 0, np.arange(n, dtype="<u4"), n, np.concatenate(([0], np.cumsum(bears)))))
    out += packer.finish()
    held = defaultdict(list)
    for pieces in out:
        assert pieces and len(pieces) <= segments and sum(len(p.ids) for p in pieces) <= 64 and sum(p.loss_of(len(p.ids)) for p in pieces) <= loss
        for p in pieces:
            held[p.doc] += p.ids.tolist()
    assert {i: sorted(x) for i, x in held.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_largest_dot_product_is_taken_first():
    packer = Packer(Limits(100, 10, 100), window=50)
    for i, n in enumerate((30, 60, 20, 50)):
        packer.add(Example(i, 0, np.zeros(n, "<u4"), n))
    assert [(p.doc, len(p.ids)) for p in packer.sequence(100)] == [(1, 60), (0, 30), (3, 10)]


def test_odd_rows(spark, library):
    docs = clashing(odd(spark)).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, PATH).collect()
    check(rows, {r["doc_id"]: [*ids(library, r["text"]), 1] for r in docs.collect()}, Limits())
    again = packing.pack(odd(spark), PATH).collect()
    assert sum(r["length"] for r in again) == sum(len(ids(library, t)) + 1 for _, t, *_ in ODD)
    assert packing.pack(empty(spark), PATH).count() == 0
