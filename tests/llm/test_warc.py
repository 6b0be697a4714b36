from __future__ import annotations

import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import SMALL, table
from veilscan.llm import registry, warc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700))
def test_chunked_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("data", [b"", b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"zz\r\n"])
def test_broken_chunks_are_reported(data):
    with pytest.raises(ValueError):
        warc.dechunked(data)


def test_records_parse_and_members_unpack():
    made = list(warc.records(7, "http://a/b c", b"x" * 100, None, None, "0/1", segment=64))
    packed = b"".join(map(warc.member, made))
    assert list(warc.unpacked(io.BytesIO(packed), 10)) == made
    heads = [warc.parsed(r)[0] for r in made]
    assert [h["warc-type"] for h in heads] == ["response"] + ["continuation"] * (len(made) - 1)
    assert [h["warc-segment-number"] for h in heads] == [str(k) for k in range(1, len(made) + 1)]
    assert heads[-1]["warc-segment-total-length"] == str(sum(len(warc.parsed(r)[1]) for r in made))
    assert len({h["warc-record-id"] for h in heads}) == len(made)
    with pytest.raises(ValueError):
        list(warc.unpacked(io.BytesIO(packed[:-5])))


def test_round_trip_of_odd_rows(spark):
    long = "é<p>" * 40_000
    same = "s" * 1000
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (4, "u", same), (5, "u", same), (6, "u", same), (6, "u", same), (7, "u\r\nX: y", "s" * 999), (8, "u", "s" * 999), (None, "u", "abc"), (9, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("refers_to", F.lit(3)).repartition(3)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["problem"]) for r in warc.round_trip(pages).collect())
    expected = sorted((i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i in (4, 5) else "response", 6 if i in (4, 5) else None, None) for i, _, h in rows)
    assert got == expected
    bodies = {r["page_id"]: r["payload"] for r in warc.round_trip(pages).collect()}
    assert bodies[3].decode() == long and bodies[4] is None and bodies[9] == b"a\r\n\r\nb"
    assert warc.round_trip(pages.where("false")).count() == 0


def test_small_archives_spread_segments(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * (i * 9_000)) for i in range(12)], "page_id long, url string, html string")
    paths = warc.write_archives(warc.decided(pages), f"file://{tmp_path}", archive=200).collect()
    assert len(paths) > 12
    again = warc.decoded(warc.reassembled(warc.read_parts(spark.createDataFrame(paths), f"file://{tmp_path}"))).collect()
    assert sorted((r["page_id"], len(r["payload"]), r["problem"]) for r in again) == [(i, i * 9_000, None) for i in range(12)]


def test_missing_segments_are_reported(spark):
    part = lambda n, block, total: ("r", "r", n, total, "response", 1, "u", None, None, block)
    cases = {"gap": [part(1, b"a", None), part(3, b"c", 3)], "no end": [part(1, b"a", None), part(2, b"b", None)], "length": [part(1, b"a", None), part(2, b"b", 9)]}
    for name, rows in cases.items():
        (got,) = warc.reassembled(spark.createDataFrame([(r[0], *r[1:]) for r in rows], warc.PART_SCHEMA)).collect()
        assert got["problem"], name


def test_query_equals_brute_force(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, "pages").collect()}
    rows = registry.op3_warc(spark, SMALL).collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows} == {(i, len(b), hashlib.sha1(b).hexdigest()) for i, b in pages.items()}
