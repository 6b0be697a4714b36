from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import SMALL, clashing, table
from veilscan.llm import registry, url_filter


def brute(url, rules):
    host, path = url_filter.split_url(url)
    best = None
    for verdict, text in rules:
        h, p = text.split("/", 1) if "/" in text else (text, None)
        if (host == h or host.endswith("." + h)) and path.startswith("" if p is None else "/" + p) and (best is None or (len(text), len(h)) > (len(best[1]), len(best[1].split("/")[0]))):
            best = verdict, text
    return best


def test_split():
    assert url_filter.split_url("HTTP://A.Example.ORG/P/q?x#y") == ("a.example.org", "/P/q")
    assert url_filter.split_url("x://host?q") == ("host", "") and url_filter.split_url("x://h#f/g") == ("h", "")
    assert url_filter.split_url("no scheme/a") == url_filter.split_url(None) == url_filter.split_url("") == ("", "")
    assert url_filter.split_url("a://b://c/d") == ("b:", "//c/d")


def judged(spark, urls, rules, blocked=()):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [(r["rule"], r["verdict"], r["listed"]) for r in sorted(url_filter.judge(rows, rules, blocked).collect(), key=lambda r: r["page_id"])]


def test_index_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FILE_ENTRIES", 12)  # several files
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "com", "b.com", "x.b.com"]
    rules = list({f"{rng.choice(hosts)}/{''.join(rng.choices('ab/', k=rng.randrange(4)))}": rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(v, t) for t, v in rules] + [("block", "bare.net")]
    urls = [f"http://{rng.choice(['', 'm.', 'ww.'])}{rng.choice([*hosts, 'xorg', 'bare.net', 'q.bare.net'])}{rng.choice(['', '/'])}{''.join(rng.choices('ab/', k=rng.randrange(6)))}" for _ in range(800)]
    truth = [brute(u, rules) for u in urls]
    assert [r and (v, r) for r, v, _ in judged(spark, urls, rules)] == truth
    as_table = spark.createDataFrame([*rules, ("zzz", rules[0][1]), (None, "org/"), ("block", None)], "value string, text string")
    assert [r and (v, r) for r, v, _ in judged(spark, urls, as_table)] == truth


def test_keys_are_sparks_own(spark):
    texts = ["Eorg/", "Lä.example", "", "E" + "x" * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.xxhash64("t").alias("h")).collect()
    assert all(np.uint64(url_filter.key("", texts[r["i"]])).view(np.int64) == r["h"] for r in rows)


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "key", lambda kind, text: len(text) % 3)
    stored = sorted((len(t) % 3, k + t, v) for k, t, v in [("E", "aa/x", "block"), ("E", "bb/x", "allow"), ("E", "cc/", "block"), ("L", "aa", "2"), ("L", "bb", "2"), ("L", "cc", "1")])
    (tmp_path / "i").write_bytes(b"".join(url_filter.file_bytes(np.array([k for k, _, _ in stored]), [f"{t}\0{v}".encode() for _, t, v in stored])))
    index = url_filter.DigestIndex([str(tmp_path / "i")])
    assert index.longest([("aa", "/xy"), ("bb", "/x"), ("dd", "/x"), ("z.cc", "/")]) == [("aa/x", "block"), ("bb/x", "allow"), None, ("cc/", "block")]


def test_empty_lists_and_very_long_urls(spark):
    long = "http://" + "a." * 3_000 + "org/" + "p/" * 20_000
    assert judged(spark, ["http://a/", long, None], []) == [(None, "allow", None)] * 3
    assert judged(spark, [long], [("block", "a.org/p/p/")], ["org"]) == [("a.org/p/p/", "block", None)]


def test_million_entries_from_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "FILE_ENTRIES", 300_000)
    hosts = spark.range(1_000_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.net")).alias("value"))
    hosts.unionAll(spark.createDataFrame([("# a remark",), ("",), ("top.org/p",)], "value string")).write.text(str(tmp_path / "list"))
    urls = ["http://h7.example.net/x", "http://www.h999999.example.net", "http://h1000000.example.net/", "http://top.org/pq", "http://top.org/q"]
    found = judged(spark, urls, [], url_filter.read_hosts(spark, str(tmp_path / "list")))
    assert found == [(None, "block", "h7.example.net"), (None, "block", "h999999.example.net"), (None, "allow", None), (None, "block", "top.org/p"), (None, "allow", None)]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "https://spam-farm.example.net/x", "h"), (3, "https://spam-farm.example.net/x", "h"), (None, "http://a.example.org/es/1", None), (5, "x", "y")], "page_id long, url string, html string")
    pages = clashing(pages).selectExpr("*", "2 as verdict", "'z' as listed")
    rows = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert rows == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "spam-farm.example.net", "/x", None, "block"), (None, "a.example.org", "/es/1", "example.org/es/", "block"), (5, "", "", None, "allow")}
    assert url_filter.judge(pages.where("false")).count() == 0


def test_query(spark):
    rows = registry.op2_url_filter(spark, SMALL).collect()
    urls = {r["page_id"]: r["url"] for r in table(spark, "pages").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        best = brute(urls[r["page_id"]], url_filter.RULES)
        assert r["rule"] == (best and best[1]) and (best is None or r["verdict"] == best[0])
