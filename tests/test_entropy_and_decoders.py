from __future__ import annotations

import base64
import codecs
import math
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from veilscan.functions import decoders, entropy
from veilscan.operators import detect
from veilscan.plans import fixtures


def test_entropy_findings(spark):
    rows = ["api_key = Zx9Kq3LmT7vBn2RwYp5HsDf8GjCe4UaWoXi6", "secret_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "token = 0123456789abcdef0123456789abcdef01234567", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    found = detect.detect_entropy(df, ["id"]).collect()
    assert [(r["id"], r["raw_value"], r["confidence_score"]) for r in found] == [(0, "Zx9Kq3LmT7vBn2RwYp5HsDf8GjCe4UaWoXi6", 60)]


def test_assets_beside_a_token(spark):
    token = "Abcdefgh12345678X"
    cases = {
        f"{token}.js": True, f"{token} \t.PNG": True, f".css {token}": True, f"a.map\u00a0\n{token}": True, f"{token.upper()} .svg": True,
        f"Abcdefgh1234 5678X.js key = {token}": False, f"{token} x.js": False, f"{token}js": False, f".js x {token}": False, token: False,
    }
    rows = spark.createDataFrame([(token, c) for c in cases], "t string, c string").select("c", entropy.is_beside_asset(F.col("t"), F.col("c")).alias("x")).collect()
    assert {r["c"]: r["x"] for r in rows} == cases
    extensions = "|".join(re.escape(e) for e in (".js", ".css", ".woff", ".woff2", ".png", ".jpg", ".jpeg", ".svg", ".map"))
    assert all(bool(re.search(rf"(?i){token}\s*(?:{extensions})|(?:{extensions})\s*{token}", c)) == x for c, x in cases.items())


def test_a_token_is_reported_once(spark):
    line = "api_key = Zx9Kq3LmT7vBn2RwYp5HsDf8GjCe4UaWoXi6\n"
    df = spark.createDataFrame([(0, line * 3)], "id int, text string")
    assert [r["start"] for r in detect.detect_entropy(df, ["id"]).collect()] == [10]


def test_tokens_and_entropy_equal_pythons(spark):
    texts = [fixtures.PLANTED[14] + "é 'quoted=value' (Abc123Abc123Abc123xyz),\x1cnext: tail", "", "😀" * 20 + " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", F.explode_outer(entropy.tokens(F.col("text"), all_lengths=True)).alias("t")).where("t is not null").select("id", "t.*", F.round(entropy.shannon(F.col("t.value")), 9).alias("h")).collect()
    expected = set()
    for i, t in enumerate(texts):
        for m in re.finditer(r"""[^\s"'=:]+""", t):
            v = m.group()
            expected.add((i, m.start(), m.end(), v, round(-sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()), 9)))
    got = {(r["id"], r["start"], r["end"], r["value"], abs(r["h"])) for r in rows}
    assert got == {(*e[:4], abs(e[4])) for e in expected}


def test_tokens_are_counted_without_those_accepted_before(spark):
    line = "api_key = Zx9Kq3LmT7vBn2RwYp5HsDf8GjCe4UaWoXi6\n"
    texts = [line * 3 + "(Zx9Kq3LmT7vBn2RwYp5HsDf8GjCe4UaWoXi6)", "... a.b (c) ?! 'q..' x=.,: \u3000é\x1c<!>", "", None, "Zx9Kq3LmT7vBn2RwYp5HsDf8GjCe4UaWoXi6 " + " pad" * 60 + "\n" + line * 2, "😀.. ..😀 .;" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    stripped = lambda t: [(m.start(), m.group().strip(".,;()[]{}!<>?'\"")) for m in re.finditer(r"""[^\s"'=:]+""", t or "")]
    assert [r["n"] or 0 for r in df.select(entropy.token_count(F.col("text")).alias("n")).collect()] == [sum(v != "" for _, v in stripped(t)) for t in texts]
    firsts = [{r["raw_value"]: r["start"] for r in detect.detect_entropy(df.where(F.col("text") == t), [], content="text").collect()} for t in texts]
    expected = sum(v != "" and not (v in first and at > first[v]) for t, first in zip(texts, firsts, strict=True) for at, v in stripped(t))
    counters = {r["counter"]: r["n"] for r in detect.run_counters(df).collect()}
    assert (counters["entropy_candidates_checked"], counters["entropy_accepted"]) == (expected, sum(map(len, firsts))) and any(firsts)


def test_texts_of_very_many_tokens_take_no_square_of_their_number(spark):
    """Appending one by one copied all tokens before: minutes for a text like this one."""
    n = 150_000
    df = spark.createDataFrame([("ab " * n,)], "text string")
    detect.run_counters(df.limit(0)).collect()  # planning is not measured
    began = time.perf_counter()
    assert {r["counter"]: r["n"] for r in detect.run_counters(df).collect()}["entropy_candidates_checked"] == n
    last = df.select(entropy.tokens(F.col("text"), all_lengths=True).alias("t")).select(F.size("t"), F.element_at("t", -1)["start"]).collect()[0]
    assert tuple(last) == (n, 3 * n - 3) and time.perf_counter() - began < 60


def test_decoders(spark):
    secret = "password = hunter22"
    rows = [base64.b64encode(secret.encode()).decode(), secret.encode().hex(), "password%20%3D%20hunter2 + 100%", "rot13 " + codecs.encode(secret, "rot13"), "nothing here", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    found = {}
    for r in detect.decode_variants(df, ["id"]).collect():
        found.setdefault(r["id"], []).append(r["variant"])
    assert found[0] == [secret] and secret in found[1]
    assert found[2] == ["password = hunter2 + 100%"]
    assert found[3] == ["ebg13 " + secret]
    assert 4 not in found and 5 not in found


def test_findings_in_variants(spark):
    df = spark.createDataFrame([(0, "blob cGFzc3dvcmQgPSBodW50ZXIyMg== end")], "id int, text string")
    compat = [(r["entity_type"], r["raw_value"]) for r in detect.detect(df, ["id"]).collect()]
    assert ("PASSWORD", "password = hunter22") in compat
    assert [(r["entity_type"]) for r in detect.detect(df, ["id"], mode="strict").collect()].count("PASSWORD") == 1


def test_printable_share(spark):
    df = spark.createDataFrame([("abc\n",), ("\x00\x01ab",), ("",)], "t string").select(decoders.printable_share(F.col("t")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1.0, 0.5, 0.0]
