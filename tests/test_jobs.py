from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilscan.__main__ import main
from veilscan.operators import detect
from veilscan.plans import folders, jobs
from veilscan.rules import HIGH, Rule
from veilscan.sinks.store import Bus, Store


def test_scan_job_is_repeatable(spark, tmp_path):
    home, store, told = folders.made_folder(spark), Store(spark, str(tmp_path)), []
    bus = Bus()
    bus.subscribe(jobs.FINDING_TOPIC, lambda df: told.append(df.count()))
    first = jobs.scan(spark, [home], store, bus)
    assert first.outcomes == {"scanned": 5, "excluded": 2, "unsupported_extension": 1}
    n = first.findings.count()
    assert n and store.read("findings").count() == n
    with open(f"{home}/more.txt", "w") as f:
        f.write("call mobile: 9876543210\n")
    again = jobs.scan(spark, [home], store, bus)
    assert again.findings.count() == 1 and told == [n, 1] and store.read("findings").count() == n + 1


def test_honeytokens_are_left_out(spark, tmp_path):
    home = str(tmp_path / "h")
    made = jobs.deploy(spark, home, 1, str(tmp_path / "m"), "key")
    assert made.count() == 6 and jobs.deploy(spark, home, 2, str(tmp_path / "m"), "key").count() == 6
    result = jobs.scan(spark, [home], honeytokens=made)
    assert result.outcomes["honeytoken"] == 6 and result.findings.count() == 0
    assert jobs.scan(spark, [home]).findings.count() > 0


def test_rules_of_ones_own(spark):
    rule = Rule("badge", "BADGE", r"\bB-\d{4}\b", HIGH, ("badge",), validator=lambda v: F.substring(v, 3, 1) != "0")
    df = spark.createDataFrame([(1, "badge: B-1234"), (2, "badge: B-0234"), (3, "B-1234")], "id int, text string")
    assert [(r["id"], r["confidence_score"]) for r in detect.detect_regex(df, ["id"], rules=(rule,)).collect()] == [(1, 90)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("VEILSCAN_KEY", "k")
    home = folders.made_folder(spark)
    assert main(["scan", "--store", str(tmp_path / "s"), home]) == 0
    assert "scanned: 5" in capsys.readouterr().out
    assert main(["deploy", "--home", str(tmp_path / "h"), "--manifest", str(tmp_path / "m")]) == 0
    (tmp_path / "e").mkdir()
    (tmp_path / "e/1.json").write_text(json.dumps({"event_time": "2024-01-01T00:00:00Z", "kind": "opened", "src_path": f"{tmp_path}/h/Desktop/.env", "is_directory": False}))
    assert main(["watch", "--events", str(tmp_path / "e"), "--store", str(tmp_path / "s"), "--checkpoint", str(tmp_path / "c"), "--manifest", str(tmp_path / "m"), "--once"]) == 0
    assert [r["incident_type"] for r in Store(spark, str(tmp_path / "s")).read("honeycomb_alerts").collect()] == ["FILE_OPEN"]
