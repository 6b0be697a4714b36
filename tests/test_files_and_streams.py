from __future__ import annotations

import gzip
import itertools
import json
import os
import tracemalloc
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilscan.functions import paths
from veilscan.operators import correlation, findings
from veilscan.plans import catalogue, folders
from veilscan.sinks.store import Bus, Store
from veilscan.sources import files, sysmon, tokens
from veilscan.streaming import alerts


@pytest.mark.parametrize(
    ("path", "decision"),
    [
        ("/h/a.txt", "scan"), ("/h/.env", "scan"), ("/h/.env.local", "unsupported_extension"), ("/h/config", "scan"), ("/h/A.JSON", "scan"), ("/h/id_rsa", "unsupported_extension"), ("/h/x.log", "excluded"),
        ("/h/x.evtx", "excluded"), ("/h/node_modules/a.txt", "excluded"), ("/h/Downloads/x.dmg/a.txt", "excluded"), ("/h/My.app/a.txt", "excluded"), ("C:\\Windows\\a.txt", "excluded"), ("/h/$a", "excluded"), ("/h/yarn.lock", "excluded"),
    ],
)
def test_scan_decision(spark, path, decision):
    assert spark.createDataFrame([(path,)], "p string").select(paths.scan_decision(F.col("p")).alias("d")).first()["d"] == decision


def test_walk_lists_hidden_files_and_prunes(spark):
    home = folders.made_folder(spark)
    listed = {os.path.relpath(r["path"], home): r for r in files.list_files(spark, [home]).collect()}
    assert ".env" in listed and "deep/er/settings.yaml" in listed and not any("node_modules" in p for p in listed)
    assert listed["people.db"]["table_names"] == ["notes", "people"]
    chosen = {os.path.relpath(r["path"], home): r["parser"] for r in files.eligible(files.list_files(spark, [home])).collect()}
    assert chosen == {"notes.txt": "text_parser", ".env": "text_parser", "app/config": "text_parser", "deep/er/settings.yaml": "text_parser", "people.db": "sqlite_parser"}


def test_whole_scan(spark):
    found = {(r["file_path"], r["entity_type"]) for r in folders.scanned(spark).collect()}
    assert {("~/notes.txt", "PASSWORD"), ("~/.env", "AWS_ACCESS_KEY"), ("~/app/config", "CREDIT_CARD"), ("~/people.db", "PAN_CARD"), ("~/people.db", "RECOVERY_CODE"), ("~/deep/er/settings.yaml", "HIGH_ENTROPY_SECRET")} <= found


def test_text_decoding():
    assert files.decode_text("é".encode()) == ("é", "utf-8")
    assert files.decode_text("é".encode("utf-16")) == ("é", "utf-16")
    assert files.decode_text(b"caf\xe9")[0] == "café"
    assert files.decode_text(b"\x81")[1] == "latin-1"
    assert files.decode_text(b"") == ("", "utf-8")


def test_store_is_idempotent_and_grows_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("findings").count() == 0
    cands = spark.createDataFrame([("regex", "r", "EMAIL", "MEDIUM_SENSITIVE", "a@b.com", "mail a@b.com", 65, 0.65, False, 5, 12)], "detector string, rule_name string, entity_type string, category string, raw_value string, context string, confidence_score int, confidence double, requires_validation boolean, start int, end int").withColumn("file_path", F.lit("/x"))
    rows = findings.to_findings(cands, mask_context=True)
    assert rows.first()["context"] == "mail a@b.*om"
    store.append("findings", rows)
    store.append("findings", rows.withColumn("extra", F.lit(1)))
    store.append("findings", rows.withColumn("event_id", F.lit("other")).withColumn("extra", F.lit(1)))
    assert store.read("findings").count() == 2 and "extra" in store.read("findings").columns


def test_bus_isolates_failures(spark):
    told = []
    bus = Bus()
    bus.subscribe("t", lambda df: 1 / 0)
    bus.subscribe("t", lambda df: told.append(df.count()))
    assert bus.publish("t", spark.range(3)) == 1 and told == [3]
    assert bus.publish("unknown", spark.range(3)) == 0


def test_sysmon_xml(spark):
    xml = "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>11</EventID><TimeCreated SystemTime='{}'/></System><EventData><Data Name='TargetFilename'>C:\\h\\a.txt</Data><Data Name='Image'>C:\\bin\\x.exe</Data><Data Name='ProcessId'>7</Data><Data Name='User'>me</Data></EventData></Event>"
    times = ["2024-01-01T00:00:01.1234567Z", "2024-01-01T00:00:01Z", "2024-01-01T00:00:01.123Z", "bad"]
    rows = sysmon.parse_events(spark.createDataFrame([(xml.format(t),) for t in times], "xml string")).collect()
    assert [r["system_time"] for r in rows] == [datetime(2024, 1, 1, 0, 0, 1, 123456), datetime(2024, 1, 1, 0, 0, 1)]
    assert (rows[0]["event_id"], rows[0]["process_id"], rows[0]["target_filename"], rows[0]["command_line"]) == (11, 7, "C:\\h\\a.txt", None)


def test_sysmon_xml_equals_xpath(spark):
    when = "<TimeCreated SystemTime='2024-01-01T00:00:01Z'/>"
    odd = [
        f"<Event>{when}<EventID Qualifiers='1'> 11 </EventID><Data Name='User'>a&amp;b &#x41;<![CDATA[<c>]]><!-- d -->e<b>f<Data Name='Image'>g</Data></b>h</Data></Event>",
        f"<Event><x><TimeCreated/><TimeCreated Other='1'/>{when}<TimeCreated SystemTime='bad'/></x><EventID>x</EventID><EventID>4</EventID><Data Name='User'/><Data Name='User'>second</Data></Event>",
        f"<?xml version='1.0' encoding='UTF-16'?>\n<a:Event xmlns:a='urn:a'><a:EventID>5</a:EventID>{when}<a:Data Name='CommandLine'>\u00e9\U0001f600\r\n\tz</a:Data><q:Data Name='Image'> </q:Data></a:Event>",
        f"<Event>{when}<Data name='User'>no</Data><Data Name='Other'>no</Data><data Name='User'>no</data><Data>no</Data><Data Name='EventID'>9</Data><Data Name='ProcessId'>7.5</Data></Event>",
        f"<!DOCTYPE Event [<!ENTITY e 'told'>]><Event>{when}<Data Name='TargetFilename'>&e;</Data><Data Name='ProcessId'> 12 </Data><EventID>99999999999</EventID></Event>",
        f"<Event>{when}<Data Name='User'>{'long ' * 50_000}</Data><EventID>1<EventID>2</EventID></EventID></Event>",
        "<Event><TimeCreated SystemTime='2024-01-01T00:00:01.123Z'/></Event>", "<Event/>", "", None,
    ]
    df = spark.createDataFrame([(x,) for x in odd], "xml string")
    node = lambda path: F.xpath_string("xml", F.lit(path))
    told = {name: node(f"//*[local-name()='Data'][@Name='{name}']") for name in ("TargetFilename", "CommandLine", "Image", "ProcessId", "User")}
    told = [F.when(x.isNotNull() & (x != ""), x) for x in told.values()]
    expected = df.select(sysmon.system_time(node("//*[local-name()='TimeCreated']/@SystemTime")).alias("t"), node("//*[local-name()='EventID']").try_cast("int"), *told[:3], told[3].try_cast("int"), told[4]).where("t is not null")
    assert sorted(map(str, map(tuple, sysmon.parse_events(df).collect()))) == sorted(map(str, map(tuple, expected.collect()))) and expected.count() == 6
    with pytest.raises(Exception, match="ExpatError"):
        sysmon.parse_events(spark.createDataFrame([("<Event>",)], "xml string")).collect()


def test_log_xml_is_parsed_once_and_on_all_cores(spark):
    """The test of the time was pushed below the exchange before, to the scan's one split, and each column parsed the text anew."""
    plan = catalogue.queries()["log_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "XPath" not in plan and plan.count("MapInArrow") == 1
    assert "Filter isnotnull" in plan and "Filter isnotnull" not in plan[plan.index("Exchange") :]


def _at(second: float) -> datetime:
    return datetime(2024, 1, 1, 0, 0, int(second), int(second % 1 * 1e6))


def test_correlation_prefers_newest_target_then_oldest_command(spark):
    alert = spark.createDataFrame([(1, _at(20), "/h/a.txt"), (2, _at(50), "/h/b.txt"), (3, _at(40), "/h/none")], "alert_id long, event_time timestamp, path string")
    log = spark.createDataFrame(
        [
            (_at(15), 1, "/h/a.txt", "", "/b/old", 1, "u"), (_at(24), 1, "C:/h/a.txt", "", "/b/new", 2, "u"), (_at(25.000001), 1, "/h/a.txt", "", "/b/late", 3, "u"), (_at(20), 1, "", "cat /h/a.txt", "/b/cmd", 4, "u"),
            (_at(46), 1, "", "cat /h/b.txt", "/b/first", 5, "u"), (_at(52), 1, None, "cat \\h\\B.txt", "/b/second", 6, "u"),
        ],
        "system_time timestamp, event_id int, target_filename string, command_line string, image string, process_id int, user string",
    )
    rows = {r["alert_id"]: r for r in correlation.nearest_in_time(alert, log).collect()}
    assert [rows[k]["process_name"] for k in (1, 2, 3)] == ["new", "first", "UNKNOWN"]
    table = spark.createDataFrame([(9, "later", "/x", "o", ["/h/none"]), (4, "p", None, "o", ["/h/none", "/h/a.txt"])], "pid int, name string, exe string, username string, open_files array<string>")
    rows = {r["alert_id"]: r for r in correlation.fall_back(correlation.nearest_in_time(alert, log), table).collect()}
    assert (rows[3]["process_id"], rows[3]["process_path"], rows[3]["attribution_source"]) == (4, "UNKNOWN", "FALLBACK")
    assert rows[1]["attribution_source"] == "SYSMON"


def test_deploy_never_overwrites(tmp_path):
    first = tokens.deploy(str(tmp_path), 1)
    assert len(first) == 6 and not tokens.deploy(str(tmp_path), 2)
    assert all(open(t["path"], encoding="utf-8").read() == t["content"] for t in first)
    assert tokens.make_tokens("/h", 1) == tokens.make_tokens("/h", 1) != tokens.make_tokens("/h", 2)


def test_manifest_round_trip(spark, tmp_path):
    made = tokens.manifest(spark, tokens.make_tokens("/h", 1))
    path = str(tmp_path / "m")
    assert tokens.read_manifest(spark, path, "k").count() == 0
    tokens.write_manifest(made, path, "k")
    assert {r["path"] for r in tokens.read_manifest(spark, path, "k").collect()} == {r["path"] for r in made.collect()}
    assert tokens.read_manifest(spark, path, "wrong").count() == 0


def test_synthetic_tokens_are_found(spark):
    from veilscan.operators import detect

    made = tokens.synthetic_tokens(spark, 90, seed=3)
    rows = made.collect()
    assert {r["token_type"] for r in rows} == set(tokens.TEMPLATES)
    assert all(r["content"] == tokens.content(r["token_type"], 3, r["token_no"]) for r in rows)
    found = detect.detect_regex(made, ["token_no", "token_type"], content="content", path=None)
    by_kind = {r["token_type"]: r["n"] for r in found.groupBy("token_type").agg(F.countDistinct("token_no").alias("n")).collect()}
    expected = ("AWS_ACCESS_KEY", "GITHUB_TOKEN", "STRIPE_KEY", "ENV_FILE", "SSH_PRIVATE_KEY", "JSON_CREDENTIALS", "MIXED_API_KEYS", "CONFIG_INI")
    assert {k: by_kind.get(k) for k in expected} == dict.fromkeys(expected, 10)


def test_stream_of_alerts_is_idempotent(spark, tmp_path):
    made = tokens.make_tokens("/h", 3)
    (tmp_path / "in").mkdir()
    rows = [{"event_time": "2024-01-01T00:00:00", "kind": "moved", "src_path": made[0]["path"], "dest_path": made[1]["path"], "is_directory": False}, {"event_time": "2024-01-01T00:00:01", "kind": "opened", "src_path": made[2]["path"], "is_directory": True}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    store, told = Store(spark, str(tmp_path / "store")), []
    bus = Bus()
    bus.subscribe(alerts.TOPIC, lambda df: told.append(df.count()))
    for checkpoint in ("c1", "c2"):  # a second run from scratch sees the same events again
        alerts.start(alerts.file_events(spark, str(tmp_path / "in")), tokens.manifest(spark, made), store, bus, str(tmp_path / checkpoint), available_now=True).awaitTermination()
    found = store.read("honeycomb_alerts").orderBy("event_type").collect()
    assert [(r["event_type"], r["incident_type"], r["severity"]) for r in found] == [("moved", "TOKEN_ACCESSED", "CRITICAL"), ("moved_to", "TOKEN_ACCESSED", "CRITICAL")]
    assert told == [2, 2]


def test_each_event_is_an_alert_of_its_own(spark, tmp_path):
    made = tokens.make_tokens("/h", 3)
    (tmp_path / "in").mkdir()
    event = {"event_time": "2024-01-01T00:00:00", "kind": "modified", "src_path": made[0]["path"], "is_directory": False}
    rows = [event, event, event | {"event_id": "a"}, event | {"event_id": "b"}, event | {"event_id": "a"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    store = Store(spark, str(tmp_path / "store"))
    for checkpoint in ("c1", "c2"):
        alerts.start(alerts.file_events(spark, str(tmp_path / "in")), tokens.manifest(spark, made), store, Bus(), str(tmp_path / checkpoint), available_now=True).awaitTermination()
    assert store.read("honeycomb_alerts").count() == 4  # two without an id, a and b


def test_store_adds_rows_once_and_reads_only_folders_of_the_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    made = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit("x").alias("detector"))
    assert store.append("findings", made).count() == 400 and store.append("findings", made.limit(20)).count() == 0
    more = made.limit(3).unionAll(spark.createDataFrame([("00" + "e" * 62, "y"), ("1e" + "0" * 62, "y")], "event_id string, detector string"))
    assert {r["detector"] for r in store.append("findings", more).collect()} == {"y"}
    assert store.read("findings").count() == 402 and store.read("honeycomb_alerts").count() == 0
    assert len(os.listdir(tmp_path / "s/findings")) > 100
    broken = tmp_path / "s/honeycomb_alerts/id_digits=x00"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet"):  # what can't be read is no empty table
        store.read("honeycomb_alerts").count()


@pytest.mark.parametrize("limit", [2_000, 1])
def test_interval_join_has_the_same_result_with_and_without_named_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(correlation, "NAMED_PATHS", limit)
    alert = spark.createDataFrame([(k, _at(k), f"/h/{k % 7}.txt") for k in range(20, 50)], "alert_id long, event_time timestamp, path string")
    log = spark.createDataFrame([(_at(k + 0.5), 1, f"/h/{k % 5}.txt", f"cat /H/{k % 3}.txt /h/6.txt", f"/b/{k}", k, "u") for k in range(15, 55)], "system_time timestamp, event_id int, target_filename string, command_line string, image string, process_id int, user string")
    got = {r["alert_id"]: r["process_id"] for r in correlation.nearest_in_time(alert, log).collect()}
    for k in range(20, 50):
        near = [n for n in range(15, 55) if abs(n + 0.5 - k) <= 5]
        target, command = [n for n in near if n % 5 == k % 7], [n for n in near if k % 7 in (n % 3, 6)]
        assert got[k] == (max(target) if target else min(command) if command else None)


def test_pruning_equals_the_policy(spark):
    """The walker's own test of a path and the policy's column agree."""
    names = ("a", "node_modules", ".git", "x.app", "Downloads", "s.dmg", "$r", "System Volume Information", "yarn.lock", "google", "chrome", "Chromium", "library", "caches", "code cache", "Windows", "c:", "x.log")
    paths_ = ["/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n)]
    rows = spark.createDataFrame([(p,) for p in paths_], "p string").select("p", paths.is_excluded(F.col("p")).alias("x")).collect()
    assert all(files.plain_excluded(r["p"]) == r["x"] for r in rows) and len({r["x"] for r in rows}) == 2


def test_deep_folders_are_shared_out(spark, tmp_path, monkeypatch):
    for i in range(6):
        deep = tmp_path / "only/way" / f"d{i}" / "e"
        deep.mkdir(parents=True)
        (deep / "a.txt").write_text("x")
        (deep.parent / "b.txt").write_text("x")
    monkeypatch.setattr(files, "PARTITIONS", 8)
    reader = files._FilesReader({"roots": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) >= 8 and sorted(row[0] for p in parts for row in reader.read(p)) == sorted(str(p) for p in tmp_path.rglob("*.txt"))


def test_gzip_streams_are_unpacked_up_to_the_limit(spark, monkeypatch):
    monkeypatch.setattr(files.R, "MAX_FILE_BYTES", 1_000)
    data = b"head" + gzip.compress(b"a" * 5_000_000)
    df = spark.createDataFrame([(1, data), (2, None)], "id int, data binary")
    # the limit holds in this process; workers read the rule anew
    made = files.gzip_variants(df, "id", "data")
    assert {r["id"] for r in made.collect()} == {1}


def test_gzip_workers_hold_few_texts_at_once(spark, monkeypatch):
    """All texts of a batch were held before."""
    df = spark.createDataFrame([(1, b"")], "id long, data binary")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: fn)
    run = files.gzip_variants(df, "id", "data")
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array([gzip.compress(b"a" * 50_000)] * 1_000, pa.binary())], names=["id", "data"])
    tracemalloc.start()
    ids = [i for part in run(iter([batch])) for i in part.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(1_000)) and peak < 10_000_000


def test_gzip_streams_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 7)
    df = spark.createDataFrame([(1, b"")], "id string, data binary")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: fn)
    one, two = gzip.compress(b"first text"), gzip.compress("zwölf".encode())
    rows = {"both": one + b"between" + two, "cut": two[:-9], "broken": one[:12] + b"\xff" * 9 + one[21:], "no": b"\x1f\x8b", "null": None, "binary": gzip.compress(bytes(range(32)))}
    batch = pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array(list(rows.values()), pa.binary())], names=["id", "data"])
    found = [tuple(r.values()) for part in files.gzip_variants(df, "id", "data")(iter([batch])) for r in part.to_pylist()]
    assert found[:2] == [("both", "first text"), ("both", "zwölf")] and {k for k, _ in found} <= {"both", "cut"}


def test_stream_stream_correlation(spark, tmp_path):
    for name, rows in {"t": [{"event_time": "2024-01-01T00:00:10Z", "path": "/h/a"}], "l": [{"system_time": "2024-01-01T00:00:14Z", "target_filename": "/h/a", "process_id": 1}, {"system_time": "2024-01-01T00:00:16Z", "target_filename": "/h/a", "process_id": 2}]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(map(json.dumps, rows)))
    touched = spark.readStream.schema("event_time timestamp, path string").json(str(tmp_path / "t"))
    log = spark.readStream.schema("system_time timestamp, target_filename string, command_line string, process_id int").json(str(tmp_path / "l"))
    query = alerts.correlated(touched, log).writeStream.format("memory").queryName("near").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["process_id"] for r in spark.sql("select * from near").collect()] == [1]


def test_nested_roots(spark):
    df = spark.createDataFrame([(p,) for p in ("/a", "/a/b", "/ab", "/c/d", "/c/d", "/c/d/e/f")], "path string")
    assert sorted(r["root"] for r in findings.outermost_roots(df).collect()) == ["/a", "/ab", "/c/d"]
