"""Readers on hand-made files, malformed input, round trips and known rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracefp.functions.requests import flatten_requests, parse_event_time, request_frame
from tracefp.operators.attribution import attribute_flush_events, attribute_flushes, attribute_requests
from tracefp.plans.behaviour import interaction_session_stats
from tracefp.plans.traces import trace_temporal_stats
from tracefp.sources.logs import (read_flushes, read_interactions, read_local_windows, read_manifest,
                                  read_requests, read_run_windows)
from tracefp.sources.tables import read_features, write_features, write_trials


def record(i, ts, **http):
    return {"id": str(i), "timestamp": ts, "source_ip": "1.2.3.4", "source_port": "5", "processing_time_ms": 0.5,
            "tls": {"version": "TLS 1.3", "ja3_hash": "j", "ja4_hash": "t13d1516h2_a_b", "negotiated_protocol": "h2",
                    "cipher_suites_offered": [2570, 4865], "point_formats": "AA==", "alpn_protocols": ["h2"]},
            "http2": {"akamai_fingerprint": "1:65536;4:6291456|15663105|3:1:0:220|m,a,s,p",
                      "settings": {"1": 65536, "4": 4294967295}, "pseudo_header_order": [":method", ":path"]},
            "http": {"method": "GET", "path": "/p.html", "headers_ordered": [{"name": "Accept", "value": "*"}],
                     "headers": {"Sec-Fetch-Mode": ["navigate"], "Priority": ["u=0, i"]}, **http}}


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_read_requests(spark, tmp_path):
    no_h2 = record(2, "2026-05-02T10:00:00.5Z", sec_fetch_mode="cors")
    del no_h2["http2"]
    no_tls = record(3, "2026-05-02T06:00:01.123456789-04:00")
    del no_tls["tls"]
    root = str(tmp_path / "root")
    write(f"{root}/alpha/trial-001/requests.jsonl",
          [record(1, "2026-05-02T10:00:00.123456789Z"), "", no_h2, '{"id": "broken', no_tls])
    write(f"{root}/beta/trial-001/requests.jsonl", [record(9, "not a time")])
    df = read_requests(spark, f"{root}/*/*/requests.jsonl", root)
    assert df.count() == 4
    flat = {r["id"]: r for r in flatten_requests(df).collect()}
    assert set(flat) == {"1", "2", "3", "9"} and len(flat["1"].asDict()) == 20
    assert (flat["1"]["agent"], flat["1"]["trial"]) == ("alpha", "trial-001")
    # digits past the sixth are cut, offsets are applied, bad times are null
    assert flat["1"]["us"] % 1_000_000 == 123456 and flat["9"]["us"] is None
    assert flat["3"]["us"] - flat["1"]["us"] == 1_000_000
    assert flat["2"]["h2_fp"] is None and flat["3"]["ja3"] is None and flat["2"]["n_headers"] == 1
    wide = {r["id"]: r for r in request_frame(df).collect()}
    assert wide["1"]["sf_mode"] == "navigate" and wide["2"]["sf_mode"] == "cors"
    assert wide["1"]["priority"] == "u=0, i" and wide["3"]["ciphers"] == [] and wide["1"]["h2_order"] == ":method,:path"
    assert read_requests(spark, f"{root}/*/*/requests.jsonl", root, agents=["beta"]).count() == 1


def test_other_layouts(spark, tmp_path):
    root = str(tmp_path / "one")
    write(f"{root}/trial-007/requests.jsonl", [record(1, "2026-05-02T10:00:00Z")])
    row = read_requests(spark, f"{root}/*/requests.jsonl", root, default_agent="solo").first()
    assert (row["agent"], row["trial"]) == ("solo", "trial-007")
    flat = str(tmp_path / "flat")
    write(f"{flat}/day one.jsonl", [record(1, "2026-05-02T10:00:00Z")])
    assert read_requests(spark, f"{flat}/*.jsonl", flat).first()["trial"] == "day one"


def flush(session, events, received, seq=None, page="Subscribe · V1 Subscription Button"):
    out = {"session": session, "page": page, "batch": events, "receivedAt": received, "eventCount": len(events)}
    return out if seq is None else {**out, "flushSeq": seq, "flushReason": "hidden"}


def test_read_interactions(spark, tmp_path):
    root = str(tmp_path / "ix")
    write(f"{root}/alpha/trial-001/interactions.jsonl", [
        flush("s", [{"t": "2026-05-02T10:00:00.000Z", "ms": 1000.25, "type": "click", "x": 1, "y": 2.5}],
              "2026-05-02T10:00:05Z", 4),
        flush("s", [], "2026-05-02T10:00:06Z", 5), "{nope",
        flush("s", [{"ms": 2000, "type": "keydown", "key": "a"}, {"ms": 2001, "type": "input"}],
              "2026-05-02T10:00:07Z", page="A · B · A rather long page title that is cut off")])
    rows = read_interactions(spark, f"{root}/*/*/interactions.jsonl", root).orderBy("us").collect()
    assert [r["us"] for r in rows] == [1_000_250, 2_000_000, 2_001_000]
    assert rows[0]["page"] == "S1-subscribe-v1" and rows[1]["page"] == "A rather long page title that "
    # a flush without a number is numbered by receipt time inside its trial
    assert [r["flush_seq"] for r in rows] == [4, 2, 2] and rows[0]["x"] == 1.0


def test_numbers_only_where_they_are_missing(spark, tmp_path):
    """A log of numbered flushes, several events each, is not shuffled; one flush without
    a number counts all flushes of its trial before it."""
    def log(name, numbers):
        path = str(tmp_path / name)
        write(f"{path}/alpha/trial-001/interactions.jsonl", [
            flush("s", [{"ms": 1000 * k + j, "type": "click", "x": j} for j in range(1 + k % 3)], f"2026-05-02T10:00:0{k}Z", n)
            for k, n in enumerate(numbers)])
        return read_interactions(spark, f"{path}/*/*/interactions.jsonl", path)

    whole, gap = log("whole", [7, 8, 9, 10, 11]), log("gap", [7, 8, None, 10, None])
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    want = [(k, j) for k in range(5) for j in range(1 + k % 3)]
    for df, seqs in ((whole, [7, 8, 9, 10, 11]), (gap, [7, 8, 2, 10, 4])):
        got = sorted((r["us"], r["flush_seq"], r["id"]) for r in df.collect())
        assert got == [((1000 * k + j) * 1000, seqs[k], f"s/{seqs[k]:09d}/{j:06d}") for k, j in want]


def test_run_documents(spark, tmp_path):
    docs = {
        "alpha__trial-001__x.json": {"timestamp_utc": "2026-04-19T04:54:07.531326+00:00",
                                     "transcript": [{"timestamp_utc": "2026-04-19T04:50:00+00:00"}]},
        "beta__trial-002__x.json": {"timestamp_utc": "2026-04-19T04:54:07+00:00",
                                    "transcript": {"created_at": "datetime.datetime(2026, 4, 19, 4, 50, 1, 500000)"}},
        "gamma__trial-003__x.json": {"timestamp_utc": "2026-04-19T04:54:07+00:00",
                                     "transcript": {"history": [{"metadata": {"step_start_time": 1776574202.25}}]}},
        "delta__trial-004__x.json": {"timestamp_utc": "2026-04-19T04:54:07+00:00",
                                     "transcript": [{"started_at_utc": "2026-04-19T04:50:03Z"}]},
    }
    for name, doc in docs.items():
        write(str(tmp_path / "docs" / name), [json.dumps(doc, indent=2)])
    base = 1776574200_000000
    got = {r["agent"]: (r["trial"], r["s_us"] - base, r["e_us"] - base)
           for r in read_run_windows(spark, str(tmp_path / "docs")).collect()}
    assert got == {"alpha": ("trial-001", 0, 247_531_326), "beta": ("trial-002", 1_500_000, 247_000_000),
                   "gamma": ("trial-003", 2_250_000, 247_000_000), "delta": ("trial-004", 3_000_000, 247_000_000)}


def test_collected_run_documents(spark, tmp_path):
    """Documents of all four kinds, one a line, give what their files give."""
    docs = {"alpha__trial-001__x": {"timestamp_utc": "2026-04-19T04:54:07Z", "transcript": [{"timestamp_utc": "2026-04-19T04:50:00Z"}]},
            "beta__trial-002__x": {"timestamp_utc": "2026-04-19T04:54:07Z", "transcript": {"created_at": "datetime.datetime(2026, 4, 19, 4, 50, 1, 500000)"}},
            "gamma__trial-003__x": {"timestamp_utc": "2026-04-19T04:54:07Z", "transcript": {"history": [{"metadata": {"step_start_time": 1776574202.25}}]}},
            "delta__trial-004__x": {"transcript": [{"started_at_utc": "2026-04-19T04:50:03Z"}]}}
    for name, doc in docs.items():
        write(str(tmp_path / "files" / f"{name}.json"), [json.dumps(doc, indent=2)])
    write(str(tmp_path / "lines" / "all.jsonl"), [json.dumps({"run": name, **doc}) for name, doc in docs.items()])
    got = sorted(map(str, read_run_windows(spark, str(tmp_path / "lines"), collected=True).collect()))
    assert got == sorted(map(str, read_run_windows(spark, str(tmp_path / "files")).collect())) and len(got) == 4


def test_manifest_keeps_the_last_run(spark, tmp_path):
    path = str(tmp_path / "m.tsv")
    write(path, ["1\t2026-05-02T10:00:00Z\t2026-05-02T10:01:00Z\t1", "short\tline", "",
                 "2\t2026-05-02T10:02:00Z\t2026-05-02T10:03:00Z", "1\t2026-05-02T11:00:00Z\t2026-05-02T11:01:00Z\t0"])
    rows = {r["trial"]: r for r in read_manifest(spark, path, "crawler").collect()}
    assert set(rows) == {1, 2} and rows[1]["rc"] == "0" and rows[2]["rc"] == ""
    assert rows[1]["e_us"] - rows[1]["s_us"] == 60_000_000


def test_local_windows_in_summer_and_winter(spark, tmp_path):
    path = str(tmp_path / "w.txt")
    write(path, ["5/27 15:54 - 15:57", "12/1 14:52 – 14:53"])
    rows = read_local_windows(spark, path, "human", 2026, "America/New_York").orderBy("trial").collect()
    text = [[str(v) for v in r] for r in spark.createDataFrame(rows).select(
        "trial", F.timestamp_micros("s_us").cast("string"), F.timestamp_micros("e_us").cast("string")).collect()]
    assert text == [["trial-001", "2026-05-27 19:54:00", "2026-05-27 19:57:59"],
                    ["trial-002", "2026-12-01 19:52:00", "2026-12-01 19:53:59"]]


def test_flushes_straddling_a_window(spark):
    windows = spark.createDataFrame([("a", "t1", 100, 200), ("a", "t2", 150, 3_000)],
                                    "agent string, trial string, s_us long, e_us long")
    flushes = [("s", 1, [50, 99]), ("s", 2, [99, 100, 200]), ("s", 3, [201, 2_999]), ("s", 4, [3_001])]
    df = spark.createDataFrame(flushes, "session string, flush_seq long, times array<long>")
    want = {("t1", 2), ("t2", 2), ("t2", 3)}
    rows = attribute_flushes(df, windows).collect()
    assert len(rows) == 3 and {(r["trial"], r["flush_seq"]) for r in rows} == want
    events = df.select("session", "flush_seq", F.explode("times").alias("us"), F.lit("").alias("agent"),
                       F.lit("").alias("trial"))
    assert {(r["trial"], r["flush_seq"]) for r in attribute_flush_events(events, windows).collect()} == want
    half = attribute_requests(events, windows, closed=False)
    assert half.where("trial = 't1'").count() == 1


def test_known_rows(spark):
    base = 1_777_000_000_000_000
    two = spark.createDataFrame([("a", "t", 1, base, "GET", "/", 1.0, "", ""), ("a", "t", 2, base + 31_764, "GET", "/", 1.0, "", "")],
                                "agent string, trial string, id long, us long, method string, path string, "
                                "processing_ms double, sf_mode string, sf_dest string")
    row = trace_temporal_stats(two).first()
    assert row["req_rate_hz"] == pytest.approx(62.96436217101121, rel=1e-14) and row["duration_s"] == 0.031764
    gap = 31_956_300
    two_events = spark.createDataFrame([("a", "t", "1", base, "p", 1, "page"), ("a", "t", "2", base + gap, "p", 1, "click")],
                                       "agent string, trial string, id string, us long, page string, flush_seq long, type string")
    row = interaction_session_stats(two_events).first()
    # event times are whole microseconds, the known value has finer digits
    assert row["iei_mean_ms"] == pytest.approx(31956.2998046875, abs=1e-3) and row["n_events"] == 2


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "t1", 1.5), ("a", "t2", None), ("b", "t1", 2.0)], "agent string, trial string, v double")
    write_features(df, str(tmp_path / "f"))
    back = read_features(spark, str(tmp_path / "f")).select(*df.columns)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    write_features(df, str(tmp_path / "c"), "csv")
    assert read_features(spark, str(tmp_path / "c"), "csv").count() == 3
    write_trials(df, str(tmp_path / "t"))
    assert os.path.isdir(tmp_path / "t" / "agent=a" / "trial=t1")
    assert spark.read.json(str(tmp_path / "t")).count() == 3


def test_bad_times_are_null(spark):
    df = spark.createDataFrame([("2026-05-02T10:00:00.1Z",), ("2026-05-02T12:00:00+02:00",), ("yesterday",), (None,)], "timestamp string")
    us = [r["us"] for r in parse_event_time(df).collect()]
    assert us[0] - us[1] == 100_000 and us[2] is None and us[3] is None


def test_short_windows_meet_few_requests(spark):
    """An hour with a request a second and as many windows of 0.3 s."""
    from tracefp.operators import attribution

    windows = spark.range(3600).select(F.lit("a").alias("agent"), F.concat(F.lit("t"), "id").alias("trial"),
                                       (F.col("id") * 1_000_000 - 100_000).alias("s_us"), (F.col("id") * 1_000_000 + 200_000).alias("e_us"))
    requests = spark.range(3600).select("id", (F.col("id") * 1_000_000).alias("us"), F.lit("").alias("agent"), F.lit("").alias("trial"))
    out = attribute_requests(requests, windows)
    assert out.count() == 3600 and out.where(F.concat(F.lit("t"), "id") != F.col("trial")).count() == 0
    w = attribution._spread(windows)
    asked = requests.drop("agent", "trial").withColumn("_size", F.explode(attribution._levels(w))).withColumn(
        "_bucket", attribution._bucket(F.col("us"), F.col("_size")))
    assert asked.count() == 3600 and asked.join(w, ["_size", "_bucket"]).count() <= 2 * 3600 + 3600


def test_windows_of_all_lengths(spark):
    spans = [(0, 0), (5, 4), (-7, 9), (0, 1 << 40), (100, 101), (3, 1000), (999, 1000)]
    windows = spark.createDataFrame([("a", f"t{n}", s, e) for n, (s, e) in enumerate(spans)], "agent string, trial string, s_us long, e_us long")
    times = [-8, -7, 0, 3, 4, 5, 100, 999, 1000, 1001, 1 << 39, (1 << 40) + 1]
    requests = spark.createDataFrame([("", "", t) for t in times], "agent string, trial string, us long")
    for closed in (True, False):
        got = sorted((r.trial, r.us) for r in attribute_requests(requests, windows, closed).collect())
        assert got == sorted((f"t{n}", t) for n, (s, e) in enumerate(spans) for t in times if s <= t and (t <= e if closed else t < e) and s <= e)
    assert attribute_requests(requests, windows.limit(0)).count() == 0


def test_request_log_reads_only_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    write(path, ['{"id": "1", "http": {"method": "GET", "path": "/a", "query": "q"}}', "broken"])
    df = read_requests(spark, path).select("http.method")
    assert [r.method for r in df.collect()] == ["GET"]
    schema = df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "http:" in schema and "tls" not in schema and "source_ip" not in schema
