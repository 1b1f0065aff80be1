"""Streams over several small batches equal the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tracefp.operators.beacon import beacon_filter, beacon_flags
from tracefp.operators.sequences import checkpoint_counts, checkpoint_state, checkpoints
from tracefp.streaming import beacons, live

WEB = ("agent string, trial string, id long, us long, kind string, method string, path string, referer string, "
       "type string, page string")


def stream_rows(n=160, seed=4):
    rnd = random.Random(seed)
    us, out = 1_700_000_000_000_000, []
    for i in range(n):
        us += rnd.choice([5_000, 20_000, 300_000, 700_000])
        trial = rnd.choice(["hot", "hot", "cold"])
        kind = rnd.choice(["post", "page", "ev", "ev"])
        if kind == "ev":
            out.append(("a", trial, i, us, "interaction", None, None, None, "click", "p"))
        else:
            method, path = ("POST", "/collect") if kind == "post" else ("GET", f"/p{i % 3}.html")
            out.append(("a", trial, i, us, "request", method, path, rnd.choice(["", "https://h/p.html"]), None, None))
    return out


def batches(spark, tmp_path, data, parts=4):
    folder = str(tmp_path / "in")
    size = -(-len(data) // parts)
    for k in range(parts):
        (spark.createDataFrame(data[k * size:(k + 1) * size], WEB).coalesce(1)
         .write.mode("append").json(folder))
    return live.stream_json(spark, folder, spark.createDataFrame([], WEB).schema, max_files=1)


def finished(spark, tmp_path, stream):
    (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


BEAT = (None, None, None, 1_800_000_000_000_000, "request", "GET", "/", None, None, None)


@pytest.mark.parametrize(("slice_us", "aggressive"), [(2_000_000, False), (60_000_000, False), (2_000_000, True)])
def test_every_post_is_decided(spark, tmp_path, slice_us, aggressive):
    """A heartbeat after the last row lets the last posts be decided; it is no row of the result."""
    data = stream_rows()
    stream = batches(spark, tmp_path, [*data, BEAT]).where("kind = 'request'")
    out = beacons.stream_beacon_decisions(stream, aggressive=aggressive, delay="1 second", slice_us=slice_us, heartbeat=F.col("agent").isNull())
    got = {r["id"]: r["is_beacon"] for r in finished(spark, tmp_path, out).collect()}
    batch = beacon_flags(spark.createDataFrame(data, WEB).where("kind = 'request'"), aggressive=aggressive)
    want = {r["id"]: r["is_beacon"] for r in batch.collect()}
    assert got == want and {True, False} == set(want.values())


def test_the_filtered_stream_is_the_batch_filter(spark, tmp_path):
    """Whole rows, each once."""
    data = stream_rows(seed=9)
    stream = batches(spark, tmp_path, [*data, BEAT]).where("kind = 'request'")
    out = beacons.stream_beacon_filter(stream, delay="1 second", slice_us=2_000_000, heartbeat=F.col("agent").isNull())
    got = sorted(map(str, finished(spark, tmp_path, out).select(*stream.columns).collect()))
    want = sorted(map(str, beacon_filter(spark.createDataFrame(data, WEB).where("kind = 'request'")).select(*stream.columns).collect()))
    assert got == want and len(got) < len([r for r in data if r[4] == "request"])


@pytest.mark.parametrize("buckets", [1, 3])
def test_trials_share_the_keys_of_the_held_posts(spark, tmp_path, buckets):
    """Many trials at the same times, one without a name: each post is decided among its own
    trial's rows, and the keys do not grow with the trials."""
    data = [(r[0], None if r[2] % 41 == 0 else f"t{r[2] % 12}", *r[2:]) for r in stream_rows(240, seed=5) if r[4] == "request"]
    stream = batches(spark, tmp_path, [*data, BEAT])
    out = beacons.stream_beacon_decisions(stream, unload_ms=4000, burst_ms=2000, delay="1 second", heartbeat=F.col("agent").isNull(), buckets=buckets)
    plan = out._jdf.queryExecution().analyzed().toString()
    got = {r["id"]: r["is_beacon"] for r in finished(spark, tmp_path, out).collect()}
    posts, pages = [r for r in data if r[6] == "/collect"], [r for r in data if r[6] != "/collect"]
    want = {p[2]: any(q[1] == p[1] and 0 < q[3] - p[3] <= 4_000_000 for q in pages) and (p[7] != "" or any(
        q[1] == p[1] and q[2] != p[2] and abs(q[3] - p[3]) <= 2_000_000 for q in posts)) for p in posts}
    assert got == want and {True, False} == set(want.values())
    assert "TransformWithState" in plan and "bucket" in plan


def test_checkpoints_over_batches(spark, tmp_path):
    data = stream_rows()
    stream = batches(spark, tmp_path, data)
    (live.stream_checkpoints(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    cols = ["trial", "id", "checkpoint", "page_index", "event_index", "page_path", "n_requests", "n_int_events"]
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()))
    want = sorted(map(str, checkpoints(spark.createDataFrame(data, WEB), 3).select(*cols).collect()))
    assert got == want and len(got) > 40


CHECKPOINT = ["agent", "trial", "id", "us", "checkpoint", "page_index", "event_index", "page_path", "n_requests", "n_int_events"]


@pytest.mark.parametrize("slice_us", [1_000_000, 3_600_000_000])
def test_checkpoint_counters_on_two_levels(spark, tmp_path, slice_us):
    """Several micro-batches, a trial and a client without a name, rows of one time; any slice."""
    data = stream_rows(seed=11)
    data += [(None, None, 900 + k, data[k][3], *data[k][4:]) for k in range(0, 160, 3)] + [("a", "hot", None, None, *data[0][4:])]
    data.sort(key=lambda r: r[3] or 0)
    stream = batches(spark, tmp_path, data)
    live.write_checkpoints(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 3, slice_us=slice_us).awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*CHECKPOINT).collect()))
    timed = spark.createDataFrame([r for r in data if r[3] is not None], WEB)
    want = sorted(map(str, checkpoints(timed, 3).select(*CHECKPOINT).collect()))
    assert got == want and len(got) > 50


def test_counters_go_on_late_and_idle(spark, tmp_path):
    """A row later than the delay is dropped, a late one within it counts where it arrives,
    and a trial that is idle for long starts anew."""
    start, minute = 1_700_000_000_000_000, 60_000_000
    page = ("request", "GET", "/p0.html", "", None, None)
    click = ("interaction", None, None, None, "click", "p")
    waves = [[("a", "x", 1, start, *page), ("a", "y", 2, start, *page)],
             [("a", "x", 3, start + 90 * minute, *click)],
             [("a", "x", 4, start + 60 * minute, *click), ("a", "x", 5, start + minute, *click)],
             [("a", "x", 6, start + 100 * minute, *page), ("a", "y", 7, start + 101 * minute, *page)]]
    stream = waves_of(spark, tmp_path, waves)
    live.write_checkpoints(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2, idle_ms=80 * 60_000).awaitTermination()
    got = {r["id"]: (r["page_index"], r["n_requests"], r["n_int_events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 0), 4: (None, 1, 2), 6: (2, 2, 2), 7: (1, 1, 0)}


def waves_of(spark, tmp_path, waves):
    folder = str(tmp_path / "in")
    for rows in waves:
        spark.createDataFrame(rows, WEB).coalesce(1).write.mode("append").json(folder)
    return live.stream_json(spark, folder, spark.createDataFrame([], WEB).schema, max_files=1)


def test_no_group_of_checkpoint_counters_holds_a_hot_trial(spark):
    """Rows meet per (trial, slice); exchanges on the trial alone take one row a slice."""
    data = [("hot" if k % 3 else f"t{k % 7}", k, k * 1_000_000) for k in range(900)]
    rows = spark.createDataFrame(data, "trial string, id long, us long").selectExpr(
        "'a' AS agent", "trial", "id", "us", "id % 4 > 0 AS event", "id % 4 = 0 AS page", "'/p' AS path")
    state = spark.createDataFrame([("a", "hot", 10, 4, 2, 8, "/q", -5)], live.TRIAL_COUNTERS)
    counted = checkpoint_counts(rows, state, slice_us=50_000_000)
    sizes = rows.groupBy("agent", "trial", F.floor(F.col("us") / 50_000_000)).count()
    assert sizes.agg(F.max("count")).first()[0] * 20 < len(data)
    # a window over a trial reads aggregated slices; a window over rows is cut by the slice
    plan = counted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for at, line in enumerate(plan):
        if "Window [" in line and "_slice" not in line.split("], [agent")[-1].split("]")[0]:
            assert any("Aggregate" in below for below in plan[at + 1:at + 3])
    last = checkpoint_state(counted).where("trial = 'hot'").first()
    mine = [r for r in data if r[0] == "hot"]
    assert (last["n_int"], last["n_req"]) == (10 + sum(r[1] % 4 > 0 for r in mine), 4 + sum(r[1] % 4 == 0 for r in mine))


def test_running_features_equal_the_batch_features(spark, small):
    """Means over a trial's requests without collect posts, as the header features have them."""
    from tracefp import views
    from tracefp.functions.requests import drop_collect_posts
    from tracefp.plans.http import header_frame, http_trial_features

    req = views.requests(spark, small)
    names = ["headless_rate", "sf_violation_rate", "n_headers_mean", "has_priority_rate", "ch_incoherence_rate"]
    live_rows = live.running_features(live.running_sums(live.signal_frame(req)))
    batch = http_trial_features(header_frame(drop_collect_posts(req)))
    got, want = (sorted(map(str, df.select("trial", *[F.round(n, 9).alias(n) for n in names]).collect())) for df in (live_rows, batch))
    assert got == want and len(got) > 10


def running_stream(spark, tmp_path, waves):
    """Every column that the signals read, by the views' names; a wave a micro-batch."""
    from tracefp import views

    folder = str(tmp_path / "in")
    for wave in waves:
        rows = spark.createDataFrame(wave, "event_id long, user_id long, us long, event_type string")
        rows.selectExpr("event_id", "user_id", "event_type", "CAST(event_id AS DOUBLE) AS value", "timestamp_micros(us) AS ts").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return views.requests_from(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))


@pytest.mark.parametrize("slice_us", [1_000_000, None])
def test_running_sums_without_a_group_per_trial(spark, tmp_path, slice_us):
    """The same rows as the keyed form, over micro-batches, for a client without a name too."""
    rnd, us, rows = random.Random(3), 1_700_000_000_000_000, []
    for i in range(160):
        us += rnd.choice([0, 4_000, 900_000])
        rows.append((i, rnd.choice([1, 1, 1, 2, 8, None]), us, rnd.choice(["view", "view", "click", "signup", "error"])))
    stream = running_stream(spark, tmp_path, [rows[k:k + 40] for k in range(0, 160, 40)])
    live.write_running_sums(stream, str(tmp_path / "sums"), str(tmp_path / "sums-cp"), slice_us=slice_us).awaitTermination()
    written = live.read_running_sums(spark, str(tmp_path / "sums"))
    keyed = finished(spark, tmp_path, live.stream_running_sums(stream))
    got, want = (sorted(map(str, df.select(*written.columns).collect())) for df in (written, keyed))
    assert got == want and len(got) > 40


def test_running_sums_late_and_idle(spark, tmp_path):
    """A request later than the delay is dropped, a late one counts where it arrives, an idle trial starts anew."""
    start, minute = 1_700_000_000_000_000, 60_000_000
    waves = [[(1, 1, start, "view"), (2, 2, start, "view")], [(3, 1, start + 190 * minute, "click")],
             [(4, 1, start + 140 * minute, "view"), (5, 1, start + minute, "view")], [(6, 1, start + 200 * minute, "view"), (7, 2, start + 201 * minute, "view")]]
    stream = running_stream(spark, tmp_path, waves)
    live.write_running_sums(stream, str(tmp_path / "sums"), str(tmp_path / "sums-cp"), idle_ms=80 * 60_000).awaitTermination()
    got = {r["id"]: (r["n_requests"], r["start_us"] - start, r["last_us"] - start) for r in live.read_running_sums(spark, str(tmp_path / "sums")).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 0, 0), 4: (3, 0, 190 * minute), 6: (4, 0, 200 * minute), 7: (1, 201 * minute, 201 * minute)}


def test_no_python_group_of_running_sums(spark, small):
    from tracefp import views

    state = spark.createDataFrame([], live._running_state("long")[1])
    rows = live.running_rows(live.signal_frame(views.requests(spark, small)), state)
    assert "Pandas" not in rows._jdf.queryExecution().executedPlan().toString()
