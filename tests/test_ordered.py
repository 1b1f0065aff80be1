"""Sliced windows, quantiles and modes against plain Python, for any slice length."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefp.operators.beacon import beacon_filter, beacon_flags, burst_neighbour
from tracefp.operators.ordered import (ROWS_CONF, counted_slices, next_time, ordered_columns, previous, prior_time, running_count)
from tracefp.operators.quantiles import grouped_modes, grouped_quantiles

KEYS = ["agent", "trial"]


def rows(n=300, seed=3, span=2_000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # one trial holds most of the rows, and times repeat
        trial = "hot" if rnd.random() < 0.7 else f"t{rnd.randrange(4)}"
        out.append(("a", trial, i, rnd.randrange(span), rnd.random() < 0.3))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "agent string, trial string, id long, us long, flag boolean")


@pytest.mark.parametrize("slice_us", [1, 37, 500, 10_000_000])
def test_ordered_columns_do_not_depend_on_the_slice(spark, slice_us):
    data = rows()
    got = {r["id"]: r for r in ordered_columns(
        frame(spark, data), previous("prev", F.col("us")), previous("prev_flag", F.col("id"), F.col("flag")),
        previous("fill", F.col("id"), F.col("flag"), include_self=True), next_time("nxt", F.col("flag")),
        prior_time("prior", F.col("flag")), running_count("n"), running_count("nf", F.col("flag")),
        slice_us=slice_us).collect()}
    assert len(got) == len(data)
    for _, trial, i, us, flag in data:
        mine = sorted((r[3], r[2], r[4]) for r in data if r[1] == trial)
        before = [r for r in mine if (r[0], r[1]) < (us, i)]
        flagged = [r for r in before if r[2]]
        assert got[i]["prev"] == (before[-1][0] if before else None)
        assert got[i]["prev_flag"] == (flagged[-1][1] if flagged else None)
        assert got[i]["fill"] == (i if flag else got[i]["prev_flag"])
        assert got[i]["nxt"] == min((r[0] for r in mine if r[2] and r[0] > us), default=None)
        assert got[i]["prior"] == max((r[0] for r in mine if r[2] and r[0] < us), default=None)
        assert got[i]["n"] == len(before) + 1
        assert got[i]["nf"] == len(flagged) + int(flag)


def web(spark, data):
    return spark.createDataFrame(
        data, "agent string, trial string, id long, us long, method string, path string, referer string")


def test_beacon_edges(spark):
    ms = 1000
    data = [
        ("a", "t", 1, 0, "POST", "/collect", "https://h/p.html"),        # page 500 ms later: removed
        ("a", "t", 2, 500 * ms, "GET", "/p.html", ""),
        ("a", "u", 3, 0, "POST", "/collect", "https://h/p.html"),        # 501 ms: kept
        ("a", "u", 4, 501 * ms, "GET", "/p.html", ""),
        ("a", "v", 5, 0, "POST", "/collect", ""),                        # neighbour at 50 ms: both removed
        ("a", "v", 6, 50 * ms, "POST", "/collect", ""),
        ("a", "v", 7, 100 * ms, "GET", "/p.html", ""),
        ("a", "w", 8, 0, "POST", "/collect", ""),                        # neighbour at 51 ms: kept
        ("a", "w", 9, 51 * ms, "POST", "/collect", ""),
        ("a", "w", 10, 100 * ms, "GET", "/p.html", ""),
        ("a", "x", 11, 0, "POST", "/collect", "https://h/p.html"),       # page at the same time: not after
        ("a", "x", 12, 0, "GET", "/p.html", ""),
        ("a", "y", 13, 0, "POST", "/other", "https://h/p.html"),         # not a collect post
        ("a", "y", 14, 10 * ms, "GET", "/p.html", ""),
    ]
    for slice_us in (1, 120 * ms, 10_000 * ms):
        df = web(spark, data)
        removed = {r["id"] for r in beacon_flags(df, slice_us=slice_us).where("is_beacon").collect()}
        assert removed == {1, 5, 6}
        assert {r["id"] for r in beacon_filter(df, slice_us=slice_us).collect()} == \
            {r[2] for r in data} - removed
        hard = {r["id"] for r in beacon_flags(df, aggressive=True, slice_us=slice_us).where("is_beacon").collect()}
        assert hard == removed | {8, 9}
        near = {r["id"] for r in burst_neighbour(df, slice_us=slice_us).where("in_burst").collect()}
        assert near == {5, 6}


def test_beacon_against_all_pairs(spark):
    rnd = random.Random(9)
    data = []
    for i in range(250):
        kind = rnd.choice(["post", "page", "other"])
        method, path = {"post": ("POST", "/collect"), "page": ("GET", "/a.html"), "other": ("GET", "/x.js")}[kind]
        data.append(("a", rnd.choice(["hot", "hot", "cold"]), i, rnd.randrange(60) * 20_000, method, path,
                     rnd.choice(["", "https://h/a.html"])))
    want = set()
    for r in data:
        if r[4] != "POST":
            continue
        mine = [o for o in data if o[1] == r[1]]
        follows = any(o[5].endswith(".html") and r[3] < o[3] <= r[3] + 500_000 for o in mine)
        crowd = any(o[4] == "POST" and o[2] != r[2] and abs(o[3] - r[3]) <= 50_000 for o in mine)
        if follows and (crowd or r[6].endswith(".html")):
            want.add(r[2])
    got = {r["id"] for r in beacon_flags(web(spark, data), slice_us=100_000).where("is_beacon").collect()}
    assert got == want


def test_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    values = {"hot": [0.0] * 200 + [rnd.expovariate(1e-6) for _ in range(400)],
              "small": [-3.5, -1e-7, 2.0, 2.0, 1e12], "one": [7.25], "tiny": [rnd.random() * 1e-5 for _ in range(50)]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None)],
                               "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.95, "lo": 0.0, "hi": 1.0}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, q in (("m", 0.5), ("p", 0.95), ("lo", 0), ("hi", 1)):
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-15)
    whole = grouped_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.quantile([v for vs in values.values() for v in vs], 0.5))


def test_modes_take_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("k", 10, "b"), ("k", 9, "a"), ("k", 9, "b"), ("k", 10, "a"), ("k", None, None)],
                               "k string, n int, s string")
    row = grouped_modes(df, ["k"], {"n": "n_mode", "s": "s_mode"}).first()
    # nine is below ten as a number, though not as text
    assert (row["n_mode"], row["s_mode"]) == (9, "a")


def test_focus_prefix_matches_longer_targets(spark):
    from tracefp.operators.sequences import focus_to_input

    data = [("a", "t", 1, 0, "focus", "input[text]"), ("a", "t", 2, 5_000, "input", "input.cls[text]"),
            ("a", "t", 3, 9_000, "input", "input[text]"), ("a", "t", 4, 10_000, "focus", "box"),
            ("a", "t", 5, 11_000, "input", "bo")]
    df = spark.createDataFrame(data, "agent string, trial string, id long, us long, type string, target string")
    row = focus_to_input(df).first()
    assert row["focus_to_input_n"] == 1 and row["focus_to_input_mean_ms"] == 5.0
    counts = Counter(r[4] for r in data)
    assert counts["focus"] == 2


def test_null_keys_and_times_keep_their_order(spark):
    rows = [(None, None, k, 10 * k) for k in range(1, 5)] + [("a", None, 9, None), ("a", "t", 1, 5), ("a", "t", 2, 4000)]
    df = spark.createDataFrame(rows, "agent string, trial string, id long, us long")
    for size in (15, 1 << 40):
        got = {(r.agent, r.trial, r.id): r.nth for r in ordered_columns(df, running_count("nth"), slice_us=size).collect()}
        assert got == {(None, None, k): k for k in range(1, 5)} | {("a", None, 9): 1, ("a", "t", 1): 1, ("a", "t", 2): 2}


def test_long_targets_are_cut_only_at_lengths_in_use(spark):
    from tracefp.operators.sequences import focus_to_input

    long = "input#" + "x" * 100_000
    rows = [("a", "t", 1, 1_000, "focus", "input#xx[q]"), ("a", "t", 2, 2_000, "focus", long), ("a", "t", 3, 5_000, "input", long + "[text]"),
            ("a", "t", 4, 9_000, "focus", "other"), ("a", "t", 5, 9_500, "input", "input#x")]
    df = spark.createDataFrame(rows, "agent string, trial string, id long, us long, type string, target string")
    row = focus_to_input(df).first()
    assert row["focus_to_input_n"] == 2 and row["focus_to_input_mean_ms"] == 3.5


def busy_rows():
    """A trial of forty days with one busy hour, of which a minute is busiest; ties in time."""
    rnd = random.Random(8)
    hour = 3_600_000_000
    out = [("a", "hot", k, rnd.randrange(40 * 24) * hour + rnd.randrange(1000)) for k in range(200)]
    out += [("a", "hot", 1000 + k, 500 * hour + rnd.randrange(60) * 60_000_000 + rnd.randrange(50_000)) for k in range(600)]
    out += [("a", "hot", 2000 + k, 500 * hour + 7 * 60_000_000 + rnd.randrange(400) * 100) for k in range(900)]
    out += [("a", "cold", 4000 + k, k * hour) for k in range(30)] + [(None, None, 5000 + k, -k * 70_000_000) for k in range(50)]
    return out + [("a", "hot", 6000, None)]


@pytest.mark.parametrize("target", [1, 60, 10_000])
def test_slices_cut_by_counted_rows(spark, target):
    """No slice is over twice the target and the rows of a millisecond; slices follow time."""
    data = busy_rows()
    df = spark.createDataFrame(data, "agent string, trial string, id long, us long")
    got = counted_slices(df, target).collect()
    assert sorted(r["id"] for r in got) == sorted(r[2] for r in data)
    sizes = Counter((r["trial"], r["_slice"]) for r in got)
    one_ms = max(Counter((r[1], r[3] // 1000) for r in data if r[3] is not None).values())
    assert max(sizes.values()) < 2 * target + one_ms
    for trial in ("hot", "cold", None):
        line = [r["_slice"] for r in sorted((r for r in got if r["trial"] == trial and r["us"] is not None), key=lambda r: r["us"])]
        assert line == sorted(line)
    # quiet time is not cut: few more slices than rows ask for
    assert len({r["_slice"] for r in got if r["trial"] == "hot"}) <= 2 * 1701 // target + 64


def test_ordered_columns_do_not_depend_on_the_row_target(spark):
    df = spark.createDataFrame([(*r, r[2] % 3 == 0) for r in busy_rows()], "agent string, trial string, id long, us long, flag boolean")

    def run():
        return sorted(map(str, ordered_columns(df, previous("prev", F.col("id"), F.col("flag")), next_time("nxt", F.col("flag")),
                                               prior_time("prior", F.col("flag")), running_count("nf", F.col("flag"))).collect()))

    want = run()
    for target in (1, 40, 100_000):
        spark.conf.set(ROWS_CONF, str(target))
        try:
            assert run() == want
        finally:
            spark.conf.unset(ROWS_CONF)
