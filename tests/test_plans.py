"""Reports read the log once and parse what they have counted."""

import pytest
from pyspark.sql import functions as F

from tracefp import views
from tracefp.operators.weighted import Weighted
from tracefp.plans import behaviour, http, tls, traces
from tracefp.session import materialize


@pytest.mark.parametrize(("name", "plan", "view"), [
    ("A1", traces.trace_temporal_stats, views.requests), ("A27", traces.temporal_trial_features, views.requests),
    ("A10", behaviour.interaction_session_stats, views.interactions), ("A11", behaviour.interaction_page_stats, views.interactions)])
def test_the_log_is_read_once(spark, small, name, plan, view):
    out = plan(view(spark, small).where("agent = 'agent_1'"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    read = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    assert not any(small in f for f in read), name
    assert "event_type" not in text and out.count() > 0


def rounded(df):
    kinds = dict(df.dtypes)
    return sorted(map(str, df.select(*[F.round(c, 9).alias(c) if kinds[c] == "double" else c for c in df.columns]).collect()))


def test_counted_headers_and_fingerprints_stand_for_their_requests(spark, small):
    """The features of counted rows are those of the requests, nulls and single requests included."""
    req = views.requests(spark, small)
    odd = req.limit(1).withColumn("trial", F.lit("lone")).withColumns({c: F.lit(None).cast(req.schema[c].dataType) for c in ("ua", "header_names", "h2_fp", "source_ip")})
    req = materialize(req.unionByName(odd), "requests")
    rows = http.http_trial_features(http.header_frame(req))
    counted = http.distinct_headers(req)
    assert counted.agg(F.sum("weight")).first()[0] == req.count() and counted.count() < req.count()
    assert rounded(http.http_trial_features(counted)) == rounded(rows)
    prints = tls.distinct_fingerprints(req, also=["source_ip"])
    assert rounded(tls.tls_trial_features(prints)) == rounded(tls.tls_trial_features(tls.fingerprint_frame(req)))
    assert rounded(tls.field_stability(counted, http.HEADER_STABILITY_FIELDS)) == rounded(
        tls.field_stability(http.header_frame(req), http.HEADER_STABILITY_FIELDS))


def test_weighted_aggregates(spark):
    rows = [("a", 1, 3, True), ("a", 4, 1, None), ("a", None, 2, False), ("b", 7, 1, True), ("c", None, 2, None)]
    df = spark.createDataFrame(rows, "k string, x int, weight long, flag boolean")
    plain = df.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "weight"))).drop("weight")
    got, want = (rounded(d.groupBy("k").agg(of.count().alias("n"), of.count(F.col("flag")).alias("f"), of.avg("x").alias("m"),
                                            of.share("flag").alias("s"), of.stddev_samp("x").alias("d")))
                 for d, of in ((df, Weighted(df)), (plain, Weighted(plain))))
    built = rounded(plain.groupBy("k").agg(F.count("*").alias("n"), F.count_if("flag").alias("f"), F.avg("x").alias("m"),
                                           F.avg(F.col("flag").cast("int")).alias("s"), F.stddev_samp("x").alias("d")))
    assert got == want == built
    assert df.limit(0).agg(Weighted(df).count().alias("n")).first()[0] == 0
