"""Prefix features at the full length are the batch features."""

from pyspark.sql import functions as F

from tracefp import views
from tracefp.functions.requests import drop_collect_posts
from tracefp.operators.sequences import events_at_cutoff, request_prefixes
from tracefp.plans.behaviour import behaviour_counts
from tracefp.plans.tls import fingerprint_frame, tls_trial_features
from tracefp.plans.traces import temporal_trial_features
from tracefp.session import shared_dir


def table(df):
    cols = sorted(c for c in df.columns if c != "n_req")
    rounded = [F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in cols]
    return sorted(map(str, df.select(*rounded).collect()))


def test_whole_prefix_equals_batch(spark, small):
    requests = views.requests(spark, small).where("agent IN ('agent_0', 'agent_1')")
    keys = ("agent", "trial", "n_req")
    prefixes = request_prefixes(requests, 10_000)
    top = prefixes.groupBy("agent", "trial").agg(F.max("n_req").alias("n_req"))
    whole = prefixes.join(top, list(keys), "left_semi")
    kept = drop_collect_posts(whole)
    assert table(temporal_trial_features(kept, keys)) == table(temporal_trial_features(drop_collect_posts(requests)))
    assert table(tls_trial_features(fingerprint_frame(kept), keys)) == \
        table(tls_trial_features(fingerprint_frame(drop_collect_posts(requests))))
    events = views.interactions(spark, small)
    last = requests.groupBy("agent", "trial").agg(F.max("us").alias("end"))
    upto = events.join(last, ["agent", "trial"]).where("us <= end").drop("end")
    seen = events_at_cutoff(whole, events)
    assert table(behaviour_counts(seen.where("n_req > 0"), ("agent", "trial"))) == table(behaviour_counts(upto))


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(root) and first != second
