"""Header profiles, trial and client features over a request frame with header_features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.functions.headers import header_features
from tracefp.functions.requests import (drop_collect_posts, is_page, is_subresource, request_type,
                                        request_type_session)
from tracefp.operators.ordered import ordered_columns, previous, running_count
from tracefp.operators.quantiles import grouped_modes, grouped_quantiles, modal_rows, value_counts
from tracefp.operators.weighted import WEIGHT, Weighted
from tracefp.schema import (HEADER_STABILITY_FIELDS, PRESENCE_CHECKS, PRIORITY_ASYNC, PRIORITY_NAVIGATE,
                            PROFILE_CATEGORICAL, PROFILE_NUMERIC, TRIAL_KEY)
from tracefp.session import materialize


def header_frame(requests: DataFrame) -> DataFrame:
    """Request frame with the request type and every header column."""
    return header_features(request_type(requests))


RAW_HEADERS = ["ua", "ch_ua", "ch_mobile", "ch_platform", "sf_mode", "sf_dest", "sf_site", "sf_user", "priority", "header_names",
               "accept", "accept_encoding", "upgrade_insecure"]


def distinct_headers(requests: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Every header column for each request type and set of raw headers of a trial, once,
    with its number of requests in ``weight``.

    A client repeats a few sets of headers over all its requests, so counting them
    first (map-side combined) leaves little to parse, to unpivot and to shuffle.
    """
    raw = [c for c in RAW_HEADERS if c in requests.columns]
    counted = request_type(requests).groupBy(*keys, "req_type", *raw).agg(F.count(F.lit(1)).alias(WEIGHT))
    return header_features(counted)


def share(flag: Column | str) -> Column:
    """Mean of a boolean, nulls left out."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(flag.cast("int"))


def header_order_profile(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Per request type: requests, distinct orders, the usual order, its hash and share."""
    keys = [*keys, "req_type"]
    rows = modal_rows(value_counts(df, keys, ["header_order"]), keys)
    return rows.select(
        *keys, F.col("total").alias("n_requests"), F.col("n_distinct").alias("n_distinct_orders"),
        F.col("modal").alias("modal_order"),
        F.substring(F.sha2("modal", 256), 1, 16).alias("modal_order_hash"),
        (F.col("modal_n") / F.col("total")).alias("order_stability"))


def consistency_violations(df: DataFrame) -> DataFrame:
    """Requests that break a fetch-metadata, client-hint or priority rule."""
    wrong = (F.col("sf_any_violation") | F.col("ch_any_incoherence")
             | ~F.coalesce("priority_expected", F.lit(True)))
    return df.where(wrong)


FETCH_RULE_FLAGS = ["sf_known_combo", "sf_site_valid", "sf_user_correct", "sf_nav_has_user",
                    "sf_no_user_on_non_nav", "sf_cors_dest_empty"]
HINT_FLAGS = ["ch_brand_matches_ua", "ch_version_near_ua", "ch_mobile_matches_ua",
              "ch_platform_matches_ua", "ch_any_incoherence"]


def violation_rates(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Broken fetch rules, hint shares, headless share and suitable priorities per trial."""
    return df.groupBy(*keys).agg(
        *[F.count_if(~F.col(c)).alias(f"{c}_broken") for c in FETCH_RULE_FLAGS],
        F.count_if("sf_any_violation").alias("sf_any_violation_n"),
        share("sf_any_violation").alias("sf_violation_rate"),
        *[share(c).alias(f"{c}_rate") for c in HINT_FLAGS],
        share("ch_is_headless").alias("headless_rate"),
        share(F.coalesce("priority_expected", F.lit(True))).alias("priority_correct_rate"))


PRESENCE_RATES = {
    "accept_lang_rate": "has_accept_language", "has_priority_rate": "has_priority",
    "has_sec_ch_ua_rate": "has_sec_ch_ua",
    "has_upgrade_ins_rate": "has_upgrade_insecure_requests", "has_dnt_rate": "has_dnt",
    "has_te_rate": "has_te", "has_connection_rate": "has_connection",
    "has_cache_control_rate": "has_cache_control",
}


def nonstandard_names(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """Distinct non-standard header names per trial, one row each."""
    names = F.explode(F.split("nonstandard_headers", ","))
    return (df.where("has_nonstandard_headers").select(*keys, names.alias("name"))
            .where(F.col("name") != "").distinct())


def http_trial_features(df: DataFrame, keys=TRIAL_KEY) -> DataFrame:
    """One header feature row per trial.

    Modes, distinct counts and the navigation order share come from one table
    of value counts, so no aggregation buffer grows with a trial.  Rows of
    ``distinct_headers`` count by their weight.
    """
    keys, of = list(keys), Weighted(df)
    nav = F.col("req_type") == "navigate"
    base = df.groupBy(*keys).agg(
        of.count().alias("n_requests"), of.count(nav).alias("n_nav"),
        of.count(F.col("req_type").startswith("subresource")).alias("n_sub"),
        of.avg("n_headers").alias("n_headers_mean"), of.stddev_samp("n_headers").alias("n_headers_std"),
        of.share(F.col("sf_site") == "none").alias("sf_site_none_rate"),
        of.share("sf_any_violation").alias("sf_violation_rate"),
        of.share("ch_is_headless").alias("headless_rate"),
        of.share("ch_any_incoherence").alias("ch_incoherence_rate"),
        of.share("ch_brand_matches_ua").alias("ch_brand_matches_rate"),
        of.share("ch_mobile_matches_ua").alias("ch_mobile_matches_rate"),
        of.share("ch_platform_matches_ua").alias("ch_platform_matches_rate"),
        *[of.share(c).alias(n) for n, c in PRESENCE_RATES.items()],
        of.share("priority_expected").alias("priority_correct_rate"),
        of.share("has_nonstandard_headers").alias("has_nonstandard_rate"))
    fields = ["nav_hash", "sf_site", "ch_brand_count", "ua_family", "ua_os", "ua_version",
              "priority_urgency"]
    rows = modal_rows(value_counts(
        df.withColumn("nav_hash", F.when(nav, F.col("header_order_hash"))), keys, fields, weight=of.name), keys)

    def pick(field: str, what: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col(what)))

    zero = F.lit(0)
    modes = rows.groupBy(*keys).agg(
        (pick("nav_hash", "n_distinct") / pick("nav_hash", "total")).alias("nav_order_unique_ratio"),
        (pick("nav_hash", "modal_n") / pick("nav_hash", "total")).alias("nav_order_stability"),
        F.coalesce(pick("nav_hash", "n_distinct"), zero).alias("n_unique_nav_hashes"),
        pick("sf_site", "modal").alias("sf_site_mode"),
        pick("ch_brand_count", "modal").cast("int").alias("ch_brand_count_mode"),
        pick("ua_family", "modal").alias("ua_family_mode"),
        pick("ua_os", "modal").alias("ua_os_mode"),
        pick("ua_version", "modal").alias("ua_version_mode"),
        F.coalesce(pick("ua_version", "n_distinct"), zero).alias("ua_version_n_distinct"),
        F.coalesce(pick("ua_family", "n_distinct"), zero).alias("ua_family_n_distinct"),
        pick("priority_urgency", "modal").cast("int").alias("priority_urgency_mode"))
    names = nonstandard_names(df, keys).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("nonstandard_names"),
        F.count(F.lit(1)).alias("n_nonstandard_distinct"))
    return (base.join(modes, keys, "left").join(names, keys, "left")
            .withColumn("nonstandard_names", F.coalesce("nonstandard_names", F.lit("")))
            .withColumn("n_nonstandard_distinct", F.coalesce("n_nonstandard_distinct", zero)))




def agent_profiles(trials: DataFrame) -> DataFrame:
    """Mean, std, min and max of numeric features and mode with consistency of the others."""
    stats = []
    for c in PROFILE_NUMERIC:
        stats += [F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std"),
                  F.round(F.min(c).cast("double"), 4).alias(f"{c}_min"),
                  F.round(F.max(c).cast("double"), 4).alias(f"{c}_max")]
    base = trials.groupBy("agent").agg(F.count(F.lit(1)).alias("n_trials"), *stats)
    text = trials.select("agent", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c)
                                    for c in PROFILE_CATEGORICAL])
    rows = modal_rows(value_counts(text, ["agent"], PROFILE_CATEGORICAL), ["agent"])
    picks = []
    for c in PROFILE_CATEGORICAL:
        here = F.col("field") == c
        picks += [F.max(F.when(here, F.col("modal"))).alias(f"{c}_mode"),
                  F.round(F.max(F.when(here, F.col("modal_n") / F.col("total"))), 4)
                  .alias(f"{c}_consistency")]
    return base.join(rows.groupBy("agent").agg(*picks), ["agent"], "left")


def nonstandard_prevalence(trials: DataFrame) -> DataFrame:
    """Per client, each non-standard header name with the share of trials that show it."""
    names = (trials.select("agent", "trial", F.explode(F.split("nonstandard_names", r"\|")).alias("name"))
             .where(F.trim("name") != "").distinct()
             .groupBy("agent", "name").agg(F.count(F.lit(1)).alias("n_trials_with")))
    totals = trials.groupBy("agent").agg(F.count(F.lit(1)).alias("n_trials"))
    return names.join(totals, ["agent"]).select(
        "agent", "name", "n_trials_with",
        F.round(F.col("n_trials_with") / F.col("n_trials"), 3).alias("prevalence"))


def feature_discriminability(profiles: DataFrame, features=tuple(PROFILE_NUMERIC)) -> DataFrame:
    """Spread of client means over the mean spread inside clients, best first."""
    long = profiles.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_mean").alias("m"), F.col(f"{f}_std").alias("s"))
        for f in features])))
    out = long.groupBy("feature").agg(F.stddev_samp("m").alias("inter"), F.avg("s").alias("intra"))
    return out.select(
        "feature", F.round("inter", 4).alias("inter_agent_std"),
        F.round("intra", 4).alias("mean_intra_std"),
        F.round(F.col("inter") / (F.col("intra") + 1e-9), 3).alias("discrim_ratio")
    ).orderBy(F.col("discrim_ratio").desc_nulls_last(), "feature")


def session_header_checks(requests: DataFrame, types=("navigate", "fetch_xhr"),
                          keys=TRIAL_KEY) -> DataFrame:
    """Usual order, header count, fetch combination and priority per request type,
    with session-wide fetch rules and priority correctness."""
    keys = list(keys)
    df = request_type_session(requests)
    df = (df.withColumn("header_order", F.array_join("header_names", ","))
          .withColumn("n_headers", F.size("header_names"))
          .withColumn("sf_combo", F.concat_ws("|", "sf_mode", "sf_dest", "sf_site")))
    nav, fetch = F.col("req_type") == "navigate", F.col("req_type") == "fetch_xhr"
    rated = F.count_if(nav | fetch)
    right = F.count_if((nav & F.col("priority").isin(PRIORITY_NAVIGATE))
                       | (fetch & F.col("priority").isin(PRIORITY_ASYNC)))
    violated = ((nav & (F.col("sf_user") != "?1")) | (~nav & (F.col("sf_user") != ""))
                | (fetch & (F.col("sf_dest") != "empty")))
    base = df.groupBy(*keys).agg(
        F.coalesce(F.bool_or(violated), F.lit(False)).alias("sf_has_violation"),
        F.coalesce(share(F.when(F.col("req_type") != "collect", F.col("sf_mode") == "")), F.lit(0.0))
        .alias("sf_missing_rate"),
        F.when(rated > 0, right / rated).otherwise(1.0).alias("priority_correct_rate"))
    typed = df.where(F.col("req_type").isin(*types))
    modes = grouped_modes(typed, [*keys, "req_type"],
                          {"header_order": "order", "sf_combo": "combo", "priority": "prio"})
    counts = grouped_quantiles(typed, [*keys, "req_type"], "n_headers", {"n": 0.5})
    per_type = modes.join(counts, [*keys, "req_type"], "left")
    cols = []
    for t in types:
        here = F.col("req_type") == t
        order = F.when(here & (F.col("order") != ""), F.substring(F.sha2("order", 256), 1, 16))
        cols += [F.max(order).alias(f"{t}_order_hash"),
                 F.max(F.when(here, F.col("n"))).alias(f"{t}_header_count"),
                 F.max(F.when(here, F.col("combo"))).alias(f"{t}_sf_combo"),
                 F.max(F.when(here, F.col("prio"))).alias(f"{t}_priority")]
    return base.join(per_type.groupBy(*keys).agg(*cols), keys, "left")


def session_navigation_checks(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Subresource share of GETs, whether each page names the page before it, one port."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.coalesce(F.count_if(is_subresource()) / F.nullif(F.count_if(F.col("method") == "GET"), F.lit(0)),
                   F.lit(0.0)).alias("subresource_ratio"),
        (F.countDistinct("source_port") == 1).alias("connection_reuse"))
    pages = df.where(is_page()).select(*keys, "id", "us", "path", "referer")
    prev = ordered_columns(pages, previous("_prev", F.col("path")), keys=keys, slice_us=slice_us)
    names = F.regexp_replace("_prev", "^/+", "")
    chain = prev.groupBy(*keys).agg(F.bool_and(
        F.col("_prev").isNull() | F.coalesce("referer", F.lit("")).contains(names)).alias("chain"))
    return (base.join(chain, keys, "left")
            .withColumn("referer_chain_intact", F.coalesce("chain", F.lit(True))).drop("chain"))


def page_sequence(df: DataFrame, keys=TRIAL_KEY, slice_us=None) -> DataFrame:
    """Visited page paths in order, one row per step."""
    pages = df.where(is_page()).select(*keys, "id", "us",
                                       F.regexp_replace("path", "^/+", "").alias("page"))
    return ordered_columns(pages, running_count("step"), keys=keys, slice_us=slice_us)


def agent_headless_rate(df: DataFrame) -> DataFrame:
    """Mean over trials of the headless share of a trial."""
    per_trial = df.groupBy("agent", "trial").agg(share("ch_is_headless").alias("r"))
    return per_trial.groupBy("agent").agg(F.avg("r").alias("headless_rate"))


COMPARED_MODES = ["ua_family", "ua_os", "ua_version", "ch_brand_count", "sf_site", "sf_user",
                  "priority_urgency", "priority_incr"]


def header_comparison(df: DataFrame) -> DataFrame:
    """(agent, feature, text, number, anomaly) over navigations and subresources of a
    request frame.  Sets of headers are counted per client before they are parsed, and
    written once for the branches that read them."""
    df = materialize(distinct_headers(drop_collect_posts(df), ["agent"]), "headers")
    of = Weighted(df)
    nav = df.where(F.col("req_type") == "navigate")
    sub = df.where(F.col("req_type").startswith("subresource"))

    def pct(c: str) -> Column:
        return of.share(F.coalesce(F.col(c), F.lit(False))) * 100

    rates = {c: (pct(c), low, high) for c, low, high in PRESENCE_CHECKS}
    rates |= {"headless": (pct("ch_is_headless"), None, 10),
              "sf_violation": (pct("sf_any_violation"), None, 0),
              "ch_incoherence": (pct("ch_any_incoherence"), None, 10),
              "mobile_matches": (pct("ch_mobile_matches_ua"), None, None),
              "platform_matches": (pct("ch_platform_matches_ua"), None, None),
              "priority_correct": (pct("priority_expected"), None, None),
              "sf_site_none": (of.share(F.col("sf_site") == "none") * 100, None, 99.9999999)}

    def limits(name: str, low, high) -> Column:
        if low is not None:
            return F.col(name) <= low
        if high is not None:
            return F.col(name) > high
        return F.lit(False)

    def entry(name: str, number: Column, anomaly: Column, text: Column | None = None) -> Column:
        text = F.lit(None) if text is None else text
        return F.struct(F.lit(name).alias("feature"), text.cast("string").alias("text"),
                        number.cast("double").alias("number"), anomaly.alias("anomaly"))

    nav_stats = nav.groupBy("agent").agg(
        *[e.alias(n) for n, (e, _, _) in rates.items()],
        of.avg("n_headers").alias("header_count_mean"), of.stddev_samp("n_headers").alias("header_count_std"),
        F.countDistinct("header_order_hash").alias("_u"), of.count().alias("_n"))
    rows = [entry(n, F.col(n), limits(n, lo, hi)) for n, (_, lo, hi) in rates.items()]
    rows += [entry("unique_orders", F.col("_u") / F.col("_n"), F.col("_u") == F.col("_n")),
             entry("header_count_mean", F.col("header_count_mean"), F.lit(False)),
             entry("header_count_std", F.col("header_count_std"), F.lit(False))]
    out = nav_stats.select("agent", F.inline(F.array(*rows)))
    sub_stats = sub.groupBy("agent").agg(
        of.count().alias("_n"), pct("has_accept_language").alias("_al"),
        F.countDistinct("header_order_hash").alias("_u"))
    out = out.unionByName(sub_stats.select("agent", F.inline(F.array(
        entry("sub_requests", F.col("_n"), F.lit(False)),
        entry("sub_accept_language", F.col("_al"), F.lit(False)),
        entry("sub_unique_orders", F.col("_u") / F.col("_n"), F.col("_u") == F.col("_n"))))))
    modes = modal_rows(value_counts(
        nav.select("agent", WEIGHT, *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c)
                                      for c in COMPARED_MODES]), ["agent"], COMPARED_MODES, weight=WEIGHT), ["agent"])
    out = out.unionByName(modes.select(
        "agent", F.concat(F.lit("mode_"), "field").alias("feature"), F.col("modal").alias("text"),
        F.col("n_distinct").cast("double").alias("number"), (F.col("n_distinct") > 1).alias("anomaly")))
    names = nonstandard_names(nav, ["agent"]).select("agent", F.lower("name").alias("name")).distinct()
    # the two alphabetically first names, found without gathering the rest
    first = names.groupBy("agent").agg(F.min("name").alias("text"))
    rest = names.join(first, ["agent"]).where(F.col("name") > F.col("text")).groupBy("agent").agg(
        F.min("name").alias("text"))
    for label, frame in (("nonstandard_example_1", first), ("nonstandard_example_2", rest)):
        out = out.unionByName(frame.select(
            "agent", F.lit(label).alias("feature"), "text", F.lit(None).cast("double").alias("number"),
            F.lit(True).alias("anomaly")))
    return out


def priority_by_type(df: DataFrame, values=None) -> DataFrame:
    """Counts of each priority value per request type, header present only.

    With `values` the counts become one zero-filled column per value.
    """
    given = df.where(F.col("priority").isNotNull() & (F.col("priority") != ""))
    if values is None:
        return given.groupBy("req_type", "priority").agg(F.count(F.lit(1)).alias("n"))
    return given.groupBy("req_type").agg(
        *[F.count_if(F.col("priority") == v).alias(v) for v in values])


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), column).limit(k))
