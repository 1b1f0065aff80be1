"""Column jobs over header content: user agent, client hints, fetch metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.schema import (BROWSER_HEADERS, FETCH_RULES, PRIORITY_ASYNC,
                            PRIORITY_NAVIGATE, PRIORITY_SUBRESOURCE, TRACKED_HEADERS)

_BRAND = r'"([^"]+)";v="(\d+)"'


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ua_os_column(ua: Column) -> Column:
    """The order of tests matters: a phone agent that says "Mac OS" is macos."""
    return (F.when(ua.contains("Windows"), "windows")
            .when(ua.contains("Macintosh") | ua.contains("Mac OS"), "macos")
            .when(ua.contains("Linux") & ~ua.contains("Android"), "linux")
            .when(ua.contains("Android"), "android")
            .when(ua.contains("iPhone") | ua.contains("iPad"), "ios")
            .otherwise("other"))


def ua_version_column(ua: Column) -> Column:
    found = [F.nullif(F.regexp_extract(ua, rf"{p}/(\d+)", 1), F.lit(""))
             for p in ("Chrome", "Firefox", "Safari")]
    return F.coalesce(*found)


def ua_features(df: DataFrame) -> DataFrame:
    """ua_family, ua_os and ua_version (major, as text)."""
    ua = _text("ua")
    family = (F.when(F.lower(ua).contains("headless"), "headless-chrome")
              .when(ua.contains("Edg/"), "edge")
              .when(ua.contains("Chrome/"), "chrome")
              .when(ua.contains("Firefox/"), "firefox")
              .when(ua.contains("Safari/") & ~ua.contains("Chrome"), "safari")
              .when(ua.contains("curl/"), "curl")
              .when(F.lower(ua).contains("python"), "python")
              .when(ua.contains("Go-http-client"), "go")
              .when(F.lower(ua).contains("okhttp"), "okhttp")
              .otherwise("other"))
    return df.select("*", family.alias("ua_family"), ua_os_column(ua).alias("ua_os"),
                     ua_version_column(ua).alias("ua_version"))


def _brand_names() -> Column:
    return F.transform(F.regexp_extract_all(_text("ch_ua"), F.lit(_BRAND), F.lit(1)), F.lower)


def _brand_versions() -> Column:
    return F.transform(F.regexp_extract_all(_text("ch_ua"), F.lit(_BRAND), F.lit(2)),
                       lambda v: v.try_cast("bigint"))


def _headless() -> Column:
    return F.exists(_brand_names(), lambda b: b.contains("headless"))


def brand_list(df: DataFrame) -> DataFrame:
    """Brand and version arrays, their count and the headless flag."""
    names = F.regexp_extract_all(_text("ch_ua"), F.lit(_BRAND), F.lit(1))
    return df.select("*", names.alias("ch_brands"), _brand_versions().alias("ch_versions"),
                     F.size(names).alias("ch_brand_count"), _headless().alias("ch_is_headless"))


def client_hint_coherence(df: DataFrame) -> DataFrame:
    """Flags that are true when the hints agree with the user agent."""
    ua, names, versions = _text("ua"), _brand_names(), _brand_versions()
    some = F.size(names) > 0
    known = F.exists(names, lambda b: b.contains("chromium") | b.contains("chrome")
                     | b.contains("edge") | b.contains("brand"))
    brand_ok = ~((ua.contains("Chrome/") | ua.contains("Chromium/")) & some) | known
    major = ua_version_column(ua).try_cast("bigint")
    real = F.filter(versions, lambda v: v > 10)
    near = F.exists(real, lambda v: F.abs(v - major) <= 2)
    version_ok = major.isNull() | ~some | (F.size(real) == 0) | near
    mobile = F.trim(_text("ch_mobile")) == "?1"
    mobile_ua = (ua.contains("Mobile") | ua.contains("Android")
                 | ua.contains("iPhone") | ua.contains("iPad"))
    platform = F.lower(F.btrim(F.trim(_text("ch_platform")), F.lit('"')))
    os = ua_os_column(ua)
    platform_ok = (platform == "") | (os == "other") | (platform == os)
    return (df.select("*", _headless().alias("ch_is_headless"),
                      brand_ok.alias("ch_brand_matches_ua"),
                      F.coalesce(version_ok, F.lit(True)).alias("ch_version_near_ua"),
                      (mobile == mobile_ua).alias("ch_mobile_matches_ua"),
                      platform_ok.alias("ch_platform_matches_ua"))
            .withColumn("ch_any_incoherence",
                        ~(F.col("ch_brand_matches_ua") & F.col("ch_version_near_ua")
                          & F.col("ch_mobile_matches_ua") & F.col("ch_platform_matches_ua"))))


def sec_fetch_consistency(df: DataFrame) -> DataFrame:
    """Seven fetch-metadata flags; the ten rules are a constant map, not a join."""
    mode, dest, site, user = (_text(c) for c in ("sf_mode", "sf_dest", "sf_site", "sf_user"))
    combo = F.concat_ws("|", mode, dest)
    site_map, user_map = [], []
    for rule_mode, rule_dest, sites, needs_user in FETCH_RULES:
        key = F.lit(f"{rule_mode}|{rule_dest}")
        site_map += [key, F.array(*[F.lit(s) for s in sites])]
        user_map += [key, F.lit(needs_user)]
    sites = F.try_element_at(F.create_map(*site_map), combo)
    needs_user = F.try_element_at(F.create_map(*user_map), combo)
    flags = {
        "sf_known_combo": sites.isNotNull(),
        "sf_site_valid": sites.isNull() | (site == "") | F.array_contains(sites, site),
        "sf_user_correct": F.when(needs_user, user == "?1").when(~needs_user, user == "")
        .otherwise(True),
        "sf_nav_has_user": (mode != "navigate") | (user == "?1"),
        "sf_no_user_on_non_nav": (mode == "navigate") | (user == ""),
        "sf_cors_dest_empty": ~((mode == "cors") & (F.col("req_type") == "fetch_xhr"))
        | (dest == "empty"),
    }
    out = df.select("*", *[c.alias(n) for n, c in flags.items()],
                    F.concat_ws("|", mode, dest, site).alias("sf_combo"))
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return out.withColumn("sf_any_violation", ~every)


def priority_features(df: DataFrame) -> DataFrame:
    """Trimmed value, urgency, incremental flag and whether it suits the type."""
    p = F.trim(_text("priority"))
    given, parsed = p != "", p.rlike(r"^u=\d+")
    kind = F.col("req_type")
    fits = (F.when(kind == "navigate", p.isin(PRIORITY_NAVIGATE))
            .when(kind.startswith("subresource"), p.isin(PRIORITY_SUBRESOURCE))
            .when(kind == "fetch_xhr", p.isin(PRIORITY_ASYNC))
            .otherwise(True))
    return df.select(
        "*", p.alias("priority_raw"),
        F.when(parsed, F.regexp_extract(p, r"^u=(\d+)", 1).try_cast("int")).alias("priority_urgency"),
        F.when(parsed, p.contains("i")).alias("priority_incr"),
        F.when(given, fits).alias("priority_expected"))


def header_order(df: DataFrame) -> DataFrame:
    order = F.array_join("header_names", ",")
    return df.select("*", order.alias("header_order"),
                     F.substring(F.sha2(order, 256), 1, 16).alias("header_order_hash"),
                     F.size("header_names").alias("n_headers"))


def presence_name(header: str) -> str:
    return "has_" + header.replace("-", "_").lower()


def header_presence(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.array_contains("header_names", h).alias(presence_name(h))
                            for h in TRACKED_HEADERS])


def nonstandard_headers(df: DataFrame) -> DataFrame:
    """Names outside the browser set, sorted and joined, with flag and count."""
    odd = F.array_sort(F.filter("header_names", lambda h: ~F.lower(h).isin(BROWSER_HEADERS)))
    return df.select("*", F.array_join(odd, ",").alias("nonstandard_headers"),
                     (F.size(odd) > 0).alias("has_nonstandard_headers"),
                     F.size(odd).alias("n_nonstandard_headers"))


def header_features(df: DataFrame) -> DataFrame:
    """All header jobs in one projection over a request frame with req_type."""
    out = client_hint_coherence(sec_fetch_consistency(df))
    out = out.withColumn("ch_brand_count", F.size(_brand_names()))
    return nonstandard_headers(header_presence(header_order(priority_features(ua_features(out)))))
