"""Column jobs over the request log: flattening, times, flags and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefp.schema import COLLECT_PATH


def event_time(text: Column) -> Column:
    """RFC 3339 text with up to nine fraction digits to a timestamp; bad text is null.

    Digits after the sixth are cut, not rounded; text without a zone is UTC.
    """
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))


def parse_event_time(df: DataFrame, source: str = "timestamp", out: str = "us") -> DataFrame:
    return df.withColumn(out, F.unix_micros(event_time(F.col(source))))


def first_header(name: str, headers: str = "http.headers") -> Column:
    """First value of a header (exact name) or the empty string."""
    values = F.try_element_at(F.col(headers), F.lit(name))
    return F.coalesce(F.get(values, 0), F.lit(""))


def header_fallback(field: str, name: str) -> Column:
    """The typed field when it has text, else the first value in the header map."""
    typed = F.col(f"http.{field}")
    return F.when(typed != "", typed).otherwise(first_header(name))


def flatten_requests(df: DataFrame) -> DataFrame:
    """The flat request table; keys the reader added are kept in front."""
    keys = [c for c in ("agent", "trial") if c in df.columns]
    return df.select(
        *keys, "id",
        F.unix_micros(event_time(F.col("timestamp"))).alias("us"),
        "source_ip",
        F.col("http.method").alias("method"), F.col("http.path").alias("path"),
        F.col("http.protocol").alias("protocol"), F.col("http.host").alias("host"),
        F.coalesce("http.referer", F.lit("")).alias("referer"),
        F.coalesce("http.body_size", F.lit(0)).alias("body_size"),
        F.col("http.body_sha256").alias("body_sha256"),
        F.coalesce("processing_time_ms", F.lit(0.0)).alias("processing_ms"),
        F.col("tls.version").alias("tls_version"),
        F.col("tls.cipher_suite").alias("cipher_suite"),
        F.col("tls.ja3_hash").alias("ja3"), F.col("tls.ja4_hash").alias("ja4"),
        F.col("http2.akamai_fingerprint").alias("h2_fp"),
        F.coalesce(F.size("http.headers_ordered"), F.lit(0)).alias("n_headers"),
        F.coalesce("http.user_agent", F.lit("")).alias("ua"),
    )


def request_frame(df: DataFrame) -> DataFrame:
    """Everything the feature jobs read, one row per request.

    Only columns that are used further on are read from the log: the scan is
    pruned down to the struct fields named here.
    """
    keys = [c for c in ("agent", "trial") if c in df.columns]
    empty_ints = F.array().cast("array<int>")
    return df.select(
        *keys, "id",
        F.unix_micros(event_time(F.col("timestamp"))).alias("us"),
        "source_ip", "source_port",
        F.coalesce("http.method", F.lit("")).alias("method"),
        F.coalesce("http.path", F.lit("")).alias("path"),
        F.col("http.protocol").alias("protocol"),
        header_fallback("referer", "Referer").alias("referer"),
        F.coalesce("http.body_size", F.lit(0)).alias("body_size"),
        F.coalesce("processing_time_ms", F.lit(0.0)).alias("processing_ms"),
        header_fallback("sec_fetch_mode", "Sec-Fetch-Mode").alias("sf_mode"),
        header_fallback("sec_fetch_dest", "Sec-Fetch-Dest").alias("sf_dest"),
        header_fallback("sec_fetch_site", "Sec-Fetch-Site").alias("sf_site"),
        header_fallback("sec_fetch_user", "Sec-Fetch-User").alias("sf_user"),
        header_fallback("user_agent", "User-Agent").alias("ua"),
        header_fallback("sec_ch_ua", "Sec-Ch-Ua").alias("ch_ua"),
        header_fallback("sec_ch_ua_mobile", "Sec-Ch-Ua-Mobile").alias("ch_mobile"),
        header_fallback("sec_ch_ua_platform", "Sec-Ch-Ua-Platform").alias("ch_platform"),
        header_fallback("accept", "Accept").alias("accept"),
        header_fallback("accept_encoding", "Accept-Encoding").alias("accept_encoding"),
        first_header("Priority").alias("priority"),
        first_header("Origin").alias("origin"),
        first_header("Content-Type").alias("content_type"),
        first_header("Upgrade-Insecure-Requests").alias("upgrade_insecure"),
        F.coalesce(F.col("http.headers_ordered.name"), F.array().cast("array<string>"))
        .alias("header_names"),
        F.col("tls.version").alias("tls_version"),
        F.col("tls.cipher_suite").alias("cipher_suite"),
        F.col("tls.negotiated_protocol").alias("negotiated_proto"),
        F.coalesce(F.col("tls.server_name") != "", F.lit(False)).alias("sni_present"),
        F.col("tls.ja3_hash").alias("ja3"), F.col("tls.ja4_hash").alias("ja4"),
        F.col("http2.akamai_fingerprint").alias("h2_fp"),
        F.coalesce(F.array_join("http2.pseudo_header_order", ","), F.lit("")).alias("h2_order"),
        F.coalesce("tls.cipher_suites_offered", empty_ints).alias("ciphers"),
        F.coalesce("tls.elliptic_curves", empty_ints).alias("curves"),
        F.coalesce("tls.signature_schemes", empty_ints).alias("sigs"),
        F.coalesce("tls.supported_versions", empty_ints).alias("versions"),
        F.coalesce("tls.alpn_protocols", F.array().cast("array<string>")).alias("alpn"),
    )


def is_page() -> Column:
    return F.coalesce(F.col("path").endswith(".html"), F.lit(False))


def is_collect_post() -> Column:
    return F.coalesce((F.col("method") == "POST") & (F.col("path") == COLLECT_PATH), F.lit(False))


def is_subresource() -> Column:
    return (~is_page()) & (~is_collect_post()) & F.coalesce(F.col("method") == "GET", F.lit(False))


def request_flags(df: DataFrame) -> DataFrame:
    """is_page, is_collect (any method), is_subres, is_fetch."""
    fetch = (F.col("sf_mode").isin("cors", "same-origin") & (F.col("sf_dest") == "empty")
             & ~is_collect_post())
    return df.select(
        "*", is_page().alias("is_page"),
        F.coalesce(F.col("path") == COLLECT_PATH, F.lit(False)).alias("is_collect"),
        is_subresource().alias("is_subres"),
        F.coalesce(fetch, F.lit(False)).alias("is_fetch"))


def page_name() -> Column:
    """File name of a page request, null for anything else."""
    return F.when(is_page(), F.regexp_extract("path", r"([^/]+\.html)", 1))


def _mode() -> Column:
    return F.coalesce(F.col("sf_mode"), F.lit(""))


def _dest() -> Column:
    return F.coalesce(F.col("sf_dest"), F.lit(""))


def _dest_or_unknown() -> Column:
    return F.when(_dest() == "", F.lit("unknown")).otherwise(_dest())


def request_type_column() -> Column:
    path = F.coalesce(F.col("path"), F.lit(""))
    image = path.rlike(r"\.(png|jpg|jpeg|gif|webp|svg|ico)$")
    return (F.when(_mode() == "navigate", F.lit("navigate"))
            .when(_mode() == "no-cors", F.concat(F.lit("subresource:"), _dest_or_unknown()))
            .when(_mode().isin("cors", "same-origin") & (_dest() == "empty"), F.lit("fetch_xhr"))
            .when(_mode() == "cors", F.concat(F.lit("cors:"), _dest_or_unknown()))
            .when(F.col("method") == "POST", F.lit("post"))
            .when(path.endswith(".js"), F.lit("subresource:script"))
            .when(path.endswith(".css"), F.lit("subresource:style"))
            .when(image, F.lit("subresource:image"))
            .otherwise(F.lit("other")))


def request_type(df: DataFrame) -> DataFrame:
    return df.withColumn("req_type", request_type_column())


def request_type_session(df: DataFrame) -> DataFrame:
    """Session variant: collect posts are a type of their own and pages navigate."""
    fetch = _mode().isin("cors", "same-origin") & (_dest() == "empty") & ~is_collect_post()
    kind = (F.when(_mode() == "navigate", F.lit("navigate"))
            .when(_mode() == "no-cors", F.concat(F.lit("subresource:"), _dest_or_unknown()))
            .when(fetch, F.lit("fetch_xhr"))
            .when(is_collect_post(), F.lit("collect"))
            .when(is_page(), F.lit("navigate"))
            .otherwise(F.lit("other")))
    return df.withColumn("req_type", kind)


def drop_collect_posts(df: DataFrame) -> DataFrame:
    """Every collect post removed, whatever its timing."""
    return df.where(~is_collect_post())


def collect_post_report(df: DataFrame) -> DataFrame:
    """Rows before, removed and left per trial for `drop_collect_posts`."""
    return df.groupBy("agent", "trial").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(is_collect_post()).alias("n_removed"),
        F.count_if(~is_collect_post()).alias("n_kept"))
