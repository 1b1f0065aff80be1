"""Request, interaction and window views derived from the test tables.

The expressions are plain SQL that Spark and DuckDB both read, so a query and
its check start from the same rows.  Only the microsecond expression differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US_SPARK = "unix_micros(CAST(ts AS TIMESTAMP))"
US_DUCK = "epoch_us(ts)"

REQ = {
    "agent": "'agent_' || CAST(user_id % 6 AS VARCHAR(20))",
    "trial": "'trial_' || CAST(user_id AS VARCHAR(20))",
    "id": "event_id",
    "us": "{US}",
    "method": "CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END",
    "path": "CASE event_type WHEN 'view' THEN '/p' || CAST(event_id % 7 AS VARCHAR(20)) || '.html' "
            "WHEN 'signup' THEN '/collect' WHEN 'click' THEN '/a' || CAST(event_id % 5 AS VARCHAR(20)) || '.js' "
            "WHEN 'purchase' THEN '/i' || CAST(event_id % 3 AS VARCHAR(20)) || '.png' ELSE '/api' END",
    "referer": "CASE event_id % 3 WHEN 0 THEN 'https://h/p' || CAST(event_id % 7 AS VARCHAR(20)) || '.html' "
               "WHEN 1 THEN 'https://h/' ELSE '' END",
    "body_size": "CASE WHEN event_type = 'signup' THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END",
    "processing_ms": "value",
    "source_ip": "'10.0.' || CAST(user_id % 4 AS VARCHAR(20)) || '.' || CAST(event_id % 8 AS VARCHAR(20))",
    "source_port": "CAST(40000 + user_id % 3 AS VARCHAR(20))",
    "sf_mode": "CASE event_type WHEN 'view' THEN 'navigate' WHEN 'signup' THEN 'cors' WHEN 'error' THEN '' "
               "ELSE 'no-cors' END",
    "sf_dest": "CASE event_type WHEN 'view' THEN 'document' WHEN 'signup' THEN 'empty' WHEN 'click' THEN 'script' "
               "WHEN 'purchase' THEN 'image' ELSE '' END",
    "sf_site": "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'same-origin' END",
    "sf_user": "CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN '?1' "
               "WHEN event_id % 11 = 0 THEN '?1' ELSE '' END",
    "ua": "CASE user_id % 5 WHEN 0 THEN 'Mozilla/5.0 (X11; Linux x86_64) HeadlessChrome/138.0 Safari/537.36' "
          "WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/122.0 Safari/537.36 Edg/122.0' "
          "WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 13_2 like Mac OS X) Version/13.0 Mobile/15E148 Safari/604.1' "
          "WHEN 3 THEN 'python-client/2.1' "
          "ELSE 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Chrome/145.0 Safari/537.36' END",
    "ch_ua": "CASE event_id % 3 WHEN 0 THEN '\"Chromium\";v=\"145\", \"Not.A/Brand\";v=\"8\"' "
             "WHEN 1 THEN '\"HeadlessChrome\";v=\"138\", \"Chromium\";v=\"138\"' ELSE '' END",
    "ch_mobile": "CASE event_id % 4 WHEN 0 THEN '?1' ELSE '?0' END",
    "ch_platform": "CASE event_id % 3 WHEN 0 THEN '\"macOS\"' WHEN 1 THEN '\"Windows\"' ELSE '' END",
    "priority": "CASE event_id % 5 WHEN 0 THEN 'u=0, i' WHEN 1 THEN 'u=1' WHEN 2 THEN 'u=4, i' "
                "WHEN 3 THEN 'u=3' ELSE '' END",
    "header_csv": "CASE event_id % 4 WHEN 0 THEN 'Accept,User-Agent,Priority,Sec-Ch-Ua' "
                  "WHEN 1 THEN 'User-Agent,Accept,Accept-Language,Connection' "
                  "WHEN 2 THEN 'Accept,User-Agent,X-Request-Id,Te' "
                  "ELSE 'User-Agent,Accept,Cache-Control,Upgrade-Insecure-Requests,X-Trace' END",
    "ja3": "'j' || CAST(user_id % 9 AS VARCHAR(20)) || CAST(event_id % 2 AS VARCHAR(20))",
    "ja4": "CASE user_id % 4 WHEN 0 THEN 't13d1516h2_aaaaaaaaaaaa_bbbbbbbbbbbb' "
           "WHEN 1 THEN 't13d2812h2_cccccccccccc_dddddddddddd' "
           "WHEN 2 THEN 't13d1517h2_aaaaaaaaaaaa_eeeeeeeeeeee' ELSE 'bad' END",
    "negotiated_proto": "CASE WHEN user_id % 4 = 3 THEN 'http/1.1' ELSE 'h2' END",
    "h2_fp": "CASE user_id % 4 WHEN 0 THEN '1:65536;2:0;4:6291456;6:262144|15663105|1:1:0:256,3:1:0:220|m,a,s,p' "
             "WHEN 1 THEN '1:65536;4:131072|2147418112||m,s,p,a' "
             "WHEN 2 THEN '1:65536;4:6291456|8323072|1:1:0:256,3:1:0:110,5:1:0:110|m,s,a,p' ELSE '' END",
    "cipher_csv": "CASE user_id % 3 WHEN 0 THEN '2570,4865,4866,49195' WHEN 1 THEN '4865,4867,156' ELSE '' END",
    "curve_csv": "CASE user_id % 3 WHEN 0 THEN '6682,4588,29,23' WHEN 1 THEN '25497,29' ELSE '29,23' END",
    "version_csv": "CASE user_id % 3 WHEN 0 THEN '2570,772,771' WHEN 1 THEN '771,772' ELSE '771,770' END",
    "sig_csv": "CASE user_id % 3 WHEN 0 THEN '1027,2052,1025' WHEN 1 THEN '2052,2053,9999' ELSE '' END",
    "h2_order": "CASE user_id % 4 WHEN 0 THEN ':method,:authority,:scheme,:path' "
                "WHEN 1 THEN ':method,:scheme,:path,:authority' WHEN 2 THEN ':method,:scheme,:authority,:path' ELSE '' END",
    "tls_version": "CASE user_id % 3 WHEN 2 THEN 'TLS 1.2' ELSE 'TLS 1.3' END",
    "sni_present": "user_id % 7 <> 0",
    "accept": "CASE event_id % 3 WHEN 0 THEN '*/*' WHEN 1 THEN 'text/html' ELSE '' END",
    "accept_encoding": "CASE event_id % 2 WHEN 0 THEN 'gzip, br' ELSE '' END",
    "upgrade_insecure": "CASE event_id % 4 WHEN 3 THEN '1' ELSE '' END",
    "alpn_csv": "CASE user_id % 4 WHEN 0 THEN 'h2,http/1.1' WHEN 1 THEN 'h2' WHEN 2 THEN 'http/1.1' ELSE '' END",
}

IX = {
    "agent": REQ["agent"],
    "trial": REQ["trial"],
    "id": "event_id",
    "us": "{US}",
    "page": "'page_' || CAST(event_id % 3 AS VARCHAR(20))",
    "session": "'s_' || CAST(user_id AS VARCHAR(20)) || '_' || CAST(event_id % 3 AS VARCHAR(20))",
    "flush_seq": "event_id % 10",
    "type": "CASE event_id % 13 WHEN 0 THEN 'page' WHEN 1 THEN 'mousemove' WHEN 2 THEN 'mousemove' "
            "WHEN 3 THEN 'mousedown' WHEN 4 THEN 'mouseup' WHEN 5 THEN 'click' WHEN 6 THEN 'focus' "
            "WHEN 7 THEN 'input' WHEN 8 THEN 'keydown' WHEN 9 THEN 'scroll' WHEN 10 THEN 'visibility' "
            "WHEN 11 THEN 'app_event' ELSE 'page' END",
    "action": "CASE event_id % 13 WHEN 0 THEN 'load' WHEN 12 THEN 'pagehide' END",
    "state": "CASE WHEN event_id % 13 = 10 THEN CASE WHEN event_id % 2 = 0 THEN 'hidden' ELSE 'visible' END END",
    "target": "CASE event_id % 4 WHEN 0 THEN 'input#mail[text]' WHEN 1 THEN 'input#mail' "
              "WHEN 2 THEN 'a.nav-tab[V2]' ELSE 'button.go[Go]' END",
    "x": "CAST((event_id * 37) % 1280 AS DOUBLE)",
    "y": "CAST((event_id * 53) % 720 AS DOUBLE)",
    "key": "CASE event_id % 5 WHEN 0 THEN 'Enter' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'Tab' END",
    "ctrl": "event_id % 7 = 0",
    "scroll_y": "CAST(event_id % 900 AS DOUBLE)",
    "log_event": "CASE WHEN event_id % 13 = 11 THEN CASE event_id % 3 WHEN 0 THEN 'select' WHEN 1 THEN 'hover' "
                 "ELSE 'submit' END END",
    "detail": "CASE WHEN event_id % 13 = 11 THEN CASE event_id % 5 WHEN 0 THEN 'Subscribed' WHEN 1 THEN 'BLOCKED' "
              "WHEN 2 THEN 'CORRECT' WHEN 3 THEN 'INCORRECT' ELSE 'retry' END END",
}

WINDOWS = {
    "trial": "n_nationkey",
    "s_us": "1704067200000000 + CAST(n_nationkey AS BIGINT) * 86400000000",
    "e_us": "1704067200000000 + CAST(n_nationkey AS BIGINT) * 86400000000 + 43200000000",
    "rc": "n_nationkey % 2",
}

PRED = {
    "id": "doc_id",
    "y": "'c' || CAST((quality + doc_id % 2) AS VARCHAR(20))",
    "yhat": "'c' || CAST((toxic + doc_id % 3) AS VARCHAR(20))",
    "fold": "doc_id % 5",
}

# Thresholds for the views, whose events lie hours apart.
VIEW_UNLOAD_MS = 21_600_000
VIEW_BURST_MS = 7_200_000


def select_sql(view: dict[str, str], table: str, us: str) -> str:
    cols = ", ".join(f"{expr.replace('{US}', us)} AS {name}" for name, expr in view.items())
    return f"SELECT {cols} FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, view: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e.replace('{US}', US_SPARK)} AS {n}" for n, e in view.items()])


def _csv(name: str, kind: str) -> F.Column:
    parts = F.filter(F.split(F.col(name), ","), lambda v: v != "")
    return parts.cast(f"array<{kind}>")


def with_lists(df: DataFrame) -> DataFrame:
    """Lists of the view, as the reader would give them."""
    return df.select(
        "*", _csv("header_csv", "string").alias("header_names"),
        _csv("cipher_csv", "int").alias("ciphers"), _csv("curve_csv", "int").alias("curves"),
        _csv("sig_csv", "int").alias("sigs"), _csv("version_csv", "int").alias("versions"),
        _csv("alpn_csv", "string").alias("alpn"))


def requests_from(events: DataFrame) -> DataFrame:
    return with_lists(_view(events, REQ))


def interactions_from(events: DataFrame) -> DataFrame:
    return _view(events, IX)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_from(table(spark, sf_dir, "events"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "nation"), WINDOWS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "labels"), PRED)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def nested_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request view folded back into the nested log record."""
    r = requests(spark, sf_dir)
    return r.select(
        "agent", "trial", F.col("id").cast("string").alias("id"),
        F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789Z'").alias("timestamp"),
        "source_ip", "source_port",
        F.struct(F.lit("TLS 1.3").alias("version"), F.lit("TLS_AES_128_GCM_SHA256").alias("cipher_suite"),
                 F.col("ja3").alias("ja3_hash"), F.col("ja4").alias("ja4_hash")).alias("tls"),
        F.when(F.col("h2_fp") != "", F.struct(F.col("h2_fp").alias("akamai_fingerprint"))).alias("http2"),
        F.struct("method", "path", F.lit("HTTP/2.0").alias("protocol"), F.lit("h").alias("host"),
                 F.transform("header_names", lambda n: F.struct(n.alias("name"), F.lit("v").alias("value")))
                 .alias("headers_ordered"),
                 F.lit(None).cast("string").alias("body_sha256"), "body_size",
                 F.col("ua").alias("user_agent"),
                 F.nullif("referer", F.lit("")).alias("referer")).alias("http"),
        F.col("processing_ms").alias("processing_time_ms"))


def single_event_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction view as flush records that carry one event each."""
    i = interactions(spark, sf_dir)
    at = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.struct(at.alias("t"), (F.col("us") / 1000.0).alias("ms"), "type", "target", "x", "y", "key", "ctrl",
                     F.col("scroll_y").alias("scrollY"), "action", "state", F.col("log_event").alias("event"),
                     "detail", F.col("id").cast("string").alias("logId"))
    return i.select("agent", "trial", "session", F.col("page"), F.col("flush_seq").cast("int").alias("flushSeq"),
                    F.lit(1).alias("eventCount"), F.array(event).alias("batch"), at.alias("receivedAt"))
