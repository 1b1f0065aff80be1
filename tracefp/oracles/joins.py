"""DuckDB checks of attribution, merged streams, checkpoints and prefixes."""

from tracefp.oracles.base import query, r6
from tracefp.oracles.traces import B as BEACONS
from tracefp.oracles.traces import NOBEACON
from tracefp.oracles.traces import T as TEMPORAL

K = "agent, trial"
WINS = {"w": "SELECT 'src_' || CAST(trial % 3 AS VARCHAR) AS agent, trial, s_us, e_us, rc FROM win"}
ATTR = {**WINS, "att": "SELECT w.agent, w.trial, w.rc, r.* EXCLUDE (agent, trial) FROM req r JOIN w ON r.us BETWEEN w.s_us AND w.e_us"}
_FIELDS = ["source_ip", "ja3", "ja4", "protocol", "h2_fp", "path", "header_order"]
VALS = {**ATTR, "att2": "SELECT *, CASE WHEN negotiated_proto = 'h2' THEN 'HTTP/2.0' ELSE 'HTTP/1.1' END AS protocol, "
                        "array_to_string(header_names, ',') AS header_order FROM att",
        "vals": " UNION ALL ".join(f"SELECT {K}, '{f}' AS field, {f} AS value, count(*) AS n FROM att2 GROUP BY {K}, {f}"
                                   for f in _FIELDS)}
EXPECTED = "('10.0.0.0', '10.0.1.1', '10.0.2.2', '10.0.3.3', '10.0.0.4', '10.0.1.5', '10.0.2.6')"
SUMM = {**VALS, "summ": f"""SELECT w.agent, w.trial, w.rc, count(a.id) AS record_count,
 {', '.join(f'count(DISTINCT a.{f}) AS n_{f}' for f in _FIELDS)}, count(a.id) = 0 AS is_empty,
 count_if(a.id IS NOT NULL AND a.source_ip NOT IN {EXPECTED}) AS n_anomalies
 FROM w LEFT JOIN att2 a ON a.agent = w.agent AND a.trial = w.trial GROUP BY w.agent, w.trial, w.rc"""}

STREAM = {"st": f"""SELECT {K}, id, us, 0 AS kind, method, path FROM req UNION ALL
 SELECT {K}, id, us, 1 AS kind, NULL AS method, NULL AS path FROM ix"""}
CPS = {**STREAM,
       "s1": f"""SELECT *, coalesce(kind = 0 AND method = 'GET' AND path LIKE '%.html', false) AS pg FROM st""",
       "s2": f"""SELECT *, sum(kind) OVER w AS n_int, sum(1 - kind) OVER w AS n_req, sum(pg::INT) OVER w AS seg,
 last_value(CASE WHEN pg THEN path END IGNORE NULLS) OVER w AS page_path, min(us) OVER (PARTITION BY {K}) AS st0 FROM s1
 WINDOW w AS (PARTITION BY {K} ORDER BY us, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
       "s3": f"SELECT *, sum(kind) OVER (PARTITION BY {K}, seg ORDER BY us, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM s2"}
PRE = {"rk": f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY us, id) AS rn, count(*) OVER (PARTITION BY {K}) AS tot FROM req",
       "pre": "SELECT r.agent, r.trial, r.id, r.us, n.n AS n_req FROM rk r JOIN range(1, 31) n(n) ON r.rn <= n.n AND n.n <= least(r.tot, 30)",
       "cut": f"SELECT {K}, n_req, max(us) AS cutoff_us FROM pre GROUP BY {K}, n_req"}

SQL = {
    "flatten_requests": query(
        """SELECT agent, trial, CAST(id AS VARCHAR) AS id, us, source_ip, method, path, 'HTTP/2.0' AS protocol, 'h' AS host, referer, body_size,
        CAST(NULL AS VARCHAR) AS body_sha256, processing_ms, 'TLS 1.3' AS tls_version, 'TLS_AES_128_GCM_SHA256' AS cipher_suite, ja3, ja4,
        nullif(h2_fp, '') AS h2_fp, len(header_names) AS n_headers, ua FROM req""", "req"),
    "attribute_requests": query(f"SELECT {K}, id, rc FROM att", "req", "win", extra=ATTR),
    "attribute_requests_half_open": query(
        f"SELECT w.agent, w.trial, r.id FROM req r JOIN w ON r.us >= w.s_us AND r.us < w.e_us", "req", "win", extra=WINS),
    "attribute_by_marker": query(
        "SELECT w.agent, w.trial, r.id FROM req r JOIN w ON r.us BETWEEN w.s_us - 5000000 AND w.e_us + 5000000 "
        "WHERE contains(r.ua, 'Chrome')", "req", "win", extra=WINS),
    "attribute_flushes": query(
        """SELECT DISTINCT w.agent, w.trial, f.session, f.flush_seq FROM (SELECT session, flush_seq, list(us) AS ts FROM ix
        GROUP BY session, flush_seq) f JOIN w ON len(list_filter(f.ts, lambda t: t >= w.s_us AND t <= w.e_us)) > 0""",
        "ix", "win", extra=WINS),
    "egress_anomalies": query(f"SELECT {K}, id, source_ip FROM att WHERE source_ip NOT IN {EXPECTED}", "req", "win", extra=ATTR),
    "attribution_values": query(f"SELECT {K}, field, value, n FROM vals", "req", "win", extra=VALS),
    "attribution_summary": query("SELECT * FROM summ", "req", "win", extra=SUMM),
    "source_summary": query(
        "SELECT agent, count(*) AS trial_count, CAST(sum(record_count) AS BIGINT) AS record_count, count_if(is_empty) AS empty_trials, "
        "count_if(n_anomalies > 0) AS anomaly_trials FROM summ GROUP BY agent", "req", "win", extra=SUMM),
    "fingerprint_union": query(
        "SELECT agent, field, value, count(*) AS n_trials, CAST(sum(n) AS BIGINT) AS n_requests FROM vals "
        "WHERE field IN ('ja3', 'ja4', 'protocol') GROUP BY agent, field, value", "req", "win", extra=VALS),
    "source_value_counts": query(
        "SELECT agent, field, value, count(*) AS n_trials, CAST(sum(n) AS BIGINT) AS n_requests FROM vals "
        "WHERE field IN ('header_order', 'path', 'h2_fp') GROUP BY agent, field, value", "req", "win", extra=VALS),
    "read_manifest": """SELECT 'crawler' AS agent, CAST(user_id AS INT) AS trial, epoch_us(min(ts)) AS s_us, epoch_us(max(ts)) AS e_us,
        CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(user_id % 2 AS VARCHAR) END AS rc FROM events GROUP BY user_id""",
    "read_run_windows": """SELECT 'client_' || CAST(user_id % 4 AS VARCHAR) AS agent, 'trial-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS trial,
        epoch_us(min(ts)) AS s_us, epoch_us(max(ts)) AS e_us FROM events GROUP BY user_id""",
    "read_local_windows": """SELECT 'human' AS agent, 'trial-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') AS trial,
        1704067200000000 + CAST(n_nationkey AS BIGINT) * 86400000000 + (CAST(n_nationkey % 10 AS BIGINT) + 13) * 3600000000 + 300000000 AS s_us,
        1704067200000000 + CAST(n_nationkey AS BIGINT) * 86400000000 + (CAST(n_nationkey % 10 AS BIGINT) + 14) * 3600000000 + 2400000000 + 59000000 AS e_us
        FROM nation""",
    "merged_event_stream": query(
        f"SELECT {K}, id, us, 'request' AS kind, method, path, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS page FROM req "
        f"UNION ALL SELECT {K}, id, us, 'interaction', NULL, NULL, type, page FROM ix", "req", "ix"),
    "checkpoints": query(
        f"""SELECT {K}, id, us, CASE WHEN pg THEN 'page' ELSE 'event' END AS checkpoint, CASE WHEN pg THEN CAST(seg AS BIGINT) END AS page_index,
        CASE WHEN NOT pg THEN CAST(n_int AS BIGINT) END AS event_index, coalesce(page_path, '') AS page_path,
        CAST(n_req AS BIGINT) AS n_requests, CAST(n_int AS BIGINT) AS n_int_events, {r6('(us - st0) / 1e6', 'elapsed_s')}
        FROM s3 WHERE pg OR (kind = 1 AND since > 0 AND since % 3 = 0)""", "req", "ix", extra=CPS),
    "request_prefixes": query(f"SELECT {K}, n_req, id FROM pre", "req", extra=PRE),
    "prefix_cutoffs": query(f"SELECT {K}, n_req, cutoff_us FROM cut", "req", extra=PRE),
    "events_at_cutoff": query(
        "SELECT c.agent, c.trial, c.n_req, i.id FROM cut c JOIN ix i ON i.agent = c.agent AND i.trial = c.trial AND i.us <= c.cutoff_us",
        "req", "ix", extra=PRE),
    "stream_logs": query(
        "SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS date, count(*) AS n, max(us) AS last_us FROM req GROUP BY 1", "req"),
    "stream_attribution": query("SELECT agent, trial, id FROM att", "req", "win", extra=ATTR),
    "stream_input_monitor": query(f"SELECT {K}, id, us, session, page, type, target, log_event, detail FROM ix WHERE type IN "
                                  "('input', 'change', 'app_event')", "ix"),
    "stream_beacon_filter": query(
        f"SELECT {K}, id, us, method, path, referer, body_size, ua, len(header_names) AS n_names FROM kept", "req", extra={**BEACONS, "kept": NOBEACON}),
    "stream_beacon_decisions": query(f"SELECT {K}, id, is_beacon FROM flagged", "req", extra=BEACONS),
    "stream_checkpoints": query(
        f"""SELECT {K}, id, us, CASE WHEN pg THEN 'page' ELSE 'event' END AS checkpoint, CASE WHEN pg THEN CAST(seg AS BIGINT) END AS page_index,
        CASE WHEN NOT pg THEN CAST(n_int AS BIGINT) END AS event_index, coalesce(page_path, '') AS page_path,
        CAST(n_req AS BIGINT) AS n_requests, CAST(n_int AS BIGINT) AS n_int_events
        FROM s3 WHERE pg OR (kind = 1 AND since > 0 AND since % 3 = 0)""", "req", "ix", extra=CPS),
    "parse_event_time": query("SELECT CAST(id AS VARCHAR) AS id, us FROM req", "req"),
    "header_fallback": query("SELECT id, sf_mode FROM req", "req"),
    "read_requests": query(
        """SELECT agent, trial, CAST(id AS VARCHAR) AS id, us, method, path, referer, body_size, ja4, nullif(h2_fp, '') AS h2_fp,
        len(header_names) AS n_headers, ua FROM req""", "req"),
    "read_interactions": query(
        f"SELECT {K}, id, us, session, page, flush_seq, type, action, state, target, x, y, key, ctrl, scroll_y, log_event, detail FROM ix", "ix"),
    "feature_round_trip": query(
        f"SELECT {K}, {r6('req_rate_hz', 'req_rate_hz')}, {r6('iri_median_ms', 'iri_median_ms')}, "
        f"{r6('page_dwell_mean_s', 'page_dwell_mean_s')} FROM temporal", "req", extra=TEMPORAL),
    "beacon_ids": query(f"SELECT {K}, id FROM flagged WHERE is_beacon", "req", extra=BEACONS),
    "metric_histogram": query(
        f"""SELECT CAST(least(floor((n - lo) / (hi - lo) * 15), 14) AS INT) AS bin, count(*) AS n, {r6('any_value(mean)', 'mean')}
        FROM cnt, (SELECT min(n) AS lo, max(n) AS hi, avg(n) AS mean FROM cnt) GROUP BY 1""", "req",
        extra={"cnt": f"SELECT {K}, CAST(count(*) AS DOUBLE) AS n FROM req GROUP BY {K}"}),
}
