"""DuckDB checks of the request reports, written over whole tables."""

from tracefp.oracles.base import query, r6
from tracefp.views import VIEW_BURST_MS, VIEW_UNLOAD_MS

K = "agent, trial"

IRI = f"""SELECT *, (us - lag(us) OVER (PARTITION BY {K} ORDER BY us, id)) AS gap_us FROM flags"""
DWELL = f"""SELECT {K}, id, us, path,
 (us - lag(us) OVER (PARTITION BY {K} ORDER BY us, id)) AS dwell_us FROM flags WHERE is_page"""
DW = f"SELECT {K}, avg(dwell_us) / 1e6 m, max(dwell_us) / 1e6 x, stddev_samp(dwell_us) / 1e6 s FROM dwell GROUP BY {K}"
STATS_BODY = f"""SELECT agent, trial, count(*) AS n_requests, CAST(sum(is_page::INT) AS BIGINT) AS n_pages,
 CAST(sum(is_collect::INT) AS BIGINT) AS n_collect_posts, (max(us) - min(us)) / 1000000.0 AS duration_s,
 CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1000000.0) ELSE 0 END AS req_rate_hz,
 avg(gap_us) / 1000.0 AS iri_mean_ms, quantile_cont(CAST(gap_us AS DOUBLE), 0.5) / 1000.0 AS iri_median_ms, stddev_samp(gap_us) / 1000.0 AS iri_std_ms,
 avg(processing_ms) AS proc_mean_ms, max(processing_ms) AS proc_max_ms,
 any_value(m) AS page_dwell_mean_s, any_value(x) AS page_dwell_max_s, any_value(s) AS page_dwell_std_s
 FROM iri LEFT JOIN dw USING (agent, trial) GROUP BY agent, trial"""
STATS = {"iri": IRI, "dwell": DWELL, "dw": DW, "stats": STATS_BODY}
METRICS = ["duration_s", "req_rate_hz", "iri_mean_ms", "iri_median_ms", "iri_std_ms", "proc_mean_ms",
           "proc_max_ms", "page_dwell_mean_s", "page_dwell_max_s", "page_dwell_std_s"]
COUNTS = ["n_requests", "n_pages", "n_collect_posts"]

BEACON = f"""SELECT p.agent, p.trial, p.id, p.us,
 EXISTS (SELECT 1 FROM req g WHERE g.trial = p.trial AND g.agent = p.agent AND g.path LIKE '%.html'
   AND g.us > p.us AND g.us <= p.us + {VIEW_UNLOAD_MS}000) AS followed,
 EXISTS (SELECT 1 FROM req o WHERE o.trial = p.trial AND o.agent = p.agent AND o.method = 'POST'
   AND o.path = '/collect' AND o.id <> p.id AND abs(o.us - p.us) <= {VIEW_BURST_MS}000) AS crowd,
 p.referer LIKE '%.html' AS named
 FROM req p WHERE p.method = 'POST' AND p.path = '/collect'"""
FLAGGED = "SELECT *, followed AND (crowd OR named) AS is_beacon FROM beacon"
B = {"beacon": BEACON, "flagged": FLAGGED}

PAGED = f"""SELECT *, last_value(CASE WHEN is_page THEN regexp_extract(path, '([^/]+\\.html)', 1) END IGNORE NULLS)
 OVER (PARTITION BY {K} ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM flags"""
BODY = f"""SELECT {K}, page, count(*) AS n_posts, avg(body_size) AS mean, quantile_cont(body_size, 0.5) AS median,
 stddev_samp(body_size) AS std, min(body_size) AS min, max(body_size) AS max
 FROM paged WHERE path = '/collect' AND method = 'POST' AND page IS NOT NULL GROUP BY {K}, page"""

NOBEACON = "SELECT r.* FROM req r WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.id = r.id AND f.is_beacon)"
_KEPT_FLAGS = """SELECT *, path LIKE '%.html' AS is_page, path = '/collect' AS is_collect FROM kept"""

NOCOLLECT = """SELECT *, path LIKE '%.html' AS is_page, path = '/collect' AS is_collect,
 (NOT path LIKE '%.html' AND method = 'GET') AS is_subres FROM req WHERE NOT (method = 'POST' AND path = '/collect')"""
P2S = f"""SELECT {K}, avg(nx - us) / 1000.0 AS iri_page_to_subres_ms FROM (SELECT p.agent, p.trial, p.id, p.us,
 (SELECT min(s.us) FROM flags s WHERE s.agent = p.agent AND s.trial = p.trial AND s.is_subres AND s.us > p.us) AS nx
 FROM flags p WHERE p.is_page) GROUP BY {K}"""
BURST = f"""SELECT {K}, avg(spread) / 1000.0 AS subresource_burst_ms FROM (SELECT {K}, pus, count(*) n,
 (max(us) - min(us)) AS spread FROM (SELECT s.agent, s.trial, s.us,
 (SELECT max(p.us) FROM flags p WHERE p.agent = s.agent AND p.trial = s.trial AND p.is_page AND p.us < s.us) AS pus
 FROM flags s WHERE s.is_subres) WHERE pus IS NOT NULL GROUP BY {K}, pus HAVING count(*) >= 2) GROUP BY {K}"""
TEMPORAL = f"""SELECT s.agent, s.trial, s.req_rate_hz, coalesce(s.iri_median_ms, 0) AS iri_median_ms,
 CASE WHEN n_requests > 1 THEN iri_std_ms ELSE 0 END AS iri_std_ms,
 coalesce(page_dwell_mean_s, 0) AS page_dwell_mean_s,
 CASE WHEN n_pages > 1 THEN page_dwell_std_s ELSE 0 END AS page_dwell_std_s,
 p.iri_page_to_subres_ms, b.subresource_burst_ms
 FROM stats s LEFT JOIN p2s p USING (agent, trial) LEFT JOIN brst b USING (agent, trial)"""
# the same tables over requests without collect posts
T = {"flags": NOCOLLECT, **STATS, "p2s": P2S, "brst": BURST, "temporal": TEMPORAL}
T_COLS = ["req_rate_hz", "iri_median_ms", "iri_std_ms", "page_dwell_mean_s", "page_dwell_std_s",
          "iri_page_to_subres_ms", "subresource_burst_ms"]


def clipped_histogram(src: str, value: str, q: float, bins: int) -> dict[str, str]:
    return {
        "clip": f"SELECT {K}, quantile_cont(CAST({value} AS DOUBLE), {q}) AS c FROM {src} GROUP BY {K}",
        "vals": f"SELECT s.agent, s.trial, least({value}, c) AS v FROM {src} s JOIN clip USING (agent, trial) "
                "WHERE NOT is_first",
        "span": f"SELECT {K}, min(v) lo, max(v) hi, avg(v) mean FROM vals GROUP BY {K}",
        "span2": "SELECT agent, trial, mean, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END lo, "
                 "CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END hi FROM span",
        "binned": f"SELECT v.agent, v.trial, CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) "
                  "AS bin, mean FROM vals v JOIN span2 USING (agent, trial)",
    }


SQL = {
    "request_flags": query("SELECT agent, trial, id, is_page, is_collect, is_subres, is_fetch FROM flags", "flags"),
    "drop_collect_posts": query(
        "SELECT agent, trial, count(*) AS n_total, CAST(sum((method='POST' AND path='/collect')::INT) AS BIGINT) "
        "AS n_removed, CAST(sum((NOT (method='POST' AND path='/collect'))::INT) AS BIGINT) AS n_kept "
        "FROM req GROUP BY agent, trial", "req"),
    "request_intervals": query(
        f"SELECT {K}, id, " + r6(f"(us - min(us) OVER (PARTITION BY {K})) / 1000000.0", "elapsed_s") + ", "
        + r6(f"coalesce((us - lag(us) OVER (PARTITION BY {K} ORDER BY us, id)) / 1000.0, 0)", "iri_ms")
        + " FROM req", "req"),
    "page_attribution": query(f"SELECT {K}, id, page FROM paged", "flags", extra={"paged": PAGED}),
    "page_dwell": query(f"SELECT {K}, id, path, {r6('dwell_us / 1e6', 'dwell_s')} FROM dwell", "flags",
                        extra={"dwell": DWELL}),
    "next_page_gap": query(
        f"""SELECT p.agent, p.trial, p.id, {r6('''((SELECT min(g.us) FROM req g WHERE g.agent = p.agent
        AND g.trial = p.trial AND g.path LIKE '%.html' AND g.us > p.us) - p.us) / 1000.0''', 'gap_ms')}
        FROM req p WHERE p.method = 'POST' AND p.path = '/collect'""", "req"),
    "burst_neighbour": query("SELECT agent, trial, id, crowd AS in_burst FROM beacon", "req",
                             extra={"beacon": BEACON}),
    "beacon_flags": query("SELECT agent, trial, id, is_beacon FROM flagged", "req", extra=B),
    "beacon_flags_aggressive": query("SELECT agent, trial, id, followed AS is_beacon FROM beacon", "req",
                                     extra={"beacon": BEACON}),
    "beacon_filter": query(
        f"SELECT {K}, id, " + r6(f"(us - min(us) OVER (PARTITION BY {K})) / 1000000.0", "elapsed_s") + ", "
        + r6(f"coalesce((us - lag(us) OVER (PARTITION BY {K} ORDER BY us, id)) / 1000.0, 0)", "iri_ms")
        + " FROM kept", "req", extra={**B, "kept": NOBEACON}),
    "filter_report": query(
        """SELECT r.agent, r.trial, count(*) AS n_raw, CAST(sum((r.method = 'POST')::INT) AS BIGINT) AS collect_posts_raw,
        CAST(sum(coalesce(f.is_beacon, false)::INT) AS BIGINT) AS n_removed,
        CAST(sum((NOT coalesce(f.is_beacon, false))::INT) AS BIGINT) AS n_filtered,
        CAST(sum((r.method = 'POST')::INT) - sum(coalesce(f.is_beacon, false)::INT) AS BIGINT) AS collect_posts_kept
        FROM req r LEFT JOIN flagged f ON f.id = r.id GROUP BY r.agent, r.trial""", "req", extra=B),
    "page_to_subresource": query(f"SELECT {K}, {r6('iri_page_to_subres_ms', 'iri_page_to_subres_ms')} FROM p2s",
                                 "flags", extra={"p2s": P2S}),
    "subresource_burst": query(
        f"""SELECT s.agent, s.trial, {r6('b.subresource_burst_ms', 'subresource_burst_ms')}
        FROM (SELECT DISTINCT s.agent, s.trial FROM flags s WHERE s.is_subres AND EXISTS (SELECT 1 FROM flags p
        WHERE p.agent = s.agent AND p.trial = s.trial AND p.is_page AND p.us < s.us)) s
        LEFT JOIN brst b USING (agent, trial)""", "flags", extra={"brst": BURST}),
    "trace_temporal_stats": query(
        f"SELECT {K}, {', '.join(COUNTS)}, {', '.join(r6(m, m) for m in METRICS)} FROM stats", "flags", extra=STATS),
    "page_spatial_stats": query(
        f"""SELECT {K}, page, count(*) AS n_requests, CAST(sum(is_collect::INT) AS BIGINT) AS n_collect,
        CAST(sum(body_size) AS BIGINT) AS total_body_bytes, max(body_size) AS max_body_bytes,
        {r6('avg(processing_ms)', 'mean_proc_ms')} FROM paged WHERE page IS NOT NULL GROUP BY {K}, page""",
        "flags", extra={"paged": PAGED}),
    "body_size_by_page": query(
        f"SELECT {K}, page, n_posts, min, max, {r6('mean', 'mean')}, {r6('median', 'median')}, {r6('std', 'std')} "
        "FROM body", "flags", extra={"paged": PAGED, "body": BODY}),
    "body_size_rollup": query(
        f"""SELECT page, CAST(sum(n_posts) AS BIGINT) AS n_posts, {r6('avg(mean)', 'mean')},
        {r6('quantile_cont(median, 0.5)', 'median')}, {r6('stddev_samp(mean)', 'std')}, min(min) AS min,
        max(max) AS max FROM body GROUP BY page""", "flags", extra={"paged": PAGED, "body": BODY}),
    "trace_summary_mean_std": query(
        "SELECT metric, " + r6("avg(value)", "mean") + ", " + r6("stddev_samp(value)", "std")
        + ", count(value) AS n FROM (" + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM stats"
            for m in COUNTS + METRICS[:-1]) + ") GROUP BY metric",
        "req", extra={**B, "kept": NOBEACON, "flags": _KEPT_FLAGS, **STATS}),
    "page_visit_rollup": query(
        f"""SELECT page, count(*) AS visits, {r6('avg(n)', 'req_per_visit')} FROM (SELECT {K}, page, count(*) n
        FROM paged WHERE page IS NOT NULL GROUP BY {K}, page) GROUP BY page""", "flags", extra={"paged": PAGED}),
    "trace_fingerprint_counts": query(
        f"""SELECT {K}, count(DISTINCT ja3) AS ja3_unique, count(DISTINCT ja4) AS ja4_unique,
        count(DISTINCT ua) AS ua_unique, first(ja3 ORDER BY us, id) AS ja3_first FROM req GROUP BY {K}""", "req"),
    "temporal_trial_features": query(
        f"SELECT {K}, {', '.join(r6(c, c) for c in T_COLS)} FROM temporal", "req", extra=T),
    "agent_rate_dispersion": query(
        f"""SELECT agent, {r6('quantile_cont(req_rate_hz, 0.5)', 'req_rate_hz_median')},
        {r6('CASE WHEN avg(req_rate_hz) > 0 THEN stddev_samp(req_rate_hz) / avg(req_rate_hz) ELSE 0 END',
            'req_rate_hz_cv')} FROM temporal GROUP BY agent""", "req", extra=T),
    "agent_feature_summary": query(
        "SELECT agent, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std"
                                     for c in T_COLS) + " FROM temporal GROUP BY agent", "req", extra=T),
    "trial_ordinal": query(
        f"SELECT {K}, row_number() OVER (PARTITION BY agent ORDER BY trial) AS idx "
        "FROM (SELECT DISTINCT agent, trial FROM req)", "req"),
    "agent_rate_matrix": query(
        f"""SELECT {K}, row_number() OVER (PARTITION BY agent ORDER BY trial) AS idx,
        {r6('req_rate_hz', 'req_rate_hz')},
        {r6('stddev_samp(req_rate_hz) OVER (PARTITION BY agent) / avg(req_rate_hz) OVER (PARTITION BY agent)',
            'rate_cv')} FROM stats""", "flags", extra=STATS),
    "agent_interval_means": query(
        f"SELECT agent, {r6('avg(iri_mean_ms) / 1000', 'iri_mean_s')}, {r6('avg(iri_std_ms) / 1000', 'iri_std_s')} "
        "FROM stats GROUP BY agent", "flags", extra=STATS),
    "interval_histogram": query(
        f"SELECT {K}, bin, count(*) AS n, round(any_value(mean), 3) AS mean_ms FROM binned GROUP BY {K}, bin", "req",
        extra={"ivl": f"SELECT {K}, coalesce((us - lag(us) OVER w) / 1000.0, 0) AS iri_ms, "
                      f"row_number() OVER w = 1 AS is_first FROM req WINDOW w AS (PARTITION BY {K} ORDER BY us, id)",
               **clipped_histogram("ivl", "iri_ms", 0.99, 30)}),
    "union_traces": query(
        f"SELECT {K}, count(*) AS n, count(CASE WHEN CAST(substr(trial, 7) AS BIGINT) % 2 = 0 THEN ua END) AS n_ua FROM req GROUP BY {K}", "req"),
}
