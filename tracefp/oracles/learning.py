"""DuckDB checks of alignment, preparation and evaluation."""

import re

from tracefp.oracles import interaction as ixo
from tracefp.oracles import traces as tro
from tracefp.oracles import web
from tracefp.oracles.base import _CTES, query, r6
from tracefp.oracles.joins import CPS, PRE

K = "agent, trial"



def _timing(name: str, src: str) -> tuple[str, str]:
    return (f"tm_{name}", f"SELECT {K}, avg(g) / 1000.0 AS {name}_mean_ms, stddev_samp(g) / 1000.0 AS {name}_std_ms FROM ({src}) GROUP BY {K}")


BEH = {
    "gaps": ixo.GAPS, "bc": ixo.BC, **ixo.BI, **ixo.BR, "bprops": ixo.page_props(), **ixo.BM, **ixo.BK, **ixo.BP, "task": ixo.TASK,
    "bscroll": f"SELECT {K}, coalesce(max(CASE WHEN type = 'scroll' THEN scroll_y END), 0) AS max_scroll_depth_px, "
               f"coalesce(avg(CASE WHEN type = 'scroll' THEN scroll_y END), 0) AS scroll_depth_mean_px FROM ix GROUP BY {K}",
    "bpages": f"SELECT {K}, count(*) AS n_unique_pages, CAST(sum(b) AS BIGINT) AS pages_visited_bitmask, avg(d) AS page_dwell_mean_s, "
              f"stddev_samp(d) AS page_dwell_std_s, min(d) AS page_dwell_min_s, max(d) AS page_dwell_max_s FROM bpp GROUP BY {K}",
    **dict([_timing("focus_to_input_latency", ixo.FOCUS_T), _timing("click_hold", ixo.HOLD_T),
            _timing("inter_page_gap", ixo.NAVG), _timing("load_to_first_interact", ixo.LOADG)]),
    "behf": f"""SELECT bc.* EXCLUDE (n_total), bc.n_events / bc.duration_s AS event_rate_hz, br.* EXCLUDE (agent, trial),
 biv.* EXCLUDE (agent, trial, iei_burst_ratio), coalesce(iei_burst_ratio, 0) AS iei_burst_ratio, bprops.* EXCLUDE (agent, trial),
 bm.* EXCLUDE (agent, trial), bk0.* EXCLUDE (agent, trial), bscroll.* EXCLUDE (agent, trial), bpages.* EXCLUDE (agent, trial),
 task.* EXCLUDE (agent, trial), f.* EXCLUDE (agent, trial), c.* EXCLUDE (agent, trial), n.* EXCLUDE (agent, trial), l.* EXCLUDE (agent, trial)
 FROM bc LEFT JOIN br USING ({K}) LEFT JOIN biv USING ({K}) LEFT JOIN bprops USING ({K}) LEFT JOIN bm USING ({K}) LEFT JOIN bk0 USING ({K})
 LEFT JOIN bscroll USING ({K}) LEFT JOIN bpages USING ({K}) LEFT JOIN task USING ({K}) LEFT JOIN tm_focus_to_input_latency f USING ({K})
 LEFT JOIN tm_click_hold c USING ({K}) LEFT JOIN tm_inter_page_gap n USING ({K}) LEFT JOIN tm_load_to_first_interact l USING ({K})""",
}
_BEH_INT = ["n_events", "n_pages", *ixo.COUNTS, "n_inputs", "n_focus", "n_tab_switches",
            *[f"{p}__visited" for p in ixo.PAGES], "nonform_keydown_count", "n_unique_click_targets", "enter_key_count",
            "n_unique_keys", "modifier_key_count", "n_unique_pages", "pages_visited_bitmask", "n_successful_submits",
            "n_blocked_submits", "hover_reveal_correct", "dom_mismatch_correct", "dom_mismatch_wrong", "false_cue_clicks",
            "n_hover_events", "n_select_events", "delayed_feedback_retry", "delayed_feedback_completed", "nav_via_tab_clicks"]
_BEH_DBL = ["duration_s", "event_rate_hz", *ixo.RATIOS, "kbd_vs_mouse", *ixo.BI_COLS,
            *[f"{p}__{t}_prop" for p in ixo.PAGES for t in ("mousemove", "keydown", "input", "scroll", "click")],
            "nonform_keydown_ratio", *ixo.BM_DBL, "enter_key_ratio", "modifier_key_ratio", "key_entropy", "max_scroll_depth_px",
            "scroll_depth_mean_px", "page_dwell_mean_s", "page_dwell_std_s", "page_dwell_min_s", "page_dwell_max_s",
            *[f"{n}_{s}_ms" for n in ("focus_to_input_latency", "click_hold", "inter_page_gap", "load_to_first_interact")
              for s in ("mean", "std")]]

RQ = {**web.HCLEAN, **web.http_features(), **web.FCLEAN, **web.tls_features(),
      "tflags": tro.NOCOLLECT}
# the temporal tables over their own flags table
RQ |= {n: sql.replace("FROM flags", "FROM tflags") for n, sql in tro.T.items() if n != "flags"}
SETS = {**RQ, **BEH}

CONF = {
    "cm": "SELECT {k}y, yhat, count(*) AS n FROM pred GROUP BY ALL",
    "cl": "SELECT {k}y AS class, n * (y = yhat)::INT AS tp, n AS support, 0 AS predicted FROM cm UNION ALL "
          "SELECT {k}yhat, 0, 0, n FROM cm",
    "cr": "SELECT {k}class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted, "
          "coalesce(sum(tp) / nullif(sum(predicted), 0), 0) AS precision, coalesce(sum(tp) / nullif(sum(support), 0), 0) AS recall, "
          "2 * sum(tp) / (sum(predicted) + sum(support)) AS f1 FROM cl GROUP BY ALL",
    "fm": "SELECT {k}sum(tp) / sum(support) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, "
          "CAST(sum(support) AS BIGINT) AS n FROM cr GROUP BY ALL",
}


def confusion(keys: str = "", pred: str = "pred") -> dict[str, str]:
    k = f"{keys}, " if keys else ""
    return {n: s.format(k=k).replace("FROM pred", f"FROM {pred}") for n, s in CONF.items()}


M4 = ("accuracy", "precision", "recall", "f1")
PT = {"pt": "SELECT *, 't' || CAST(id % 3 AS VARCHAR) AS tbl, fold AS n_req FROM pred"}

_TL = [c for c in web.TLS_COLS]

_EVEN = "CAST(substr(trial, 7) AS BIGINT) % 2 = 0"
# numeric header features as the encoders get them: absent priorities are zero, the version is a number
_LIVE = [(c, f"coalesce(CAST({c} AS DOUBLE), 0)" if c in ("priority_correct_rate", "priority_urgency_mode")
          else f"TRY_CAST({c} AS DOUBLE)") for c in (*web.HTTP_DOUBLE, *web.HTTP_OTHER)
         if c not in ("sf_site_mode", "ua_family_mode", "ua_os_mode", "nonstandard_names")]

def _whole(sql: str) -> str:
    return re.sub(r"\b(req|ix)\b", r"\1_all", sql)


# requests and events up to the last checkpoint of each trial, behind the names of the whole tables
_FIRES = "pg OR (kind = 1 AND since > 0 AND since % 25 = 0)"
CUT = {
    "req_all": _CTES["req"], "ix_all": _CTES["ix"], **{n: _whole(q) for n, q in CPS.items()},
    "last": f"SELECT {K}, max(struct_pack(us := us, kind := kind, id := id)) AS c FROM s3 WHERE {_FIRES} GROUP BY {K}",
    "req": f"SELECT r.* FROM req_all r JOIN last USING ({K}) WHERE r.us < c.us OR r.us = c.us AND (c.kind = 1 OR r.id <= c.id)",
    "ix": f"SELECT i.* FROM ix_all i JOIN last USING ({K}) WHERE i.us < c.us OR i.us = c.us AND c.kind = 1 AND i.id <= c.id",
    "typed": _CTES["typed"]}
_SETS = (("t", "temporal", tro.T_COLS, []), ("h", "htf", web.HTTP_DOUBLE, web.HTTP_OTHER),
         ("l", "ttf", [c for c in web.TLS_COLS if c not in web.TLS_INT], [c for c in web.TLS_COLS if c in web.TLS_INT]),
         ("b", "behf", _BEH_DBL, _BEH_INT))

_TABLES = (
    ("temporal", "temporal SEMI JOIN htf USING (agent, trial)"), ("http", "htf SEMI JOIN temporal USING (agent, trial)"),
    ("tls", "ttf SEMI JOIN htf USING (agent, trial)"), ("behavioural", "bc SEMI JOIN htf USING (agent, trial)"),
    ("combined", "htf SEMI JOIN bc USING (agent, trial)"))

_AT = f"{K}, n_req"
PREFIX = {
    **PRE,
    "pr": f"""SELECT *, us - lag(us) OVER (PARTITION BY {_AT} ORDER BY us, id) AS gap FROM (SELECT p.n_req, u.*, u.ua_family AS fam FROM pre p
 JOIN u ON u.agent = p.agent AND u.trial = p.trial AND u.id = p.id WHERE NOT (u.method = 'POST' AND u.path = '/collect'))""",
    "fams": f"SELECT {_AT}, fam, row_number() OVER (PARTITION BY {_AT} ORDER BY count(*) DESC, fam) AS place FROM pr GROUP BY {_AT}, fam",
    "pf": f"""SELECT {_AT}, CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) ELSE 0 END AS req_rate_hz,
 coalesce(quantile_cont(gap, 0.5) / 1000.0, 0) AS iri_median_ms, avg(len(header_names)) AS n_headers_mean, count(DISTINCT ja3) / count(*) AS f7_ja3_diversity
 FROM pr GROUP BY {_AT}""",
    "pe": f"""SELECT c.n_req, i.*, coalesce(i.type = 'page' AND i.action = 'load', false) AS load FROM cut c
 JOIN ix i ON i.agent = c.agent AND i.trial = c.trial AND i.us <= c.cutoff_us""",
    "pg": f"""SELECT *, us - lag(us) OVER w AS g, sum((NOT load)::INT) OVER w - (NOT load)::INT AS users FROM pe WINDOW w AS (PARTITION BY {_AT} ORDER BY us, id)""",
    "pb": f"""SELECT {_AT}, count_if(NOT load) AS n_events, count_if(type = 'keydown') AS n_keydowns,
 quantile_cont(CASE WHEN NOT load AND users > 0 AND g > 0 THEN g END, 0.5) / 1000.0 AS iei_median_ms,
 quantile_cont(CASE WHEN NOT load AND users > 0 AND g > 0 THEN g END, 0.95) / 1000.0 AS iei_p95_ms FROM pg GROUP BY {_AT} HAVING count_if(NOT load) > 0""",
    "pd": f"""SELECT {_AT}, max(d) AS page_dwell_max_s FROM (SELECT {_AT}, page, CASE WHEN count(*) > 1 THEN (max(us) - min(us)) / 1e6 END AS d FROM pe
 WHERE NOT load GROUP BY {_AT}, page) GROUP BY {_AT}"""}

SQL = {
    "prefix_features": query(
        f"SELECT {K}, CAST(n_req AS INT) AS n_req, {r6('req_rate_hz', 'req_rate_hz')}, {r6('iri_median_ms', 'iri_median_ms')}, "
        f"{r6('n_headers_mean', 'n_headers_mean')}, fam AS ua_family_mode, {r6('f7_ja3_diversity', 'f7_ja3_diversity')}, n_events, n_keydowns, "
        f"{r6('iei_median_ms', 'iei_median_ms')}, {r6('iei_p95_ms', 'iei_p95_ms')}, {r6('page_dwell_max_s', 'page_dwell_max_s')} "
        f"FROM pf JOIN pb USING ({_AT}) LEFT JOIN pd USING ({_AT}) LEFT JOIN (SELECT * FROM fams WHERE place = 1) USING ({_AT})", "typed", "ix",
        extra={"u": web.UA, **PREFIX}),
    "metrics_over_prefixes": query(
        f"""SELECT CAST(n_req AS INT) AS n_req, count(*) AS n_trials, count(*) AS n_temporal, count(*) AS n_http, count(*) AS n_tls,
        count(pb.n_events) AS n_behavioural, count(pb.n_events) AS n_combined, true AS metrics_hold FROM pf LEFT JOIN pb USING ({_AT}) GROUP BY n_req""",
        "typed", "ix", extra={"u": web.UA, **PREFIX}),
    "stream_features": query(
        f"SELECT {K}, " + ", ".join(
            [r6(f"{src}.{c}", f"{p}_{c}") for p, src, doubles, _ in _SETS for c in doubles]
            + [f"{src}.{c} AS {p}_{c}" for p, src, _, others in _SETS for c in others])
        + f" FROM temporal JOIN htf USING ({K}) JOIN ttf USING ({K}) JOIN behf USING ({K})", extra={**CUT, **SETS}),
    "stream_scoring_checks": query(
        f"""SELECT {K}, id, CASE WHEN pg THEN 'page' ELSE 'event' END AS checkpoint, coalesce(page_path, '') AS page_path,
        CAST(n_req AS BIGINT) AS n_requests_seen, CAST(n_int AS BIGINT) AS n_int_events, 5 AS n_tables, 5 AS n_models, true AS known_class,
        true AS confidence_is_top, true AS sums_to_one, true AS all_classes, true AS vote_holds FROM s3 WHERE {_FIRES}""", "req", "ix", extra=CPS),
    "behaviour_trial_features": query(
        f"SELECT {K}, {', '.join(_BEH_INT)}, {', '.join(r6(c, c) for c in _BEH_DBL)} FROM behf", "ix", extra=BEH),
    "align_feature_sets": query(
        """SELECT 'temporal' AS "table", count(*) AS n_rows, count(DISTINCT agent) AS n_agents, 7 AS n_features FROM temporal SEMI JOIN htf USING (agent, trial)
        UNION ALL SELECT 'http', count(*), count(DISTINCT agent), """ + str(len(web.HTTP_DOUBLE) + len(web.HTTP_OTHER)) + """ FROM htf SEMI JOIN temporal USING (agent, trial)
        UNION ALL SELECT 'tls', count(*), count(DISTINCT agent), 29 FROM ttf SEMI JOIN htf USING (agent, trial)
        UNION ALL SELECT 'behavioural', count(*), count(DISTINCT agent), """ + str(len(_BEH_INT) + len(_BEH_DBL)) + """ FROM bc SEMI JOIN htf USING (agent, trial)
        UNION ALL SELECT 'combined', count(*), count(DISTINCT agent), """
        + str(7 + len(web.HTTP_DOUBLE) + len(web.HTTP_OTHER) + 29 + len(_BEH_INT) + len(_BEH_DBL))
        + " FROM htf SEMI JOIN bc USING (agent, trial)", "typed", "ix", extra=SETS),
    "combined_features": query(
        f"""SELECT t.agent, t.trial, {r6('t.req_rate_hz', 'req_rate_hz')}, {r6('t.page_dwell_mean_s', 'page_dwell_mean_s')},
        {r6('b.page_dwell_mean_s', 'page_dwell_mean_s_beh')}, {r6('h.headless_rate', 'headless_rate')}, {r6('l.f2_frac_h2', 'f2_frac_h2')}, b.n_events
        FROM temporal t JOIN htf h USING ({K}) JOIN ttf l USING ({K}) JOIN behf b USING ({K})""", "typed", "ix", extra=SETS),
    "impute_median": query(
        f"SELECT {K}, " + ", ".join(r6(f"coalesce({c}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM ttf))", c) for c in _TL)
        + " FROM ttf", "req", extra={**web.FCLEAN, **web.tls_features()}),
    "multi_hot": query(
        f"SELECT {K}, " + ", ".join(f"CAST(list_contains(string_split(nonstandard_names, '|'), '{n}') AS INT) AS \"ns_hdr_{n}\""
                                    for n in ("X-Request-Id", "X-Trace")) + " FROM htf", "typed", extra={**web.HCLEAN, **web.http_features()}),
    "encode_categories": query(
        f"SELECT {K}, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1 AS INT) AS {c}"
                                    for c in ("sf_site_mode", "ua_family_mode", "ua_os_mode")) + " FROM htf", "typed",
        extra={**web.HCLEAN, **web.http_features()}),
    "encode_live_features": query(
        " UNION ALL ".join(
            f"""SELECT {K}, '{c}' AS feature, CAST(coalesce((SELECT count(*) FROM (SELECT DISTINCT coalesce({c}, 'unknown') AS v FROM htf WHERE
            {_EVEN}) seen WHERE v < coalesce(htf.{c}, 'unknown') OR coalesce(htf.{c}, 'unknown') NOT IN (SELECT coalesce({c}, 'unknown') FROM htf WHERE
            {_EVEN})), 0) AS DOUBLE) AS value FROM htf""" for c in ("sf_site_mode", "ua_family_mode", "ua_os_mode"))
        + "".join(f" UNION ALL SELECT {K}, 'ns_hdr_{n}', CAST(list_contains(string_split(nonstandard_names, '|'), '{n}') AS DOUBLE) FROM htf"
                  for n in ("X-Request-Id", "X-Trace"))
        + "".join(f" UNION ALL SELECT {K}, '{c}', round(coalesce({v}, (SELECT quantile_cont({v}, 0.5) FROM htf WHERE {_EVEN})), 6) FROM htf"
                  for c, v in _LIVE), "typed", extra={**web.HCLEAN, **web.http_features()}),
    "structural_zero": query(
        f"SELECT {K}, " + ", ".join(r6(f"coalesce({c}, 0)", c) for c in ("priority_correct_rate", "priority_urgency_mode"))
        + " FROM htf", "typed", extra={**web.HCLEAN, **web.http_features()}),
    "drop_zero_variance": query(
        " UNION ALL ".join(f"SELECT {K}, '{c}' AS feature, {r6(c, 'value')} FROM ttf WHERE (SELECT coalesce(stddev_samp({c}), 1) FROM ttf) <> 0"
                           for c in _TL), "req", extra={**web.FCLEAN, **web.tls_features()}),
    "leave_one_trial_out": query(
        f"SELECT DISTINCT {K}, replace(replace(trial, 'trial-', ''), 'trial_', '') AS fold FROM req", "req"),
    "fold_metrics": query(f"SELECT fold, n, {', '.join(r6(m, m) for m in M4)} FROM fm", "pred", extra=confusion("fold")),
    "fold_summary": query(
        "SELECT " + ", ".join(f"{r6(f'avg({m})', f'mean_{m}')}, {r6(f'stddev_pop({m})', f'std_{m}')}" for m in M4)
        + ", count(*) AS n_folds FROM fm", "pred", extra=confusion("fold")),
    "class_report": query(
        f"SELECT class, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM cr",
        "pred", extra=confusion()),
    "class_f1_by_table": query(
        "SELECT class, " + ", ".join(r6(f"max(CASE WHEN tbl = '{t}' THEN f1 END)", f"f1_{t}") for t in ("t0", "t1", "t2"))
        + " FROM cr GROUP BY class", "pred", extra={**PT, **confusion("tbl", "pt")}),
    "consensus_vote": query(
        """SELECT checkpoint, yhat AS consensus, n AS votes, CAST(tot AS BIGINT) AS n_models FROM (SELECT *, sum(n) OVER (PARTITION BY checkpoint) AS tot,
        row_number() OVER (PARTITION BY checkpoint ORDER BY n DESC, yhat) AS rn FROM (SELECT CAST(floor(id / 5) AS BIGINT) AS checkpoint,
        yhat, count(*) AS n FROM pred GROUP BY ALL)) WHERE rn = 1""", "pred"),
    "metrics_over_requests": query(
        "SELECT n_req, max(n) AS n_trials, " + ", ".join(
            f"round(max(CASE WHEN tbl = '{t}' THEN accuracy END), 4) AS accuracy_{t}, round(max(CASE WHEN tbl = '{t}' THEN f1 END), 4) AS f1_macro_{t}"
            for t in ("t0", "t1", "t2")) + " FROM fm GROUP BY n_req", "pred", extra={**PT, **confusion("n_req, tbl", "pt")}),
    "class_f1_over_requests": query("SELECT n_req, class, round(f1, 4) AS f1 FROM cr", "pred", extra={**PT, **confusion("n_req", "pt")}),
    "cross_validate_tables": query(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS "table", {K}, CAST(CAST(substr(trial, 7) AS BIGINT) % 5 AS INT) AS fold, 1 AS n, true AS known_class, true AS true_class
            FROM {src}""" for name, src in _TABLES), "typed", "ix", extra=SETS),
    "model_tables": query(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS "table", agent, CAST(dense_rank() OVER (ORDER BY agent) - 1 AS DOUBLE) AS label, count(*) AS n_trials
            FROM {src} GROUP BY agent""" for name, src in _TABLES), "typed", "ix", extra=SETS),
}
