"""DuckDB checks of the browser-event operators."""

from tracefp.oracles.base import query, r6
from tracefp.oracles.traces import clipped_histogram

K = "agent, trial"
LOAD = "(type = 'page' AND coalesce(action, '') = 'load')"
PAGES = ["page_0", "page_1", "page_2"]
NO_FORMS = ["page_2"]

GAPS = f"SELECT *, us - lag(us) OVER (PARTITION BY {K} ORDER BY us, id) AS gap_us FROM ix"
COUNTS = {"n_clicks": "click", "n_keydowns": "keydown", "n_mousemoves": "mousemove", "n_scrolls": "scroll",
          "n_app_events": "app_event"}
COUNT_COLS = ", ".join(f"count_if(type = '{t}') AS {n}" for n, t in COUNTS.items())
SESSION = f"""SELECT {K}, count(*) AS n_events, count(DISTINCT page) AS n_pages, (max(us) - min(us)) / 1e6 AS duration_s,
 CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) ELSE 0 END AS event_rate_hz,
 count(DISTINCT flush_seq) AS n_flushes, {COUNT_COLS}, avg(gap_us) / 1000.0 AS iei_mean_ms,
 quantile_cont(CAST(gap_us AS DOUBLE), 0.5) / 1000.0 AS iei_median_ms, stddev_samp(gap_us) / 1000.0 AS iei_std_ms
 FROM gaps GROUP BY {K}"""
S_INT = ["n_events", "n_pages", "n_flushes", *COUNTS]
S_DBL = ["duration_s", "event_rate_hz", "iei_mean_ms", "iei_median_ms", "iei_std_ms"]
SESS = {"gaps": GAPS, "sess": SESSION}


def _next(name: str, start: str, hit: str, keys: list[str], extra: str = "true") -> str:
    eq = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    return (f"SELECT a.*, (SELECT min(b.us) FROM ix b WHERE {eq} AND b.us > a.us AND {hit} AND {extra}) - a.us AS g "
            f"FROM ix a WHERE {start}")


def _stats(src: str, name: str, keys: str) -> str:
    return (f"SELECT {keys}, {r6('avg(g) / 1000.0', f'{name}_mean_ms')}, {r6('stddev_samp(g) / 1000.0', f'{name}_std_ms')}, "
            f"count(g) AS {name}_n FROM ({src}) GROUP BY {keys}")


KK = ["agent", "trial"]
UNLOADED = "(b.type <> 'page' OR coalesce(b.action, '') <> 'load')"
FOCUS_T = _next("f", "a.type = 'focus'", "b.type = 'input'", KK, "starts_with(b.target, string_split(a.target, '[')[1])")
FOCUS_P = _next("f", "a.type = 'focus'", "b.type = 'input'", [*KK, "page"],
                "starts_with(b.target, string_split(a.target, '[')[1])")
HOLD_T = _next("h", "a.type = 'mousedown'", "b.type = 'mouseup'", KK)
HOLD_P = _next("h", "a.type = 'mousedown'", "b.type = 'mouseup'", [*KK, "page"])
NAVG = _next("n", "a.type = 'page' AND a.action IN ('unload', 'pagehide')", UNLOADED, KK)
LOADG = _next("l", "a.type = 'page' AND a.action = 'load'", UNLOADED, [*KK, "page"])

FIRSTI = f"""SELECT {K}, page, (min(CASE WHEN type NOT IN ('page', 'visibility') THEN us END)
 - coalesce(min(CASE WHEN type = 'page' THEN us END), min(us))) / 1000.0 AS first_interact_ms FROM ix GROUP BY {K}, page"""


def _path(keys: str) -> str:
    return (f"SELECT {keys}, coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) AS px FROM (SELECT *, "
            f"lag(x) OVER w AS px, lag(y) OVER w AS py FROM ix WHERE type = 'mousemove' "
            f"WINDOW w AS (PARTITION BY {keys} ORDER BY us, id)) GROUP BY {keys}")


KP = K + ", page"
PAGE_STATS = f"""SELECT {KP}, count(*) AS n_events, (max(us) - min(us)) / 1e6 AS duration_s,
 CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) ELSE 0 END AS event_density, {COUNT_COLS},
 coalesce(max(scroll_y), 0) AS scroll_depth_px,
 avg(CASE WHEN rn > 1 THEN g0 END) / 1000.0 AS iei_mean_ms
 FROM (SELECT *, coalesce(gap_us, 0) AS g0, row_number() OVER (PARTITION BY {KP} ORDER BY us, id) AS rn FROM gaps) GROUP BY {KP}"""
PG = {
    "gaps": GAPS, "ps": PAGE_STATS, "fi": FIRSTI, "mp": _path(KP),
    "ho": f"SELECT {KP}, avg(g) / 1000.0 AS click_hold_mean_ms FROM ({HOLD_P}) GROUP BY {KP}",
    "fo": f"SELECT {KP}, avg(g) / 1000.0 AS focus_react_mean_ms FROM ({FOCUS_P}) GROUP BY {KP}",
    "pst": f"SELECT ps.*, fi.first_interact_ms, coalesce(mp.px, 0) AS mouse_traj_px, ho.click_hold_mean_ms, fo.focus_react_mean_ms "
           f"FROM ps LEFT JOIN fi USING ({KP}) LEFT JOIN mp USING ({KP}) LEFT JOIN ho USING ({KP}) LEFT JOIN fo USING ({KP})",
}
P_INT = ["n_events", *COUNTS]
P_DBL = ["duration_s", "event_density", "first_interact_ms", "mouse_traj_px", "click_hold_mean_ms", "focus_react_mean_ms",
         "scroll_depth_px", "iei_mean_ms"]
P_ALL = ["n_events", "duration_s", "event_density", "first_interact_ms", *COUNTS, "mouse_traj_px", "click_hold_mean_ms",
         "focus_react_mean_ms", "scroll_depth_px", "iei_mean_ms"]
TYPES = ["page", "mousemove", "mousedown", "mouseup", "click", "focus", "input", "keydown", "scroll", "visibility", "app_event"]

PROF = {
    "pc": f"SELECT {KP}, type, count(*) AS n FROM ix GROUP BY {KP}, type",
    "pt": f"SELECT {KP}, sum(n) AS tot FROM pc GROUP BY {KP}",
    "ty": f"SELECT DISTINCT {K}, type FROM ix",
    "shr": f"SELECT pt.agent, pt.trial, pt.page, ty.type, coalesce(pc.n, 0) / pt.tot AS s FROM pt JOIN ty USING ({K}) "
           f"LEFT JOIN pc USING ({KP}, type)",
}

BC = f"""SELECT {K}, count_if(NOT {LOAD}) AS n_events,
 greatest((max(CASE WHEN NOT {LOAD} THEN us END) - min(CASE WHEN NOT {LOAD} THEN us END)) / 1e6, 1e-6) AS duration_s,
 count(DISTINCT page) AS n_pages, {COUNT_COLS}, count_if(type = 'input') AS n_inputs, count_if(type = 'focus') AS n_focus,
 count_if(type = 'visibility' AND state = 'hidden') AS n_tab_switches, count(*) AS n_total FROM ix GROUP BY {K}
 HAVING count_if(NOT {LOAD}) > 0"""
BI = {
    "gaps": GAPS,
    "ug": f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY us, id) AS rn FROM gaps WHERE NOT {LOAD}",
    "biv": f"""SELECT {K}, avg(gap_us) / 1000.0 AS iei_mean_ms, stddev_samp(gap_us) / 1000.0 AS iei_std_ms,
 avg(CAST(gap_us < 50000 AS INT)) AS iei_burst_ratio, quantile_cont(CAST(gap_us AS DOUBLE), 0.5) / 1000.0 AS iei_median_ms,
 quantile_cont(CAST(gap_us AS DOUBLE), 0.95) / 1000.0 AS iei_p95_ms FROM ug WHERE rn > 1 AND gap_us > 0 GROUP BY {K}"""}
BI_COLS = ["iei_mean_ms", "iei_std_ms", "iei_burst_ratio", "iei_median_ms", "iei_p95_ms"]
RATIOS = {"mousemove_ratio": "n_mousemoves", "keydown_ratio": "n_keydowns", "scroll_ratio": "n_scrolls",
          "input_ratio": "n_inputs", "click_ratio": "n_clicks", "app_event_ratio": "n_app_events"}
BR = {"bc": BC, "br": f"SELECT {K}, " + ", ".join(f"{c} / n_total AS {n}" for n, c in RATIOS.items())
      + f", (n_keydowns - n_mousemoves) / greatest(n_keydowns + n_mousemoves, 1) AS kbd_vs_mouse FROM bc"}


def page_props() -> str:
    cols = []
    for p in PAGES:
        for t in ("mousemove", "keydown", "input", "scroll", "click"):
            cols.append(r6(f"coalesce(count_if(page = '{p}' AND type = '{t}') / nullif(count_if(page = '{p}'), 0), 0)",
                           f"{p}__{t}_prop"))
        cols.append(f"CAST(count_if(page = '{p}') > 0 AS INT) AS {p}__visited")
    nf = "page = 'page_2'"
    cols.append(f"count_if({nf} AND type = 'keydown') AS nonform_keydown_count")
    cols.append(r6(f"coalesce(count_if({nf} AND type = 'keydown') / nullif(count_if({nf}), 0), 0)", "nonform_keydown_ratio"))
    return f"SELECT {K}, {', '.join(cols)} FROM ix GROUP BY {K}"


BM = {"mpt": _path(K), "bm": f"""SELECT ix.agent, ix.trial, coalesce(any_value(mpt.px), 0) AS mouse_traj_total_px,
 coalesce(any_value(mpt.px), 0) / greatest(count(DISTINCT page), 1) AS mouse_traj_mean_px_per_page,
 avg(CASE WHEN type = 'click' THEN x END) AS click_x_mean, avg(CASE WHEN type = 'click' THEN y END) AS click_y_mean,
 CASE WHEN count_if(type = 'click') = 1 THEN 0 ELSE stddev_samp(CASE WHEN type = 'click' THEN x END) END AS click_x_std,
 CASE WHEN count_if(type = 'click') = 1 THEN 0 ELSE stddev_samp(CASE WHEN type = 'click' THEN y END) END AS click_y_std,
 count(DISTINCT CASE WHEN type = 'click' THEN target END) AS n_unique_click_targets
 FROM ix LEFT JOIN mpt ON mpt.agent = ix.agent AND mpt.trial = ix.trial GROUP BY ix.agent, ix.trial"""}
BM_DBL = ["mouse_traj_total_px", "mouse_traj_mean_px_per_page", "click_x_mean", "click_y_mean", "click_x_std", "click_y_std"]
BK = {"kc": f"SELECT {K}, key, count(*) AS n, sum(ctrl::INT) AS m FROM ix WHERE type = 'keydown' GROUP BY {K}, key",
      "kt": f"SELECT *, sum(n) OVER (PARTITION BY {K}) AS tot FROM kc",
      "bk": f"""SELECT {K}, sum(CASE WHEN key = 'Enter' THEN n ELSE 0 END) AS enter_key_count,
 sum(CASE WHEN key = 'Enter' THEN n ELSE 0 END) / sum(n) AS enter_key_ratio, count(*) AS n_unique_keys, sum(m) AS modifier_key_count,
 sum(m) / sum(n) AS modifier_key_ratio, -sum(n / tot * log2(n / tot + 1e-12)) AS key_entropy FROM kt GROUP BY {K}""",
      "bk0": f"SELECT agent, trial, CAST(coalesce(enter_key_count, 0) AS BIGINT) AS enter_key_count, coalesce(enter_key_ratio, 0) AS enter_key_ratio, "
             "coalesce(n_unique_keys, 0) AS n_unique_keys, CAST(coalesce(modifier_key_count, 0) AS BIGINT) AS modifier_key_count, "
             "coalesce(modifier_key_ratio, 0) AS modifier_key_ratio, coalesce(key_entropy, 0) AS key_entropy "
             f"FROM (SELECT DISTINCT {K} FROM ix) LEFT JOIN bk USING ({K})"}
BP = {"bpp": f"SELECT {KP}, CASE WHEN count_if(NOT {LOAD}) > 1 THEN (max(CASE WHEN NOT {LOAD} THEN us END) - "
             f"min(CASE WHEN NOT {LOAD} THEN us END)) / 1e6 END AS d, CASE page WHEN 'page_0' THEN 1 WHEN 'page_1' THEN 2 ELSE 4 END AS b "
             f"FROM ix GROUP BY {KP}"}
TASK = f"""SELECT {K}, count_if(a AND regexp_matches(detail, 'Subscribed|checkmark')) AS n_successful_submits,
 count_if(a AND detail LIKE '%BLOCKED%') AS n_blocked_submits,
 CAST(count_if(a AND regexp_matches(detail, 'CORRECT|Hidden button')) > 0 AS INT) AS hover_reveal_correct,
 CAST(count_if(a AND log_event = 'select' AND regexp_matches(detail, 'CORRECT|mars')) > 0 AS INT) AS dom_mismatch_correct,
 CAST(count_if(a AND log_event = 'select' AND detail LIKE '%INCORRECT%') > 0 AS INT) AS dom_mismatch_wrong,
 count_if(a AND regexp_matches(detail, 'NO EFFECT|False cue')) AS false_cue_clicks,
 count_if(a AND lower(log_event) LIKE '%hover%') AS n_hover_events, count_if(a AND log_event = 'select') AS n_select_events,
 CAST(count_if(a AND regexp_matches(detail, 'retry|Retry')) > 0 AS INT) AS delayed_feedback_retry,
 CAST(count_if(a AND regexp_matches(detail, 'completed|Completed|Done')) > 0 AS INT) AS delayed_feedback_completed,
 count_if(type = 'click' AND target LIKE '%nav-tab%') AS nav_via_tab_clicks
 FROM (SELECT *, type = 'app_event' AS a FROM ix) GROUP BY {K}"""

_DROPPED = "('app_event','page','keyup','mouseup','mousedown','focus','blur','change','selection','visibility')"
NOTICE = {
    **PROF, "prf": "SELECT agent, page, type, avg(s) AS v FROM shr GROUP BY agent, page, type",
    "ap": "SELECT DISTINCT agent, page FROM prf", "et": f"SELECT DISTINCT type FROM prf WHERE type NOT IN {_DROPPED}",
    "full_": "SELECT agent, page, type, coalesce(v, 0) AS v FROM ap CROSS JOIN et LEFT JOIN prf USING (agent, page, type)",
    "ev": "SELECT type FROM (SELECT agent, type, avg(v) AS m FROM full_ GROUP BY agent, type) GROUP BY type HAVING var_samp(m) >= 1e-6",
    "pgs": "SELECT page FROM full_ JOIN ev USING (type) GROUP BY page HAVING count(DISTINCT agent) = (SELECT count(DISTINCT agent) FROM ap) "
           "AND var_pop(v) >= 1e-5",
}

SQL = {
    "page_label": query(
        """SELECT page_id, substr(trim(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), '·')[-1]), 1, 30) AS page
        FROM pages"""),
    "app_event_funnel": query(
        f"SELECT {K}, id, page, log_event AS app_event, detail AS app_detail, {r6('ms', 'ms_rel')} FROM (SELECT *, "
        f"(us - min(us) OVER (PARTITION BY {K})) / 1000.0 AS ms FROM ix) WHERE type = 'app_event'", "ix"),
    "input_event_monitor": query(f"SELECT {K}, id, us, session, page, type, target, log_event, detail FROM ix WHERE type IN "
                                 "('input', 'change', 'app_event')", "ix"),
    "event_intervals": query(
        f"SELECT {K}, id, {r6(f'(us - min(us) OVER (PARTITION BY {K})) / 1000.0', 'ms_rel')}, "
        f"{r6('coalesce(gap_us, 0) / 1000.0', 'iei_ms')} FROM gaps", "ix", extra={"gaps": GAPS}),
    "mouse_path_length": query(f"SELECT {K}, {r6('px', 'mouse_path_px')} FROM mpt", "ix", extra={"mpt": _path(K)}),
    "focus_to_input": query(_stats(FOCUS_T, "focus_to_input", K), "ix"),
    "focus_to_input_by_page": query(_stats(FOCUS_P, "focus_to_input", KP), "ix"),
    "click_hold": query(_stats(HOLD_T, "click_hold", K), "ix"),
    "click_hold_by_page": query(_stats(HOLD_P, "click_hold", KP), "ix"),
    "navigation_gap": query(_stats(NAVG, "inter_page_gap", K), "ix"),
    "load_to_first_action": query(_stats(LOADG, "load_to_first_interact", K), "ix"),
    "first_interaction_latency": query(f"SELECT {KP}, {r6('first_interact_ms', 'first_interact_ms')} FROM fi", "ix",
                                       extra={"fi": FIRSTI}),
    "reassemble_sessions": query(
        "SELECT session, id, flush_seq, row_number() OVER (PARTITION BY session ORDER BY flush_seq, us, id) AS pos FROM ix", "ix"),
    "interaction_session_stats": query(
        f"SELECT {K}, {', '.join(S_INT)}, {', '.join(r6(c, c) for c in S_DBL)} FROM sess", "ix", extra=SESS),
    "interaction_page_stats": query(
        f"SELECT {KP}, {', '.join(P_INT)}, {', '.join(r6(c, c) for c in P_DBL)} FROM pst", "ix", extra=PG),
    "event_type_profile": query(
        f"SELECT {KP}, " + ", ".join(r6(f"count_if(type = '{t}') / count(*)", f"p_{t}") for t in TYPES)
        + f" FROM ix GROUP BY {KP}", "ix"),
    "page_stats_rollup": query(
        "SELECT page, " + ", ".join(f"{r6(f'avg({c})', f'{c}_mean')}, {r6(f'stddev_samp({c})', f'{c}_std')}" for c in P_ALL)
        + " FROM pst GROUP BY page", "ix", extra=PG),
    "event_profile_rollup": query(
        f"SELECT page, type, {r6('avg(s)', 'mean_share')}, count(*) AS n_trials FROM shr GROUP BY page, type", "ix", extra=PROF),
    "behaviour_counts": query(
        f"SELECT {K}, n_events, {r6('duration_s', 'duration_s')}, {r6('n_events / duration_s', 'event_rate_hz')}, n_pages, "
        f"{', '.join(COUNTS)}, n_inputs, n_focus, n_tab_switches, n_total FROM bc", "ix", extra={"bc": BC}),
    "behaviour_intervals": query(f"SELECT {K}, {', '.join(r6(c, c) for c in BI_COLS)} FROM biv", "ix", extra=BI),
    "behaviour_ratios": query(f"SELECT {K}, {', '.join(r6(c, c) for c in [*RATIOS, 'kbd_vs_mouse'])} FROM br", "ix", extra=BR),
    "behaviour_page_props": query(page_props(), "ix"),
    "behaviour_mouse": query(f"SELECT {K}, n_unique_click_targets, {', '.join(r6(c, c) for c in BM_DBL)} FROM bm", "ix", extra=BM),
    "behaviour_keyboard": query(
        f"SELECT {K}, enter_key_count, {r6('enter_key_ratio', 'enter_key_ratio')}, n_unique_keys, modifier_key_count, "
        f"{r6('modifier_key_ratio', 'modifier_key_ratio')}, {r6('key_entropy', 'key_entropy')} FROM bk0", "ix", extra=BK),
    "behaviour_scroll": query(
        f"SELECT {K}, {r6('coalesce(max(CASE WHEN type = $$scroll$$ THEN scroll_y END), 0)', 'max_scroll_depth_px')}, "
        f"{r6('coalesce(avg(CASE WHEN type = $$scroll$$ THEN scroll_y END), 0)', 'scroll_depth_mean_px')} FROM ix GROUP BY {K}", "ix"),
    "behaviour_pages": query(
        f"SELECT {K}, count(*) AS n_unique_pages, CAST(sum(b) AS BIGINT) AS pages_visited_bitmask, {r6('avg(d)', 'page_dwell_mean_s')}, "
        f"{r6('stddev_samp(d)', 'page_dwell_std_s')}, {r6('min(d)', 'page_dwell_min_s')}, {r6('max(d)', 'page_dwell_max_s')} "
        f"FROM bpp GROUP BY {K}", "ix", extra=BP),
    "task_outcomes": query(TASK, "ix"),
    "agent_event_interval_means": query(
        f"SELECT agent, {r6('avg(iei_mean_ms) / 1000', 'iei_mean_s')}, {r6('avg(iei_std_ms) / 1000', 'iei_std_s')} FROM sess GROUP BY agent",
        "ix", extra=SESS),
    "scenario_comparison": query(
        "SELECT a.agent, s.scenario, s.page, " + ", ".join(
            f"{r6(f'avg({c})', f'{c}_mean')}, {r6(f'stddev_samp({c})', f'{c}_std')}"
            for c in ("event_density", "first_interact_ms", "mouse_traj_px"))
        + " FROM (SELECT DISTINCT agent FROM ix) a CROSS JOIN (VALUES (1, 'page_0'), (2, 'page_1'), (3, 'page_2'), (4, 'page_9')) "
          "s(scenario, page) LEFT JOIN pst ON pst.agent = a.agent AND pst.page = s.page GROUP BY a.agent, s.scenario, s.page", "ix", extra=PG),
    "keyboard_mouse_centroid": query(
        f"SELECT agent, {r6('avg(n_keydowns)', 'keydown_center')}, {r6('avg(n_mousemoves)', 'mousemove_center')} FROM sess GROUP BY agent",
        "ix", extra=SESS),
    "noticeable_events_pages": query(
        f"SELECT agent, page, type, {r6('v', 'share')} FROM full_ JOIN ev USING (type) JOIN pgs USING (page)", "ix", extra=NOTICE),
    "event_interval_histogram": query(
        f"SELECT {K}, bin, count(*) AS n, round(any_value(mean), 3) AS mean_ms FROM binned GROUP BY {K}, bin", "ix", extra={
            "ivl": f"SELECT {K}, coalesce((us - lag(us) OVER w) / 1000.0, 0) AS iei_ms, row_number() OVER w = 1 AS is_first "
                   f"FROM ix WINDOW w AS (PARTITION BY {K} ORDER BY us, id)",
            **clipped_histogram("ivl", "iei_ms", 0.98, 40)}),
    "mouse_grid": query(
        f"SELECT {K}, CAST(least(floor(x * 30 / 1440.0), 29) AS INT) AS bx, CAST(least(floor(y * 30 / 900.0), 29) AS INT) AS by, "
        f"count(*) AS n FROM ix WHERE type = 'mousemove' AND x BETWEEN 0 AND 1440 AND y BETWEEN 0 AND 900 GROUP BY ALL", "ix"),
    "top_event_types": query("SELECT type, count(*) AS n FROM ix GROUP BY type ORDER BY n DESC, type LIMIT 10", "ix"),
}
SQL = {k: v.replace("$$scroll$$", "'scroll'") for k, v in SQL.items()}
