"""DuckDB checks of the header and fingerprint operators."""

from tracefp import schema as s
from tracefp.functions.headers import presence_name
from tracefp.oracles.base import query, r6
from tracefp.plans import http, tls

K = "agent, trial"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(value: str, table: dict, default: str) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x)
    return "CASE " + value + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) \
        + f" ELSE {default} END"


UA = """SELECT *, CASE WHEN lower(ua) LIKE '%headless%' THEN 'headless-chrome' WHEN ua LIKE '%Edg/%' THEN 'edge'
 WHEN ua LIKE '%Chrome/%' THEN 'chrome' WHEN ua LIKE '%Firefox/%' THEN 'firefox'
 WHEN ua LIKE '%Safari/%' AND ua NOT LIKE '%Chrome%' THEN 'safari' WHEN ua LIKE '%curl/%' THEN 'curl'
 WHEN lower(ua) LIKE '%python%' THEN 'python' WHEN ua LIKE '%Go-http-client%' THEN 'go'
 WHEN lower(ua) LIKE '%okhttp%' THEN 'okhttp' ELSE 'other' END AS ua_family,
 CASE WHEN ua LIKE '%Windows%' THEN 'windows' WHEN ua LIKE '%Macintosh%' OR ua LIKE '%Mac OS%' THEN 'macos'
 WHEN ua LIKE '%Linux%' AND ua NOT LIKE '%Android%' THEN 'linux' WHEN ua LIKE '%Android%' THEN 'android'
 WHEN ua LIKE '%iPhone%' OR ua LIKE '%iPad%' THEN 'ios' ELSE 'other' END AS ua_os,
 coalesce(nullif(regexp_extract(ua, 'Chrome/(\\d+)', 1), ''), nullif(regexp_extract(ua, 'Firefox/(\\d+)', 1), ''),
 nullif(regexp_extract(ua, 'Safari/(\\d+)', 1), '')) AS ua_version,
 list_transform(regexp_extract_all(ch_ua, '"([^"]+)";v="(\\d+)"', 1), lambda b: lower(b)) AS bn,
 list_transform(regexp_extract_all(ch_ua, '"([^"]+)";v="(\\d+)"', 2), lambda v: CAST(v AS BIGINT)) AS bv,
 trim(priority) AS p, lower(trim(trim(ch_platform), '"')) AS plat,
 array_to_string(header_names, ',') AS header_order, len(header_names) AS n_headers,
 list_sort(list_filter(header_names, lambda h: lower(h) NOT IN (""" + _list(s.BROWSER_HEADERS) + """))) AS odd
 FROM typed"""
RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{d}', [{_list(sites)}], {str(u).lower()})" for m, d, sites, u in s.FETCH_RULES) \
    + ") AS t(rm, rd, rsites, ruser)"
H1 = """SELECT u.*, rm IS NOT NULL AS sf_known_combo,
 rm IS NULL OR sf_site = '' OR list_contains(rsites, sf_site) AS sf_site_valid,
 CASE WHEN rm IS NULL THEN true WHEN ruser THEN sf_user = '?1' ELSE sf_user = '' END AS sf_user_correct,
 sf_mode <> 'navigate' OR sf_user = '?1' AS sf_nav_has_user,
 sf_mode = 'navigate' OR sf_user = '' AS sf_no_user_on_non_nav,
 NOT (sf_mode = 'cors' AND req_type = 'fetch_xhr') OR sf_dest = 'empty' AS sf_cors_dest_empty,
 sf_mode || '|' || sf_dest || '|' || sf_site AS sf_combo,
 len(list_filter(bn, lambda b: b LIKE '%headless%')) > 0 AS ch_is_headless, len(bn) AS ch_brand_count,
 CASE WHEN (ua LIKE '%Chrome/%' OR ua LIKE '%Chromium/%') AND len(bn) > 0 THEN len(list_filter(bn, lambda b:
  b LIKE '%chromium%' OR b LIKE '%chrome%' OR b LIKE '%edge%' OR b LIKE '%brand%')) > 0 ELSE true END AS ch_brand_matches_ua,
 CASE WHEN ua_version IS NULL OR len(bn) = 0 OR len(list_filter(bv, lambda v: v > 10)) = 0 THEN true
  ELSE len(list_filter(bv, lambda v: v > 10 AND abs(v - CAST(ua_version AS BIGINT)) <= 2)) > 0 END AS ch_version_near_ua,
 (trim(ch_mobile) = '?1') = (ua LIKE '%Mobile%' OR ua LIKE '%Android%' OR ua LIKE '%iPhone%' OR ua LIKE '%iPad%')
  AS ch_mobile_matches_ua,
 CASE WHEN plat = '' OR ua_os = 'other' THEN true ELSE plat = ua_os END AS ch_platform_matches_ua,
 CASE WHEN regexp_matches(p, '^u=\\d+') THEN CAST(regexp_extract(p, '^u=(\\d+)', 1) AS INTEGER) END AS priority_urgency,
 CASE WHEN regexp_matches(p, '^u=\\d+') THEN p LIKE '%i%' END AS priority_incr,
 CASE WHEN p <> '' THEN CASE WHEN req_type = 'navigate' THEN p IN ('u=0, i', 'u=0,i')
  WHEN req_type LIKE 'subresource%' THEN p IN ('u=1', 'u=2')
  WHEN req_type = 'fetch_xhr' THEN p IN ('u=4, i', 'u=4,i', 'u=3, i', 'u=3,i') ELSE true END END AS priority_expected,
 substr(sha256(header_order), 1, 16) AS header_order_hash,
 array_to_string(odd, ',') AS nonstandard_headers, len(odd) > 0 AS has_nonstandard_headers,
 len(odd) AS n_nonstandard_headers, """ + ", ".join(
    f"list_contains(header_names, '{h}') AS {presence_name(h)}" for h in s.TRACKED_HEADERS) + """
 FROM uas u LEFT JOIN rules ON rm = sf_mode AND rd = sf_dest"""
H2 = """SELECT *, NOT (sf_known_combo AND sf_site_valid AND sf_user_correct AND sf_nav_has_user AND sf_no_user_on_non_nav
 AND sf_cors_dest_empty) AS sf_any_violation, NOT (ch_brand_matches_ua AND ch_version_near_ua AND ch_mobile_matches_ua
 AND ch_platform_matches_ua) AS ch_any_incoherence FROM h1"""
HDR = {"uas": UA, "rules": RULES, "h1": H1, "hdr": H2}
HCLEAN = {**HDR, "hc": "SELECT * FROM hdr WHERE NOT (method = 'POST' AND path = '/collect')"}


def _grease(v: str) -> str:
    return f"(({v} & 3855) = 2570)"


def _seq(col: str, name: str, table: dict) -> str:
    ng = f"list_filter({col}, lambda v: NOT {_grease('v')})"
    named = f"list_transform({ng}, lambda v: {_case('v', table, 'CAST(v AS VARCHAR)')})"
    return (f"len({ng}) AS {name}_count, len(list_filter({col}, lambda v: {_grease('v')})) > 0 AS {name}_has_grease, "
            f"CAST(nullif(list_position(list_transform({col}, lambda v: {_grease('v')}), true), 0) - 1 AS INTEGER) "
            f"AS {name}_grease_pos, array_to_string({col}, ',') AS {name}_seq_str, "
            f"array_to_string({named}, '_') AS {name}_no_grease_str")


def _setting(n: int, name: str) -> str:
    return (f"CAST(nullif(regexp_extract(CASE WHEN len(fps) >= 2 THEN fps[1] END, "
            f"'^(?:.*;)?{n}:(-?\\d+)(?:;.*)?$', 1), '') AS BIGINT) AS {name}")


FP1 = f"""SELECT *, string_split(ja4, '_') AS jp, string_split(h2_fp, '|') AS fps,
 {_seq('ciphers', 'cipher', s.CIPHER_NAMES)}, {_seq('curves', 'curve', s.CURVE_NAMES)},
 {_seq('sigs', 'sig', s.SIGNATURE_NAMES)},
 len(list_filter(curves, lambda v: v IN (25497, 4588))) > 0 AS has_pq_crypto,
 list_filter(versions, lambda v: NOT {_grease('v')}) AS vr FROM req"""
FP2 = f"""SELECT *, CASE WHEN len(jp) = 3 THEN jp[1] END AS ja4_a, CASE WHEN len(jp) = 3 THEN jp[2] END AS ja4_b,
 CASE WHEN len(jp) = 3 THEN jp[3] END AS ja4_c,
 CASE WHEN len(jp) = 3 AND length(jp[1]) >= 10 THEN substr(jp[1], 1, 1) END AS ja4_protocol,
 CASE WHEN len(jp) = 3 AND length(jp[1]) >= 10 THEN substr(jp[1], 2, 2) END AS ja4_version,
 CASE WHEN len(jp) = 3 AND length(jp[1]) >= 10 THEN substr(jp[1], 4, 1) END AS ja4_sni,
 CASE WHEN len(jp) = 3 AND length(jp[1]) >= 10 THEN TRY_CAST(substr(jp[1], 5, 2) AS INTEGER) END AS ja4_cipher_count,
 CASE WHEN len(jp) = 3 AND length(jp[1]) >= 10 THEN TRY_CAST(substr(jp[1], 7, 2) AS INTEGER) END AS ja4_ext_count,
 CASE WHEN len(jp) = 3 AND length(jp[1]) >= 10 THEN substr(jp[1], 9, 2) END AS ja4_alpn_code,
 CASE WHEN len(fps) >= 2 THEN fps[1] END AS ak_settings_str,
 CASE WHEN len(fps) >= 2 AND regexp_matches(fps[2], '^[0-9]+$') THEN CAST(fps[2] AS BIGINT) END AS ak_window_update,
 CASE WHEN len(fps) >= 2 THEN fps[3] END AS ak_priority_str, CASE WHEN len(fps) >= 2 THEN fps[4] END AS ak_pseudo_order,
 {', '.join(_setting(i, n) for i, n in enumerate(('ak_header_table', 'ak_enable_push', 'ak_max_concurrent',
  'ak_init_window', 'ak_max_frame', 'ak_max_header_list'), 1))},
 array_to_string(alpn, ',') AS alpn_offered_str, alpn[1] AS alpn_first, len(alpn) AS alpn_count,
 list_contains(alpn, 'h2') AS alpn_has_h2, list_contains(alpn, 'http/1.1') AS alpn_has_http11,
 CAST(nullif(list_position(alpn, 'h2'), 0) - 1 AS INTEGER) AS alpn_h2_position,
 CASE WHEN alpn = ['h2'] THEN 'h2_only' WHEN alpn[1] = 'h2' THEN 'h2_first' WHEN alpn = ['http/1.1'] THEN 'http11_only'
  WHEN alpn[1] = 'http/1.1' THEN 'http11_first' WHEN len(alpn) = 0 THEN 'none' ELSE 'other' END AS alpn_preference,
 array_to_string(versions, ',') AS supported_ver_str,
 list_transform(vr, lambda v: {_case('v', s.VERSION_NAMES, "'0x' || lpad(upper(to_hex(v)), 4, '0')")}) AS vn,
 len(vr) AS supported_ver_count, len(list_filter(versions, lambda v: {_grease('v')})) > 0 AS supported_ver_has_grease,
 CAST(nullif(list_position(list_transform(versions, lambda v: {_grease('v')}), true), 0) - 1 AS INTEGER) AS supported_ver_grease_pos,
 list_contains(vr, 772) AS supported_ver_has_tls13, list_contains(vr, 771) AS supported_ver_has_tls12,
 list_contains(vr, 770) AS supported_ver_has_tls11,
 CASE WHEN list_contains(vr, 772) AND list_contains(vr, 771) THEN list_position(vr, 772) < list_position(vr, 771) END
  AS supported_ver_13_before_12 FROM fp1"""
FP3 = """SELECT *, CASE WHEN ak_priority_str <> '' THEN len(string_split(ak_priority_str, ',')) END AS ak_stream_count,
 array_to_string(vn, ',') AS supported_ver_names,
 CASE WHEN len(vn) = 0 THEN 'none' ELSE array_to_string(list_transform(vn, lambda n: replace(n, ' ', '')), '+') END AS supported_ver_profile,
 (curve_no_grease_str LIKE '%Kyber768%')::INT AS has_kyber768, (curve_no_grease_str LIKE '%MLKEM%')::INT AS has_mlkem768,
 coalesce(ja4_a LIKE 't13d2812%', false)::INT AS is_firefox_ja4, (negotiated_proto = 'h2')::INT AS is_h2,
 has_pq_crypto::INT AS has_pq, coalesce(ak_window_update > 1000000000, false)::INT AS win_is_firefox,
 coalesce(ja4_ext_count = 16, false)::INT AS is_ext16, coalesce(ja4_ext_count = 17, false)::INT AS is_ext17,
 coalesce(ja4_ext_count = 12, false)::INT AS is_ext12, coalesce(ja4_cipher_count = 28, false)::INT AS is_cipher28,
 cipher_has_grease::INT AS grease_cipher, curve_has_grease::INT AS grease_curve, supported_ver_has_grease::INT AS grease_ver,
 CAST(nullif(regexp_extract(ak_priority_str, '(?:^|,)3:\\d+:\\d+:(\\d+)', 1), '') AS DOUBLE) AS s3_weight,
 CAST(nullif(regexp_extract(ak_priority_str, '(?:^|,)5:\\d+:\\d+:(\\d+)', 1), '') AS DOUBLE) AS s5_weight
 FROM fp2"""
FP = {"fp1": FP1, "fp2": FP2, "fp": FP3}
FCLEAN = {**FP, "fc": "SELECT * FROM fp WHERE NOT (method = 'POST' AND path = '/collect')"}

NUMERIC = {"n_headers", "ch_brand_count", "priority_urgency", "ja4_cipher_count", "ja4_ext_count", "cipher_count",
           "curve_count", "sig_count", "alpn_count", "alpn_h2_position", "supported_ver_count", "ak_window_update", "ak_header_table",
           "ak_enable_push", "ak_init_window", "ak_max_header_list", "ak_stream_count"}


def long_sql(src: str, fields, keys: str = K) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{f}' AS field, CAST({f} AS VARCHAR) AS value, "
        f"{f'CAST({f} AS DOUBLE)' if f in NUMERIC else 'CAST(NULL AS DOUBLE)'} AS num FROM {src} WHERE {f} IS NOT NULL"
        for f in fields)


def modal_sql(src: str, keys: str = K) -> str:
    return f"""SELECT {keys}, field, value AS modal, n AS modal_n, nd AS n_distinct, tot AS total FROM (
 SELECT *, row_number() OVER (PARTITION BY {keys}, field ORDER BY n DESC, num NULLS FIRST, value) AS rn,
 count(*) OVER (PARTITION BY {keys}, field) AS nd, CAST(sum(n) OVER (PARTITION BY {keys}, field) AS BIGINT) AS tot
 FROM (SELECT {keys}, field, value, num, count(*) AS n FROM {src} GROUP BY {keys}, field, value, num)) WHERE rn = 1"""


def stability_sql() -> dict[str, str]:
    return {
        "fc2": "SELECT field, modal, count(*) AS n FROM modals GROUP BY field, modal",
        "ft": "SELECT *, sum(n) OVER (PARTITION BY field) AS tot, count(*) OVER (PARTITION BY field) AS nd, "
              "row_number() OVER (PARTITION BY field ORDER BY n DESC, modal) AS rn FROM fc2",
        "stab": "SELECT field, any_value(nd) AS n_distinct, max(CASE WHEN rn = 1 THEN modal END) AS modal_value, "
                "max(CASE WHEN rn = 1 THEN n / tot END) AS stability, "
                "-sum(n / tot * log2(n / tot + 1e-12)) AS entropy FROM ft GROUP BY field",
    }


def _modals(src: str, base: dict, fields, keys: str = K) -> dict[str, str]:
    return {**base, "lng": long_sql(src, fields, keys), "modals": modal_sql("lng", keys)}


HFIELDS, TFIELDS, VFIELDS = s.HEADER_STABILITY_FIELDS, s.CONSISTENCY_FIELDS, s.VECTOR_FIELDS
BOOL = {"sni_present", "sf_known_combo", "sf_any_violation", "ch_is_headless", "ch_brand_matches_ua", "ch_mobile_matches_ua",
        "ch_platform_matches_ua", "ch_any_incoherence", "priority_incr", "priority_expected", "has_priority",
        "has_sec_ch_ua", "has_sec_fetch_mode", "has_upgrade_insecure_requests", "cipher_has_grease",
        "curve_has_grease", "has_pq_crypto", "alpn_has_h2", "alpn_has_http11", "supported_ver_has_tls13", "supported_ver_has_tls12",
        "supported_ver_has_tls11", "supported_ver_has_grease", "supported_ver_13_before_12"}


def _pick(f: str, what: str = "modal") -> str:
    return f"max(CASE WHEN field = '{f}' THEN {what} END)"


def _vector(fields) -> str:
    cols = []
    for f in fields:
        kind = "BOOLEAN" if f in BOOL else "BIGINT" if f in NUMERIC else "VARCHAR"
        cols.append(f"CAST({_pick(f)} AS {kind}) AS {f}")
    return f"SELECT {K}, {', '.join(cols)} FROM modals GROUP BY {K}"


def _rate(c: str) -> str:
    return f"avg(CAST({c} AS INT))"


HT_FIELDS = ["nav_hash", "sf_site", "ch_brand_count", "ua_family", "ua_os", "ua_version", "priority_urgency"]


def http_features(source: str = "hc", keys: str = K) -> dict[str, str]:
    rates = {"sf_site_none_rate": "sf_site = 'none'", "sf_violation_rate": "sf_any_violation",
             "headless_rate": "ch_is_headless", "ch_incoherence_rate": "ch_any_incoherence",
             "ch_brand_matches_rate": "ch_brand_matches_ua", "ch_mobile_matches_rate": "ch_mobile_matches_ua",
             "ch_platform_matches_rate": "ch_platform_matches_ua", **http.PRESENCE_RATES,
             "priority_correct_rate": "priority_expected", "has_nonstandard_rate": "has_nonstandard_headers"}
    using = keys
    return {
        "hn": f"SELECT *, CASE WHEN req_type = 'navigate' THEN header_order_hash END AS nav_hash FROM {source}",
        "hl": long_sql("hn", HT_FIELDS, keys), "hm": modal_sql("hl", keys),
        "hb": f"SELECT {keys}, count(*) AS n_requests, count_if(req_type = 'navigate') AS n_nav, "
              "count_if(req_type LIKE 'subresource%') AS n_sub, avg(n_headers) AS n_headers_mean, "
              "stddev_samp(n_headers) AS n_headers_std, "
              + ", ".join(f"{_rate(f'({c})')} AS {n}" for n, c in rates.items()) + f" FROM hn GROUP BY {keys}",
        "hp": f"""SELECT {keys}, {_pick('nav_hash', 'n_distinct')} / {_pick('nav_hash', 'total')} AS nav_order_unique_ratio,
 {_pick('nav_hash', 'modal_n')} / {_pick('nav_hash', 'total')} AS nav_order_stability,
 coalesce({_pick('nav_hash', 'n_distinct')}, 0) AS n_unique_nav_hashes, {_pick('sf_site')} AS sf_site_mode,
 CAST({_pick('ch_brand_count')} AS INT) AS ch_brand_count_mode, {_pick('ua_family')} AS ua_family_mode,
 {_pick('ua_os')} AS ua_os_mode, {_pick('ua_version')} AS ua_version_mode,
 coalesce({_pick('ua_version', 'n_distinct')}, 0) AS ua_version_n_distinct,
 coalesce({_pick('ua_family', 'n_distinct')}, 0) AS ua_family_n_distinct,
 CAST({_pick('priority_urgency')} AS INT) AS priority_urgency_mode FROM hm GROUP BY {keys}""",
        "hx": f"SELECT {keys}, string_agg(name, '|' ORDER BY name) AS nn, count(*) AS nc FROM (SELECT DISTINCT {keys}, "
              f"unnest(odd) AS name FROM hn) GROUP BY {keys}",
        "htf": "SELECT * EXCLUDE (nn, nc), coalesce(nn, '') AS nonstandard_names, coalesce(nc, 0) AS n_nonstandard_distinct "
               f"FROM hb LEFT JOIN hp USING ({using}) LEFT JOIN hx USING ({using})",
    }


HTTP_DOUBLE = ["n_headers_mean", "n_headers_std", "sf_site_none_rate", "sf_violation_rate", "headless_rate",
               "ch_incoherence_rate", "ch_brand_matches_rate", "ch_mobile_matches_rate", "ch_platform_matches_rate",
               *http.PRESENCE_RATES, "priority_correct_rate", "has_nonstandard_rate", "nav_order_unique_ratio",
               "nav_order_stability"]
HTTP_OTHER = ["n_requests", "n_nav", "n_sub", "n_unique_nav_hashes", "sf_site_mode", "ch_brand_count_mode",
              "ua_family_mode", "ua_os_mode", "ua_version_mode", "ua_version_n_distinct", "ua_family_n_distinct",
              "priority_urgency_mode", "nonstandard_names", "n_nonstandard_distinct"]


def tls_features(source: str = "fc", keys: str = K) -> dict[str, str]:
    def eq(c, v):
        return f"coalesce(avg(CAST({c} = {v} AS INT)), 0)"

    code = _case("{}", s.PSEUDO_ORDER_CODES, "-1")
    return {
        "tl": long_sql(source, ["h2_order", "ak_pseudo_order"], keys), "tm": modal_sql("tl", keys),
        "tp": f"SELECT {keys}, {_pick('h2_order')} AS ho, {_pick('ak_pseudo_order')} AS fo FROM tm GROUP BY {keys}",
        "tb": f"""SELECT {keys}, avg(has_kyber768) AS f1_frac_kyber768, avg(has_mlkem768) AS f1_frac_mlkem768,
 avg(is_firefox_ja4) AS f2_frac_firefox_ja4, avg(is_h2) AS f2_frac_h2, avg(has_pq) AS f2_frac_pq,
 avg(ak_window_update) AS f3_mean_ak_window, avg(win_is_firefox) AS f3_frac_win_firefox, avg(ak_init_window) AS f3_mean_init_window,
 {eq('s3_weight', 110)} AS f4_frac_s3_w110, {eq('s3_weight', 220)} AS f4_frac_s3_w220,
 {eq('s5_weight', 110)} AS f5_frac_s5_w110, {eq('s5_weight', 220)} AS f5_frac_s5_w220,
 {eq('s5_weight', 256)} AS f5_frac_s5_w256, count(s3_weight) / count(*) AS f6_stream3_coverage,
 count(s5_weight) / count(*) AS f6_stream5_coverage, count(DISTINCT ja3) / count(*) AS f7_ja3_diversity,
 count(DISTINCT source_ip) / count(*) AS f7_ip_diversity, avg(cipher_count) AS f8_mean_cipher_count,
 avg(curve_count) AS f8_mean_curve_count, avg(sig_count) AS f8_mean_sig_count, avg(is_ext16) AS f10_frac_ext16,
 avg(is_ext17) AS f10_frac_ext17, avg(is_ext12 * is_cipher28) AS f10_frac_firefox_ext,
 CAST(avg(grease_cipher) > 0.5 AS INT) AS f11_grease_cipher, CAST(avg(grease_curve) > 0.5 AS INT) AS f11_grease_curve,
 CAST(avg(grease_ver) > 0.5 AS INT) AS f11_grease_ver, ln(1 + count(*)) AS f12_log_n_requests FROM {source} GROUP BY {keys}""",
        "ttf": f"SELECT * EXCLUDE (ho, fo), {code.format('ho')} AS f9_h2_pseudo_order, {code.format('fo')} AS "
               f"f9_ak_pseudo_order FROM tb LEFT JOIN tp USING ({keys})",
    }


TLS_INT = ["f9_h2_pseudo_order", "f9_ak_pseudo_order", "f11_grease_cipher", "f11_grease_curve", "f11_grease_ver"]
TLS_COLS = list(tls.FEATURE_NOTES)


def _tls_out() -> str:
    return ", ".join(c if c in TLS_INT else r6(c, c) for c in TLS_COLS)


def _profiles() -> dict[str, str]:
    cols = []
    for c in http.PROFILE_NUMERIC:
        cols.append(f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std, "
                    f"round(CAST(min({c}) AS DOUBLE), 4) AS {c}_min, round(CAST(max({c}) AS DOUBLE), 4) AS {c}_max")
    cat = ", ".join(f"{_pick(c)} AS {c}_mode, round(CAST({_pick(c, 'modal_n')} AS DOUBLE) / {_pick(c, 'total')}, 4) "
                    f"AS {c}_consistency" for c in http.PROFILE_CATEGORICAL)
    text = " UNION ALL ".join(
        f"SELECT agent, '{c}' AS field, CAST({c} AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS num FROM htf "
        f"WHERE trim(CAST({c} AS VARCHAR)) <> ''" for c in http.PROFILE_CATEGORICAL)
    return {**HCLEAN, **http_features(), "pl": text, "pm": modal_sql("pl", "agent"),
            "pb": f"SELECT agent, count(*) AS n_trials, {', '.join(cols)} FROM htf GROUP BY agent",
            "pc": f"SELECT agent, {cat} FROM pm GROUP BY agent",
            "prof": "SELECT * FROM pb LEFT JOIN pc USING (agent)"}


NAV = {**HCLEAN, "nav": "SELECT * FROM hc WHERE req_type = 'navigate'",
       "sub": "SELECT * FROM hc WHERE req_type LIKE 'subresource%'"}


def _comparison() -> str:
    def pct(c):
        return f"avg(CAST(coalesce({c}, false) AS INT)) * 100"

    rows = []
    for c, low, high in http.PRESENCE_CHECKS:
        test = f"{pct(c)} <= {low}" if low is not None else f"{pct(c)} > {high}" if high is not None else "false"
        rows.append((c, pct(c), test, "nav"))
    for n, c, test in [("headless", "ch_is_headless", "> 10"), ("sf_violation", "sf_any_violation", "> 0"),
                       ("ch_incoherence", "ch_any_incoherence", "> 10"), ("mobile_matches", "ch_mobile_matches_ua", None),
                       ("platform_matches", "ch_platform_matches_ua", None),
                       ("priority_correct", "priority_expected", None)]:
        rows.append((n, pct(c), f"{pct(c)} {test}" if test else "false", "nav"))
    rows.append(("sf_site_none", pct("(sf_site = 'none')"), f"{pct('(sf_site = $q$none$q$)')} = 100", "nav"))
    for label, src in (("unique_orders", "nav"), ("sub_unique_orders", "sub")):
        rows.append((label, "count(DISTINCT header_order_hash) / count(*)",
                     "count(DISTINCT header_order_hash) = count(*)", src))
    rows.append(("header_count_mean", "avg(n_headers)", "false", "nav"))
    rows.append(("header_count_std", "stddev_samp(n_headers)", "false", "nav"))
    rows.append(("sub_requests", "count(*)", "false", "sub"))
    rows.append(("sub_accept_language", pct("has_accept_language"), "false", "sub"))
    parts = [f"SELECT agent, '{n}' AS feature, CAST(NULL AS VARCHAR) AS text, {r6(e, 'number')}, {t} AS anomaly "
             f"FROM {src} GROUP BY agent" for n, e, t, src in rows]
    parts.append("SELECT agent, 'mode_' || field AS feature, modal AS text, CAST(n_distinct AS DOUBLE) AS number, "
                 "n_distinct > 1 AS anomaly FROM cm")
    parts.append("SELECT agent, 'nonstandard_example_' || rn AS feature, name AS text, CAST(NULL AS DOUBLE) AS number, "
                 "true AS anomaly FROM (SELECT agent, name, row_number() OVER (PARTITION BY agent ORDER BY name) AS rn "
                 "FROM (SELECT DISTINCT agent, lower(unnest(odd)) AS name FROM nav)) WHERE rn <= 2")
    return " UNION ALL ".join(parts)


_CL = " UNION ALL ".join(
    f"SELECT agent, '{c}' AS field, CAST({c} AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS num FROM nav "
    f"WHERE trim(CAST({c} AS VARCHAR)) <> ''" for c in http.COMPARED_MODES)

_TLSCMP = {
    **FCLEAN, "h2r": "SELECT *, CASE WHEN ak_priority_str LIKE '%5:1:%' THEN nullif(regexp_extract(ak_priority_str, "
                     "'5:1:\\d+:(\\d+)', 1), '') END AS s5_top FROM fc WHERE negotiated_proto = 'h2'",
    "cl": long_sql("h2r", ["ja4_ext_count", "ja4_c", "ak_window_update", "ak_pseudo_order", "s5_top"], "agent"),
    "cmm": modal_sql("cl", "agent"),
    "vals": """SELECT agent, 'source_ips' AS metric, CAST(count(DISTINCT source_ip) AS VARCHAR) AS value FROM fc GROUP BY agent
 UNION ALL SELECT agent, 'h2_rows', CAST(count(*) AS VARCHAR) FROM h2r GROUP BY agent
 UNION ALL SELECT agent, 'ja3_unique', CAST(count(DISTINCT ja3) AS VARCHAR) FROM h2r GROUP BY agent
 UNION ALL SELECT agent, 'kyber768_pct', CAST(CAST(round_even(avg(has_kyber768) * 100, 0) AS BIGINT) AS VARCHAR) FROM h2r GROUP BY agent
 UNION ALL SELECT agent, 'mlkem_pct', CAST(CAST(round_even(avg(has_mlkem768) * 100, 0) AS BIGINT) AS VARCHAR) FROM h2r GROUP BY agent
 UNION ALL SELECT agent, 'firefox_pct', CAST(CAST(round_even(avg(is_firefox_ja4) * 100, 0) AS BIGINT) AS VARCHAR) FROM h2r GROUP BY agent
 UNION ALL SELECT agent, field, modal FROM cmm WHERE field <> 's5_top'
 UNION ALL SELECT agent, 's5_weight', modal FROM cmm WHERE field = 's5_top'
 UNION ALL SELECT agent, 's5_share_pct', CAST(CAST(round_even(modal_n / total * 100, 0) AS BIGINT) AS VARCHAR) FROM cmm WHERE field = 's5_top'""",
}

SESSION = {
    "sess": """SELECT *, array_to_string(header_names, ',') AS header_order, len(header_names) AS n_headers,
 sf_mode || '|' || sf_dest || '|' || sf_site AS sf_combo, CASE WHEN sf_mode = 'navigate' THEN 'navigate'
 WHEN sf_mode = 'no-cors' THEN 'subresource:' || CASE WHEN sf_dest = '' THEN 'unknown' ELSE sf_dest END
 WHEN sf_mode IN ('cors', 'same-origin') AND sf_dest = 'empty' AND NOT (method = 'POST' AND path = '/collect') THEN 'fetch_xhr'
 WHEN method = 'POST' AND path = '/collect' THEN 'collect' WHEN path LIKE '%.html' THEN 'navigate' ELSE 'other' END AS req_type
 FROM req"""}
_TY = ("navigate", "fetch_xhr")
_SB = f"""SELECT {K}, coalesce(bool_or((req_type = 'navigate' AND sf_user <> '?1') OR (req_type <> 'navigate' AND sf_user <> '')
 OR (req_type = 'fetch_xhr' AND sf_dest <> 'empty')), false) AS sf_has_violation,
 coalesce(avg(CASE WHEN req_type <> 'collect' THEN CAST(sf_mode = '' AS INT) END), 0) AS sf_missing_rate,
 CASE WHEN count_if(req_type IN ('navigate', 'fetch_xhr')) > 0 THEN
 count_if((req_type = 'navigate' AND priority IN ('u=0, i', 'u=0,i')) OR
 (req_type = 'fetch_xhr' AND priority IN ('u=4, i', 'u=4,i', 'u=3, i', 'u=3,i'))) / count_if(req_type IN ('navigate', 'fetch_xhr'))
 ELSE 1 END AS priority_correct_rate FROM sess GROUP BY {K}"""
_KT = K + ", req_type"
SESSION_ALL = {
    **SESSION, "sb": _SB, "sl": " UNION ALL ".join(
        f"SELECT {_KT}, '{f}' AS field, {f} AS value, CAST(NULL AS DOUBLE) AS num FROM sess "
        "WHERE req_type IN ('navigate', 'fetch_xhr')" for f in ("header_order", "sf_combo", "priority")),
    "sm": modal_sql("sl", _KT),
    "sq": f"SELECT {_KT}, quantile_cont(CAST(n_headers AS DOUBLE), 0.5) AS n FROM sess GROUP BY {_KT}"}
_SCOLS = ", ".join(
    f"(SELECT CASE WHEN modal <> '' THEN substr(sha256(modal), 1, 16) END FROM sm WHERE sm.agent = sb.agent AND sm.trial = sb.trial "
    f"AND req_type = '{t}' AND field = 'header_order') AS {t}_order_hash, "
    f"(SELECT n FROM sq WHERE sq.agent = sb.agent AND sq.trial = sb.trial AND req_type = '{t}') AS {t}_header_count, "
    f"(SELECT modal FROM sm WHERE sm.agent = sb.agent AND sm.trial = sb.trial AND req_type = '{t}' AND field = 'sf_combo') AS {t}_sf_combo, "
    f"(SELECT modal FROM sm WHERE sm.agent = sb.agent AND sm.trial = sb.trial AND req_type = '{t}' AND field = 'priority') AS {t}_priority"
    for t in _TY)

_SETTINGS = [f for f in tls.SETTING_FIELDS]
_NUMV = ", ".join(f"CAST(CAST({f} AS INT) AS DOUBLE) AS {f}" if f in BOOL else f"CAST({f} AS DOUBLE) AS {f}" for f in _SETTINGS)

SQL = {
    "request_type": query("SELECT id, req_type FROM typed", "typed"),
    "request_type_session": query("SELECT id, req_type FROM sess", "req", extra=SESSION),
    "ua_features": query("SELECT id, ua_family, ua_os, ua_version FROM uas", "typed", extra={"uas": UA}),
    "brand_list": query("SELECT id, array_to_string(regexp_extract_all(ch_ua, '\"([^\"]+)\";v=\"(\\d+)\"', 1), ',') AS ch_brands, "
                        "array_to_string(bv, ',') AS ch_versions, ch_brand_count, ch_is_headless FROM hdr", "typed", extra=HDR),
    "client_hint_coherence": query("SELECT id, ch_is_headless, ch_brand_matches_ua, ch_version_near_ua, ch_mobile_matches_ua, "
                                   "ch_platform_matches_ua, ch_any_incoherence FROM hdr", "typed", extra=HDR),
    "sec_fetch_consistency": query("SELECT id, sf_known_combo, sf_site_valid, sf_user_correct, sf_nav_has_user, "
                                   "sf_no_user_on_non_nav, sf_cors_dest_empty, sf_any_violation FROM hdr", "typed", extra=HDR),
    "priority_features": query("SELECT id, p AS priority_raw, priority_urgency, priority_incr, priority_expected FROM hdr",
                               "typed", extra=HDR),
    "header_order": query("SELECT id, header_order, header_order_hash, n_headers FROM hdr", "typed", extra=HDR),
    "header_presence": query("SELECT id, " + ", ".join(presence_name(h) for h in s.TRACKED_HEADERS) + " FROM hdr",
                             "typed", extra=HDR),
    "nonstandard_headers": query("SELECT id, nonstandard_headers, has_nonstandard_headers, n_nonstandard_headers FROM hdr",
                                 "typed", extra=HDR),
    "ja4_fields": query("SELECT id, ja4_a, ja4_b, ja4_c, ja4_protocol, ja4_version, ja4_sni, ja4_cipher_count, "
                        "ja4_ext_count, ja4_alpn_code FROM fp", "req", extra=FP),
    "stream_running_features": query(
        f"""SELECT {K}, {r6('avg(ch_is_headless::INT)', 'headless_rate')}, {r6('avg(sf_any_violation::INT)', 'sf_violation_rate')},
        {r6('avg(n_headers)', 'n_headers_mean')}, {r6('avg(is_h2)', 'f2_frac_h2')}, {r6('avg(cipher_count)', 'f8_mean_cipher_count')},
        {r6('CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6) ELSE 0 END', 'req_rate_hz')},
        {r6('ln(1 + count(*))', 'log_n_requests')}
        FROM hc JOIN (SELECT id, is_h2, cipher_count FROM fp) USING (id) JOIN (
            SELECT {K}, max(struct_pack(u := us, i := id)) AS last FROM hc WHERE path LIKE '%.html' GROUP BY {K}) USING ({K})
        WHERE struct_pack(u := us, i := id) <= last GROUP BY {K}""", "typed", "req", extra={**HCLEAN, **FP}),
    "h2_fingerprint_fields": query("SELECT id, ak_settings_str, ak_window_update, ak_priority_str, ak_pseudo_order, ak_stream_count, ak_header_table, "
                                   "ak_enable_push, ak_max_concurrent, ak_init_window, ak_max_frame, ak_max_header_list FROM fp",
                                   "req", extra=FP),
    "sequence_features": query("SELECT id, " + ", ".join(f"{n}_{p}" for n in ("cipher", "curve", "sig")
                               for p in ("count", "has_grease", "grease_pos", "seq_str", "no_grease_str"))
                               + ", has_pq_crypto FROM fp", "req", extra=FP),
    "alpn_features": query("SELECT id, alpn_offered_str, alpn_first, alpn_count, alpn_has_h2, alpn_has_http11, alpn_h2_position, "
                           "alpn_preference FROM fp", "req", extra=FP),
    "tls_version_features": query("SELECT id, supported_ver_str, supported_ver_names, supported_ver_count, supported_ver_has_grease, supported_ver_grease_pos, supported_ver_has_tls13, "
                                  "supported_ver_has_tls12, supported_ver_has_tls11, supported_ver_profile, supported_ver_13_before_12 FROM fp", "req", extra=FP),
    "tls_signals": query("SELECT id, has_kyber768, has_mlkem768, is_firefox_ja4, is_h2, has_pq, win_is_firefox, is_ext16, "
                         "is_ext17, is_ext12, is_cipher28, grease_cipher, grease_curve, grease_ver FROM fp", "req", extra=FP),
    "stream_weight": query("SELECT id, s3_weight, s5_weight FROM fp", "req", extra=FP),
    "pseudo_order_code": query(f"SELECT id, {_case('ak_pseudo_order', s.PSEUDO_ORDER_CODES, '-1')} AS order_code FROM fp", "req", extra=FP),
    "header_order_profile": query(
        f"""SELECT {K}, req_type, total AS n_requests, n_distinct AS n_distinct_orders, modal AS modal_order,
        substr(sha256(modal), 1, 16) AS modal_order_hash, {r6('modal_n / total', 'order_stability')} FROM modals""", "typed",
        extra=_modals("hdr", HDR, ["header_order"], K + ", req_type")),
    "consistency_violations": query("SELECT agent, trial, id, sf_any_violation, ch_any_incoherence, priority_expected FROM hdr "
                                    "WHERE sf_any_violation OR ch_any_incoherence OR NOT coalesce(priority_expected, true)",
                                    "typed", extra=HDR),
    "violation_rates": query(
        f"SELECT {K}, " + ", ".join(f"count_if(NOT {c}) AS {c}_broken" for c in http.FETCH_RULE_FLAGS)
        + ", count_if(sf_any_violation) AS sf_any_violation_n, " + r6(_rate("sf_any_violation"), "sf_violation_rate") + ", "
        + ", ".join(r6(_rate(c), f"{c}_rate") for c in http.HINT_FLAGS) + ", " + r6(_rate("ch_is_headless"), "headless_rate") + ", "
        + r6(_rate("coalesce(priority_expected, true)"), "priority_correct_rate") + f" FROM hdr GROUP BY {K}", "typed", extra=HDR),
    "http_trial_features": query(
        f"SELECT {K}, {', '.join(HTTP_OTHER)}, {', '.join(r6(c, c) for c in HTTP_DOUBLE)} FROM htf", "typed",
        extra={**HCLEAN, **http_features()}),
    "agent_profiles": query("SELECT * FROM prof", "typed", extra=_profiles()),
    "nonstandard_prevalence": query(
        """SELECT agent, name, count(*) AS n_trials_with, round(CAST(count(*) AS DOUBLE) / any_value(nt), 3) AS prevalence FROM
        (SELECT DISTINCT agent, trial, unnest(string_split(nonstandard_names, '|')) AS name FROM htf)
        JOIN (SELECT agent, count(*) AS nt FROM htf GROUP BY agent) USING (agent) WHERE name <> '' GROUP BY agent, name""",
        "typed", extra={**HCLEAN, **http_features()}),
    "feature_discriminability": query(
        "SELECT feature, round(i, 4) AS inter_agent_std, round(w, 4) AS mean_intra_std, round(i / (w + 1e-9), 3) AS discrim_ratio "
        "FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_samp({c}_mean) AS i, avg({c}_std) AS w FROM prof"
                                      for c in http.PROFILE_NUMERIC) + ")", "typed", extra=_profiles()),
    "session_header_checks": query(
        f"SELECT {K}, sf_has_violation, {r6('sf_missing_rate', 'sf_missing_rate')}, "
        f"{r6('priority_correct_rate', 'priority_correct_rate')}, {_SCOLS} FROM sb", "req", extra=SESSION_ALL),
    "session_navigation_checks": query(
        f"""SELECT {K}, {r6("coalesce(count_if(is_subres) / nullif(count_if(method = 'GET'), 0), 0)", 'subresource_ratio')},
        count(DISTINCT source_port) = 1 AS connection_reuse, coalesce(bool_and(ok), true) AS referer_chain_intact FROM flags
        LEFT JOIN (SELECT id, coalesce(contains(referer, ltrim(lag(path) OVER (PARTITION BY {K} ORDER BY us, id), '/')), true) AS ok
        FROM flags WHERE is_page) USING (id) GROUP BY {K}""", "flags"),
    "page_sequence": query(
        f"SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY us, id) AS step, ltrim(path, '/') AS page FROM flags WHERE is_page",
        "flags"),
    "agent_headless_rate": query(
        f"SELECT agent, {r6('avg(r)', 'headless_rate')} FROM (SELECT {K}, {_rate('ch_is_headless')} AS r FROM hc GROUP BY {K}) "
        "GROUP BY agent", "typed", extra=HCLEAN),
    "header_comparison": query(_comparison().replace("$q$", "'"), "typed", extra={**NAV, "cl": _CL, "cm": modal_sql("cl", "agent")}),
    "priority_by_type": query(
        "SELECT req_type, " + ", ".join(f"count_if(priority = '{v}') AS \"{v}\"" for v in ("u=0, i", "u=1", "u=3", "u=4, i"))
        + " FROM typed WHERE priority <> '' GROUP BY req_type", "typed"),
    "top_values": query("SELECT sf_combo, count(*) AS n FROM hdr GROUP BY sf_combo ORDER BY n DESC, sf_combo LIMIT 10", "typed", extra=HDR),
    "within_trace_consistency": query(
        f"""SELECT g.agent, g.trial, g.field, coalesce(m.n_distinct, 0) AS n_unique, coalesce(m.n_distinct, 0) <= 1 AS stable, m.modal
        FROM (SELECT DISTINCT {K}, unnest([{_list(TFIELDS)}]) AS field FROM req) g LEFT JOIN modals m
        ON m.agent = g.agent AND m.trial = g.trial AND m.field = g.field""", "req", extra=_modals("fp", FP, TFIELDS)),
    "field_stability_http": query(
        f"SELECT field, n_distinct, modal_value, {r6('stability', 'stability')}, {r6('entropy', 'entropy')}, entropy > 0.1 AS discriminative "
        "FROM stab", "typed", extra={**_modals("hdr", HDR, HFIELDS), **stability_sql()}),
    "field_stability_tls": query(
        f"SELECT field, n_distinct, modal_value, {r6('stability', 'stability')}, {r6('entropy', 'entropy')}, entropy > 0.1 AS discriminative "
        "FROM stab", "req", extra={**_modals("fp", FP, [*TFIELDS, "ak_stream_count"]), **stability_sql()}),
    "rank_fields": query(
        f"SELECT field, {r6('entropy', 'entropy')} FROM stab WHERE entropy > 1e-9 AND stability < 1 ORDER BY round(entropy, 9) DESC, field LIMIT 12",
        "req", extra={**_modals("fp", FP, [*TFIELDS, "ak_stream_count"]), **stability_sql()}),
    "fingerprint_vector": query(_vector(VFIELDS), "req", extra=_modals("fp", FP, VFIELDS)),
    "header_vector": query(_vector(HFIELDS), "typed", extra=_modals("hdr", HDR, HFIELDS)),
    "priority_depth_growth": query(
        f"""SELECT {K}, count(DISTINCT ak_stream_count) AS n_unique, bool_and(coalesce(ak_stream_count >= pv, true)) AS stable, min(ak_stream_count) AS min_depth,
        max(ak_stream_count) AS max_depth FROM (SELECT *, lag(ak_stream_count) OVER (PARTITION BY {K} ORDER BY us, id) AS pv FROM fp
        WHERE ak_stream_count IS NOT NULL) GROUP BY {K}""", "req", extra=FP),
    "tls_trial_features": query(f"SELECT {K}, {_tls_out()} FROM ttf", "req", extra={**FCLEAN, **tls_features()}),
    "feature_metadata": query(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{tls.FEATURE_NOTES[c]}' AS description, round(1 - count({c}) / count(*), 4) AS null_frac, "
            f"count(DISTINCT round({c}, 12)) AS n_unique, round(avg({c}), 4) AS overall_mean, round(stddev_samp({c}), 4) AS overall_std, "
            + ", ".join(f"round(avg(CASE WHEN agent = 'agent_{i}' THEN {c} END), 4) AS mean_agent_{i}" for i in range(6))
            + " FROM ttf" for c in TLS_COLS), "req", extra={**FCLEAN, **tls_features()}),
    "flag_consensus": query(
        " UNION ALL ".join(
            f"SELECT agent, '{f}' AS flag, count_if({f}) AS n_true, count_if(NOT {f}) AS n_false, CASE WHEN count_if({f}) > 0 AND "
            f"count_if(NOT {f}) = 0 THEN 'TRUE_ONLY' WHEN count_if(NOT {f}) > 0 AND count_if({f}) = 0 THEN 'FALSE_ONLY' ELSE 'MIXED' END AS status "
            "FROM vec GROUP BY agent" for f in tls.CONSENSUS_FLAGS), "req",
        extra={**_modals("fp", FP, VFIELDS), "vec": _vector(VFIELDS)}),
    "tls_comparison": query("SELECT agent, metric, value, count(*) OVER (PARTITION BY metric, value) = 1 AS is_unique FROM vals",
                            "req", extra=_TLSCMP),
    "minmax_settings": query(
        f"SELECT {K}, " + ", ".join(r6(f"({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER () + 1e-9)", f) for f in _SETTINGS)
        + f" FROM (SELECT {K}, {_NUMV} FROM vec)", "req", extra={**_modals("fp", FP, VFIELDS), "vec": _vector(VFIELDS)}),
}
