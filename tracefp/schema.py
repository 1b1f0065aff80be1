"""Record schemas and the fixed lookup tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


TLS_BLOCK = _struct(
    version=_S, cipher_suite=_S, negotiated_protocol=_S, server_name=_S,
    ja3_hash=_S, ja3_raw=_S, ja4_hash=_S, ja4_raw=_S,
    cipher_suites_offered=T.ArrayType(_I), extensions_offered=T.ArrayType(_I),
    elliptic_curves=T.ArrayType(_I), point_formats=_S,
    signature_schemes=T.ArrayType(_I), supported_versions=T.ArrayType(_I),
    alpn_protocols=T.ArrayType(_S),
)

HTTP2_BLOCK = _struct(
    akamai_fingerprint=_S, settings=T.MapType(_S, _L),
    window_update_size=_L, pseudo_header_order=T.ArrayType(_S),
)

HTTP_BLOCK = _struct(
    method=_S, path=_S, query=_S, protocol=_S, host=_S,
    headers_ordered=T.ArrayType(_struct(name=_S, value=_S)),
    headers=T.MapType(_S, T.ArrayType(_S)),
    body_sha256=_S, body_size=_L, user_agent=_S, accept=_S, accept_language=_S,
    accept_encoding=_S, sec_ch_ua=_S, sec_ch_ua_mobile=_S, sec_ch_ua_platform=_S,
    sec_fetch_dest=_S, sec_fetch_mode=_S, sec_fetch_site=_S, sec_fetch_user=_S,
    cookie=_S, referer=_S,
)

REQUEST_RECORD = _struct(
    id=_S, timestamp=_S, remote_addr=_S, source_ip=_S, source_port=_S,
    tls=TLS_BLOCK, http2=HTTP2_BLOCK, http=HTTP_BLOCK,
    request_received=_S, response_sent=_S, processing_time_ms=_D,
)

BROWSER_EVENT = _struct(
    t=_S, ms=_D, session=_S, page=_S, type=_S, target=_S,
    x=_D, y=_D, px=_D, py=_D, button=_I, key=_S, code=_S,
    ctrl=_B, shift=_B, alt=_B, meta=_B, value=_S,
    scrollX=_D, scrollY=_D, elScrollTop=_D,
    action=_S, state=_S, logId=_S, event=_S, detail=_S,
    w=_I, h=_I, referrer=_S, url=_S, text=_S,
)

FLUSH_RECORD = _struct(
    session=_S, page=_S, userAgent=_S, flushSeq=_I, flushReason=_S,
    eventCount=_I, batch=T.ArrayType(BROWSER_EVENT), receivedAt=_S,
)

# --------------------------------------------------------------------------
# They must be exactly these for results to agree.

COLLECT_PATH = "/collect"
UNLOAD_WINDOW_MS = 500
BURST_WINDOW_MS = 50

# Headers tracked one by one, case-sensitive.
TRACKED_HEADERS = [
    "Accept", "Accept-Encoding", "Accept-Language", "User-Agent",
    "Sec-Ch-Ua", "Sec-Ch-Ua-Mobile", "Sec-Ch-Ua-Platform",
    "Sec-Fetch-Mode", "Sec-Fetch-Dest", "Sec-Fetch-Site", "Sec-Fetch-User",
    "Priority", "Upgrade-Insecure-Requests", "Referer", "Origin",
    "Content-Type", "Content-Length", "Cache-Control", "Connection", "Te", "Dnt",
]

# Lower-case names an ordinary browser sends.
BROWSER_HEADERS = [
    "accept", "accept-encoding", "accept-language", "user-agent", "priority",
    "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform", "sec-fetch-mode",
    "sec-fetch-dest", "sec-fetch-site", "sec-fetch-user",
    "upgrade-insecure-requests", "referer", "origin", "content-type",
    "content-length", "cache-control", "connection", "te", "dnt",
    "if-modified-since", "if-none-match", "range", "authorization", "cookie",
    "host", "transfer-encoding",
]

# (mode, dest, allowed sites, user header required)
FETCH_RULES = [
    ("navigate", "document", ["none", "same-origin", "cross-site"], True),
    ("navigate", "iframe", ["none", "same-origin", "cross-site"], True),
    ("no-cors", "script", ["same-origin", "cross-site", "same-site"], False),
    ("no-cors", "style", ["same-origin", "cross-site", "same-site"], False),
    ("no-cors", "image", ["same-origin", "cross-site", "same-site"], False),
    ("no-cors", "font", ["same-origin", "cross-site", "same-site"], False),
    ("cors", "empty", ["same-origin", "cross-site", "same-site"], False),
    ("cors", "script", ["same-origin", "cross-site", "same-site"], False),
    ("same-origin", "empty", ["same-origin"], False),
    ("same-origin", "document", ["same-origin"], False),
]

PRIORITY_NAVIGATE = ["u=0, i", "u=0,i"]
PRIORITY_SUBRESOURCE = ["u=1", "u=2"]
PRIORITY_ASYNC = ["u=4, i", "u=4,i", "u=3, i", "u=3,i"]

CIPHER_NAMES = {
    4865: "TLS_AES_128_GCM_SHA256",
    4866: "TLS_AES_256_GCM_SHA384",
    4867: "TLS_CHACHA20_POLY1305_SHA256",
    49195: "ECDHE-ECDSA-AES128-GCM",
    49199: "ECDHE-RSA-AES128-GCM",
    49196: "ECDHE-ECDSA-AES256-GCM",
    49200: "ECDHE-RSA-AES256-GCM",
    52393: "ECDHE-ECDSA-CHACHA20",
    52392: "ECDHE-RSA-CHACHA20",
    49171: "ECDHE-RSA-AES128-CBC",
    49172: "ECDHE-RSA-AES256-CBC",
    156: "RSA-AES128-GCM",
    157: "RSA-AES256-GCM",
    47: "RSA-AES128-CBC",
    53: "RSA-AES256-CBC",
    255: "EMPTY_RENEGOTIATION",
}

CURVE_NAMES = {
    29: "x25519", 23: "secp256r1", 24: "secp384r1", 25: "secp521r1",
    25497: "x25519Kyber768", 4588: "X25519MLKEM768",
}

SIGNATURE_NAMES = {
    1027: "ecdsa_secp256r1_sha256", 2052: "rsa_pss_rsae_sha256",
    1025: "rsa_pkcs1_sha256", 1283: "ecdsa_secp384r1_sha384",
    2053: "rsa_pss_rsae_sha384", 1281: "rsa_pkcs1_sha384",
    2054: "rsa_pss_rsae_sha512", 1537: "rsa_pkcs1_sha512",
    1540: "rsa_pkcs1_sha1", 515: "ecdsa_sha1",
}

VERSION_NAMES = {772: "TLS 1.3", 771: "TLS 1.2", 770: "TLS 1.1", 769: "TLS 1.0", 768: "SSL 3.0"}

POST_QUANTUM_CURVES = [25497, 4588]
GREASE_MASK, GREASE_BITS = 0x0F0F, 0x0A0A

PSEUDO_ORDER_CODES = {
    ":method,:authority,:scheme,:path": 0, "m,a,s,p": 0,
    ":method,:scheme,:path,:authority": 1, "m,s,p,a": 1,
    ":method,:scheme,:authority,:path": 2, "m,s,a,p": 2,
    ":authority,:method,:path,:scheme": 3, "a,m,p,s": 3,
    ":authority,:path,:method,:scheme": 4, "a,p,m,s": 4,
    ":method,:path,:scheme,:authority": 5, "m,p,s,a": 5,
}

PAGE_LABELS = {
    "Subscribe · V1 Subscription Button": "S1-subscribe-v1",
    "Subscribe · V2 Subscription Button": "S2-subscribe-v2",
    "Subscribe · V3 Subscription Button": "S3-subscribe-v3",
    "S2 · Scroll Gate — UX Behavior Test Suite": "S4-scroll-gate",
    "S3 · Hover Reveal — UX Behavior Test Suite": "S5-hover-reveal",
    "S4 · DOM Mismatch — UX Behavior Test Suite": "S6-dom-mismatch",
    "S5 · Delayed Feedback — UX Behavior Test Suite": "S7-delayed-feedback",
}

SCENARIO_PAGES = [
    "S1-subscribe-v1", "S2-subscribe-v2", "S3-subscribe-v3", "S4-scroll-gate",
    "S5-hover-reveal", "S6-dom-mismatch", "S7-delayed-feedback",
]
PAGES_WITHOUT_FORMS = [
    "S4-scroll-gate", "S5-hover-reveal", "S6-dom-mismatch", "S7-delayed-feedback",
]

EVENT_TYPES = [
    "page", "mousemove", "mousedown", "mouseup", "click", "focus", "input",
    "keydown", "scroll", "visibility", "app_event",
]
# Fields expected to hold still within a session.
CONSISTENCY_FIELDS = [
    "tls_version", "negotiated_proto", "ja3", "ja4", "ja4_a", "ja4_b", "ja4_c", "ja4_protocol", "ja4_version", "ja4_sni",
    "ja4_cipher_count", "ja4_ext_count", "ja4_alpn_code", "cipher_count", "cipher_seq_str", "cipher_no_grease_str",
    "curve_count", "curve_seq_str", "sig_count", "sig_seq_str", "cipher_has_grease", "curve_has_grease", "has_pq_crypto",
    "alpn_first", "alpn_offered_str", "alpn_count", "alpn_has_h2", "alpn_has_http11", "alpn_preference", "alpn_h2_position",
    "supported_ver_str", "supported_ver_names", "supported_ver_count", "supported_ver_has_tls13", "supported_ver_has_tls12",
    "supported_ver_has_tls11", "supported_ver_has_grease", "supported_ver_profile", "supported_ver_13_before_12",
    "ak_window_update", "ak_pseudo_order", "ak_header_table", "ak_enable_push", "ak_init_window", "ak_max_header_list",
]
# Fields of a session's fingerprint vector.
VECTOR_FIELDS = [
    "ja4_protocol", "ja4_version", "ja4_sni", "ja4_cipher_count", "ja4_ext_count", "ja4_alpn_code", "ja4_b", "ja4_c",
    "tls_version", "negotiated_proto", "cipher_count", "cipher_no_grease_str", "curve_count", "curve_no_grease_str",
    "sig_count", "sig_no_grease_str", "cipher_has_grease", "curve_has_grease", "has_pq_crypto", "alpn_first", "alpn_count",
    "alpn_preference", "alpn_has_h2", "alpn_has_http11", "alpn_h2_position", "alpn_offered_str", "supported_ver_profile",
    "supported_ver_count", "supported_ver_has_tls13", "supported_ver_has_tls12", "supported_ver_has_tls11",
    "supported_ver_has_grease", "supported_ver_13_before_12", "supported_ver_names", "supported_ver_str", "ak_window_update",
    "ak_pseudo_order", "ak_header_table", "ak_enable_push", "ak_init_window", "ak_max_header_list", "ak_settings_str",
    "sni_present",
]
# Settings and counts compared on one scale.
SETTING_FIELDS = [
    "ak_header_table", "ak_enable_push", "ak_init_window", "ak_max_header_list", "ak_window_update", "alpn_count",
    "alpn_h2_position", "supported_ver_count", "supported_ver_has_tls13", "supported_ver_has_tls12", "supported_ver_has_grease",
]
HEADER_STABILITY_FIELDS = [
    "header_order_hash", "n_headers", "sf_mode", "sf_dest", "sf_site", "sf_combo",
    "sf_known_combo", "sf_any_violation", "ch_is_headless", "ch_brand_count",
    "ch_brand_matches_ua", "ch_mobile_matches_ua", "ch_platform_matches_ua",
    "ch_any_incoherence", "ua_family", "ua_os", "ua_version", "priority_urgency",
    "priority_incr", "priority_expected", "accept", "accept_encoding", "upgrade_insecure",
    "has_priority", "has_sec_ch_ua", "has_sec_fetch_mode", "has_upgrade_insecure_requests",
]
PROFILE_NUMERIC = [
    "nav_order_unique_ratio", "nav_order_stability", "n_headers_mean", "sf_site_none_rate",
    "sf_violation_rate", "headless_rate", "ch_incoherence_rate", "ch_brand_matches_rate",
    "ch_mobile_matches_rate", "ch_platform_matches_rate", "accept_lang_rate",
    "has_priority_rate", "has_sec_ch_ua_rate", "has_upgrade_ins_rate", "has_dnt_rate",
    "has_te_rate", "has_connection_rate", "has_cache_control_rate", "ua_version_n_distinct",
    "ua_family_n_distinct", "priority_correct_rate", "has_nonstandard_rate",
    "n_nonstandard_distinct",
]
PROFILE_CATEGORICAL = ["ua_family_mode", "ua_os_mode", "ua_version_mode", "sf_site_mode",
                       "priority_urgency_mode", "ch_brand_count_mode"]
# feature, column, red when at most, red when above
PRESENCE_CHECKS = [
    ("has_accept_language", 50, None), ("has_sec_fetch_user", 50, None),
    ("has_priority", None, None), ("has_sec_ch_ua", None, None),
    ("has_sec_fetch_mode", None, None), ("has_upgrade_insecure_requests", None, None),
    ("has_cache_control", None, 5), ("has_connection", None, 5), ("has_te", None, 5),
    ("has_dnt", None, None),
]
# --------------------------------------------------------------------------

TRIAL_KEY = ("agent", "trial")
