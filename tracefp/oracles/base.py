"""Shared WITH clauses of the DuckDB checks."""

from __future__ import annotations

from tracefp import views

_LISTS = """
 list_filter(string_split(header_csv, ','), lambda v: v <> '') AS header_names,
 list_transform(list_filter(string_split(cipher_csv, ','), lambda v: v <> ''), lambda v: CAST(v AS INTEGER)) AS ciphers,
 list_transform(list_filter(string_split(curve_csv, ','), lambda v: v <> ''), lambda v: CAST(v AS INTEGER)) AS curves,
 list_transform(list_filter(string_split(sig_csv, ','), lambda v: v <> ''), lambda v: CAST(v AS INTEGER)) AS sigs,
 list_transform(list_filter(string_split(version_csv, ','), lambda v: v <> ''), lambda v: CAST(v AS INTEGER)) AS versions,
 list_filter(string_split(alpn_csv, ','), lambda v: v <> '') AS alpn"""

REQ0 = views.select_sql(views.REQ, "events", views.US_DUCK)
IX = views.select_sql(views.IX, "events", views.US_DUCK)
WIN = views.select_sql(views.WINDOWS, "nation", views.US_DUCK)
PRED = views.select_sql(views.PRED, "labels", views.US_DUCK)

FLAGS = """SELECT *, path LIKE '%.html' AS is_page, path = '/collect' AS is_collect,
 (NOT path LIKE '%.html' AND NOT (method = 'POST' AND path = '/collect') AND method = 'GET') AS is_subres,
 (sf_mode IN ('cors', 'same-origin') AND sf_dest = 'empty' AND NOT (method = 'POST' AND path = '/collect')) AS is_fetch
 FROM req"""

TYPED = """SELECT *, CASE WHEN sf_mode = 'navigate' THEN 'navigate'
 WHEN sf_mode = 'no-cors' THEN 'subresource:' || CASE WHEN sf_dest = '' THEN 'unknown' ELSE sf_dest END
 WHEN sf_mode IN ('cors', 'same-origin') AND sf_dest = 'empty' THEN 'fetch_xhr'
 WHEN sf_mode = 'cors' THEN 'cors:' || CASE WHEN sf_dest = '' THEN 'unknown' ELSE sf_dest END
 WHEN method = 'POST' THEN 'post' WHEN path LIKE '%.js' THEN 'subresource:script'
 WHEN path LIKE '%.css' THEN 'subresource:style'
 WHEN regexp_matches(path, '\\.(png|jpg|jpeg|gif|webp|svg|ico)$') THEN 'subresource:image'
 ELSE 'other' END AS req_type FROM req"""

_CTES = {
    "req": f"SELECT *, {_LISTS} FROM ({REQ0})",
    "ix": IX,
    "win": WIN,
    "pred": PRED,
    "flags": FLAGS,
    "typed": TYPED,
}
_NEEDS = {"flags": ["req"], "typed": ["req"]}


def query(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """`body` behind the named views and any extra common tables."""
    order: list[str] = []
    for n in names:
        for need in [*_NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS ({_CTES[n]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def r6(expr: str, name: str) -> str:
    digits = 3 if "_ms_" in name or name.endswith("_std_ms") else 6
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name}"
