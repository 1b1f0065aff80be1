"""Independent DuckDB statements that the queries are checked against."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from tracefp.oracles import interaction, joins, learning, traces, web

    return {**traces.SQL, **web.SQL, **interaction.SQL, **joins.SQL, **learning.SQL}
