"""Microseconds to parse or format a few statements."""

from __future__ import annotations

import time

from ..sql.parse import parse_select
from ..sql.render import format_select


def large_statement(n: int = 1000) -> str:
    ids = range(n)
    return (
        f"SELECT {', '.join(f'FN_{i}(COL_{i})' for i in ids)} FROM {' JOIN '.join(f'TABLE_{i}' for i in ids)} "
        f"WHERE {' OR '.join(f'COL_{i} = {i}' for i in ids)} ORDER BY {', '.join(f'COL_{i} DESC' for i in ids)}"
    )


# fixed values: the statements that are timed
STATEMENTS = {
    "sqlparser_select": "SELECT * FROM my_table WHERE 1 = 1",
    "sqlparser_with_select": "WITH derived AS (SELECT MAX(a) AS max_a, COUNT(b) AS b_num, user_id FROM MY_TABLE GROUP BY user_id) SELECT * FROM my_table LEFT JOIN derived USING (user_id)",
    "select_literal": "SELECT 1 FROM logs",
    "simple_filter": "SELECT message FROM logs WHERE level = 'info'",
    "arithmetic_projection": "SELECT (value + 7) * 3 AS score, message FROM metrics WHERE value >= 10",
}


def _each(call, times: int) -> float:
    for _ in range(max(1, times // 20)):
        call()
    began = time.perf_counter()
    for _ in range(times):
        call()
    return round((time.perf_counter() - began) / times * 1e6, 1)


def timings(times: int = 300) -> dict[str, float]:
    out = {name: _each(lambda sql=sql: parse_select(sql), times) for name, sql in STATEMENTS.items()}
    big = large_statement()
    parsed = parse_select(big)
    out["parse_large_statement"] = _each(lambda: parse_select(big), 5)
    out["format_large_statement"] = _each(lambda: format_select(parsed), 5)
    return out
