"""Small helpers that build the SQL twins. They share rule values with the queries, never logic."""

from __future__ import annotations

from collections.abc import Sequence


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def values(rows: Sequence[Sequence[object]]) -> str:
    def one(v: object) -> str:
        return q(v) if isinstance(v, str) else "NULL" if v is None else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows) + ")"


def replace_all(expr: str, steps: Sequence[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"
    return expr


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[  \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"


def hits(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {q(pattern)})) AS BIGINT)"


def words(expr: str, pattern: str = "[^a-z0-9+#./-]+") -> str:
    return f"list_filter(string_split_regex(lower({expr}), {q(pattern)}), lambda x: x <> '')"


def coalesce_picks(expr: str, patterns: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({expr}, {q(p)}, 1), '')" for p in patterns) + ")"
