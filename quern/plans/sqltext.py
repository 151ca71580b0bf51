"""Pieces of SQL that DuckDB runs, matching the column functions of quern.functions.text."""

from quern.functions.text import REFUSAL, SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(replace({x}, 'İ', 'i\u0307')), '[a-z0-9]+')"


def space_words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(f'[^{SPACE}]+')})"


def key(x: str) -> str:
    kept = f"regexp_replace(lower({x}), {q(f'[^a-z0-9{SPACE}]')}, '', 'g')"
    return f"trim(regexp_replace({kept}, {q(f'[{SPACE}]+')}, ' ', 'g'))"


def grams(x: str, n: int) -> str:
    w = words(x)
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"


def refusal(x: str) -> str:
    return f"regexp_matches(lower({x}), {q(REFUSAL)})"
