"""Pieces of SQL shared by the restatements."""

from __future__ import annotations

from cohortia.functions.text import BLANKS, NO_DATA

_BLANKS = "||".join(f"chr({ord(c)})" for c in BLANKS)
_WORDS = ", ".join(f"'{w}'" for w in NO_DATA)


def sql_blanks() -> str:
    return _BLANKS


def sql_read(c: str) -> str:
    t = f"upper(trim({c}, {_BLANKS}))"
    return f"(CASE WHEN {t} <> '' AND {t} NOT IN ({_WORDS}) THEN {t} END)"


def sql_read_grd(c: str) -> str:
    t = sql_read(c)
    return f"(CASE WHEN length({t}) < 6 THEN lpad({t}, 6, '0') ELSE {t} END)"
