"""Registered queries over the test tables and the SQL that says the same."""

from __future__ import annotations

from spindrift.plans import answers, evaluation, groups, media, preparation, repository, sources

PARTS = (groups, preparation, evaluation, repository, media, sources, answers)


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
