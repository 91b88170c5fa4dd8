"""All queries over the given tables, by name, with the SQL that checks them."""

from __future__ import annotations

from . import attack_plans, data_plans, release_plans, text_plans  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
