"""All registered queries and their SQL twins."""

from __future__ import annotations

from skerry.plans import biology, records, statistics, texts


def queries() -> dict:
    return {**statistics.QUERIES, **biology.QUERIES, **texts.QUERIES, **records.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**statistics.SQL, **biology.SQL, **texts.SQL, **records.SQL}
