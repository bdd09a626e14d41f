"""Registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from circuitlens.plans import design, graphs, inference, motifs, outcomes, search, series, storage

Query = Callable[[SparkSession, str], DataFrame]

PLANS = (outcomes, motifs, search, series, graphs, design, storage, inference)


def queries() -> dict[str, Query]:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
