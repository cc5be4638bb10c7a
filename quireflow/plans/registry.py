"""All queries of the core by name, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireflow.plans import documents, fusion, learning, readings, review, scoring, texts, values

MODULES = (fusion, texts, documents, readings, scoring, review, learning, values)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the core: (spark, folder of the tables) -> DataFrame."""
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in getattr(m, "SQL", {}).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.word_vote_weighted(spark, sf_dir)
