"""Registered queries of the engine's own operators, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandql.plans import build_queries, format_queries, hits_queries, map_queries, msa_queries, search_queries, store_queries

_FAMILIES = (store_queries, msa_queries, format_queries, hits_queries, map_queries, build_queries, search_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.top_hits(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in _FAMILIES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _FAMILIES for name, sql in m.SQL.items()}
