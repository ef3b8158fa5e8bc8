"""The library's formulas as SQL functions, for queries in SQL text; the optimiser puts their bodies in place of the calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "at_least(x DOUBLE, low DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NOT NULL THEN greatest(x, low) END",
    "clip(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END",
    "ape(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "CASE WHEN y <> 0 THEN abs(y - p) / abs(y) END",
    "ape_guarded(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "CASE WHEN y > 0 AND p IS NOT NULL THEN abs(y - p) / y END",
    "ape_floor(y DOUBLE, p DOUBLE) RETURNS DOUBLE": "CASE WHEN y IS NOT NULL AND p IS NOT NULL THEN abs(y - p) / greatest(y, 1) END",
    "share_of(x DOUBLE, total DOUBLE) RETURNS DOUBLE": "CASE WHEN total > 0 THEN x / total END",
    "total_variation(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(p) = size(q) THEN 0.5 * aggregate(zip_with(p, q, (a, b) -> abs(a - b)), CAST(0 AS DOUBLE), (s, x) -> s + x) END",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
