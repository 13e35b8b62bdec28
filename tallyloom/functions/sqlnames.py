"""Names callable from SQL text: temporary SQL functions, no Python in their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Function name, parameters, result type, body.
SQL_FUNCTIONS = [
    ("tl_norm_doi", "d STRING", "STRING",
     r"nullif(lower(regexp_replace(trim(regexp_replace(trim(d), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:)', '')), '[.,;]+$', '')), '')"),
    ("tl_trim", "t STRING", "STRING", "trim(regexp_replace(t, ' +', ' '))"),
    ("tl_days360", "a DATE, b DATE", "INT",
     "(year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + "
     "CASE WHEN day(b) = 31 AND (a = last_day(a) OR day(a) = 30) THEN 30 ELSE day(b) END - CASE WHEN a = last_day(a) THEN 30 ELSE day(a) END"),
]


def register(spark: SparkSession) -> list[str]:
    for name, params, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return [f[0] for f in SQL_FUNCTIONS]
