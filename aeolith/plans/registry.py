"""All registered queries: name to (spark, sf_dir) -> DataFrame, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OFF_HALF = 1.3e-8


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name; doubles of its result, and of the SQL's, are rounded to six places, a little off the halves, which engines round either way."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql.replace(", 6) + 0.0)", f" + {OFF_HALF}, 6) + 0.0)")
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`") + OFF_HALF, places) + F.lit(0.0)).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from aeolith.plans import frames, models, more, series  # noqa: F401  they register themselves

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLE
