"""Scorecard and value counts of a cleaning result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scorecard(df: DataFrame, as_of: str) -> DataFrame:
    """df (isolation_reason, volume_source, volume_review, ship_date): percentages in one pass; dates after as_of or five years before it are late."""
    day = F.lit(as_of).cast("date")
    ok_date = F.col("ship_date").between(F.add_months(day, -60), day)
    n = F.count("*")
    pct = lambda part, whole: F.when(whole > 0, part * 100.0 / whole)
    dated = F.count("ship_date")
    return df.agg(
        n.alias("n_rows"), F.coalesce(pct(F.count_if(F.col("volume_cm3").isNotNull()), n), F.lit(0.0)).alias("coverage"),
        F.coalesce(pct(F.count_if(F.col("isolation_reason").isNull()), n), F.lit(0.0)).alias("accuracy"),
        F.coalesce(pct(F.count_if(ok_date), dated), F.lit(100.0)).alias("timeliness"),
        F.coalesce(pct(F.count_if(F.col("volume_review") == 1), n), F.lit(0.0)).alias("review"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
