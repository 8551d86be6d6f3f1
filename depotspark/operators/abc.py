"""ABC classes by cumulative share, and Pareto points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.operators.errors import RequestError
from depotspark.operators.graph import cut_lineage


def sku_frequency(sales: DataFrame, keys: DataFrame | None = None, texts: tuple[str, ...] = ("item_code", "item_name", "category_id")) -> DataFrame:
    """Per item: number of distinct orders, and name, code and category (or those of texts) of its first row. sales is read for both
    by columns; keys: copick.order_keys of its items, if they are written already, so that orders aren't shuffled once more.

    All buffers are numbers, so that everything is hashed and nothing sorted: distinct orders by two aggregations, with hot
    items combined before they are shuffled; texts only as keys, one row for each set of them that an item has.
    """
    rows = sales.where("item_id is not null and ship_no is not null")
    orders = rows.select("item_id", "ship_no").distinct() if keys is None else keys.withColumnRenamed("k", "item_id")
    orders = orders.groupBy("item_id").agg(F.count("*").alias("freq"))
    first = rows.groupBy("item_id", *texts).agg(F.min("row_id").alias("row_id")).groupBy("item_id").agg(F.min_by(F.struct(*texts), "row_id").alias("m"))
    return orders.join(first, "item_id").select("item_id", "freq", "m.*")


def category_frequency(freq: DataFrame) -> DataFrame:
    """Per category the sum of its items' frequencies, and its items."""
    return freq.where("category_id is not null").groupBy("category_id").agg(F.sum("freq").alias("freq"), F.count("*").alias("sku_count"))


def ranked(df: DataFrame, within: list[str], order: list[Column], name: str = "rank", value: str | None = None) -> DataFrame:
    """df with `name`, the rank from 1 within the columns `within`, and, for a value, its running sum <name>_run and total <name>_all.

    No task sees a whole group: rows are dealt by ranges, a window runs inside each range, and what lies before a range
    comes from the ranges' counts and sums. The order must have no ties.
    """
    dealt = cut_lineage(df.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_p", F.spark_partition_id()))
    v = F.col(value) if value else F.lit(0)
    sums = dealt.groupBy("_p", *within).agg(F.count("*").alias("_n"), F.sum(v).alias("_v"))
    before = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range and group
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_g_{c}") for c in within], offset("_n").alias("_n0"), offset("_v").alias("_v0"), F.sum("_v").over(Window.partitionBy(*within)).alias(f"{name}_all"))
    on = F.col("_p") == F.col("_q")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy("_p", *within).orderBy(*order)
    out = dealt.withColumn("_r", F.row_number().over(inside)).withColumn("_s", F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(sums, on)
    out = out.withColumn(name, (F.col("_n0") + F.col("_r")).cast("int")).withColumn(f"{name}_run", F.col("_v0") + F.col("_s"))
    return out.drop("_p", "_q", "_r", "_s", "_n0", "_v0", *[f"_g_{c}" for c in within], *([] if value else [f"{name}_run", f"{name}_all"]))


def classes(df: DataFrame, value: str, key: str, a: float = R.ABC_A, b: float = R.ABC_B, within: str | None = None) -> DataFrame:
    """Adds rank, share, cum and cls: A up to a percent of the running total, B up to b, else C. Ties by key."""
    if not 0 < a < b < 100:
        raise RequestError(f"0 < a < b < 100, not {a} and {b}")
    df = ranked(df, [within] if within else [], [F.desc(value), F.asc(key)], "rank", value)
    total = F.when(F.col("rank_all") == 0, 1).otherwise(F.col("rank_all"))
    df = df.withColumn("share", F.lit(100.0) * F.col(value) / total).withColumn("cum", F.lit(100.0) * F.col("rank_run") / total).drop("rank_run", "rank_all")
    return df.withColumn("cls", F.when(F.col("cum") <= a, "A").when(F.col("cum") <= b, "B").otherwise("C"))


def class_ends(classed: DataFrame) -> DataFrame:
    """One row: the percentage of items before the first that isn't A, and before the first C."""
    n = F.count("*")
    return classed.agg(n.alias("items"), (F.count_if(F.col("cls") == "A") * 100.0 / n).alias("a_pct"), (F.count_if(F.col("cls") != "C") * 100.0 / n).alias("b_pct"))


def pareto(classed: DataFrame, points: int = R.PARETO_POINTS) -> DataFrame:
    """rank and cum at evenly spaced ranks, first and last included."""
    classed = cut_lineage(classed.select("rank", "cum", "cls"))
    n = classed.agg(F.count("*").alias("n"))
    wanted = n.where("n > 0").select(F.explode(F.when(F.col("n") <= points, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long")), lambda k: F.bround(k / F.lit(points - 1.0) * (F.col("n") - 1)).cast("long") + 1))).alias("rank")).distinct()
    return classed.join(F.broadcast(wanted), "rank", "left_semi").select("rank", "cum", "cls")
