"""Order roll-up, geographic waves, rounds, travel distance, day plans, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.operators.cleaning import may_meet
from depotspark.operators.graph import cut_lineage, settled


def rollup(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders: date, city, district of the first row, lines), (order items: lines, qty)."""
    first = F.min_by(F.struct("ship_date", "city", "district"), "row_id").alias("m")
    orders = sales.where("ship_no is not null").groupBy("ship_no").agg(first, F.count("*").alias("lines"))
    orders = orders.select("ship_no", F.coalesce(F.date_format("m.ship_date", "yyyyMMdd"), F.lit("")).alias("date"), F.coalesce("m.city", F.lit("未知")).alias("city"), F.coalesce("m.district", F.lit("未知")).alias("district"), "lines")
    return orders, order_items(sales)


def order_items(sales: DataFrame) -> DataFrame:
    return sales.where("ship_no is not null and item_id is not null").groupBy("ship_no", "item_id").agg(F.count("*").alias("lines"), F.sum("qty").alias("qty"))


def of_orders(sales: DataFrame, orders: DataFrame) -> DataFrame:
    """The sales of some orders (ship_no). Of the others few are shuffled: a table of bits tells most of them."""
    key = F.xxhash64("ship_no").alias("_k")
    met = may_meet(sales.select("*", key), orders.select(key), "_k").where("_may").drop("_k", "_may")
    return met.join(orders, "ship_no", "left_semi")


def simple_batch(sales: DataFrame, capacity: int = R.CAPACITY) -> DataFrame:
    one = sales.where("ship_no is not null").agg(F.count_distinct("ship_no").alias("orders"), F.count("*").alias("lines"))
    rounds = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("lines") / capacity)) if capacity > 0 else F.col("orders")
    return one.withColumn("rounds", rounds).withColumn("improvement", F.when(F.col("orders") > 0, (F.col("orders") - F.col("rounds")) * 100.0 / F.col("orders")).otherwise(0.0))


def window_months(orders: DataFrame, months: int = 3) -> DataFrame:
    """The last months of data, without a last month whose data stop before its end."""
    hi = orders.where("date <> ''").agg(F.max(F.to_date("date", "yyyyMMdd")).alias("hi"))
    month = orders.where("date <> ''").select(F.substring("date", 1, 6).alias("month")).distinct().crossJoin(F.broadcast(hi))
    month = month.where((F.last_day("hi") == F.col("hi")) | (F.col("month") != F.date_format("hi", "yyyyMM")))
    return month.orderBy(F.desc("month")).limit(months).select("month")


def in_window(orders: DataFrame) -> DataFrame:
    return orders.join(F.broadcast(window_months(orders)), F.substring("date", 1, 6) == F.col("month"), "left_semi")  # three rows


def waves(orders: DataFrame, threshold: int = R.WAVE_THRESHOLD) -> DataFrame:
    """orders with type and wave_district: dense where a district's day reaches the threshold, else pooled for the city."""
    n = F.count("*").over(Window.partitionBy("date", "city", "district"))
    dense = n >= threshold
    return orders.withColumn("type", F.when(dense, "dense").otherwise("pool")).withColumn("wave_district", F.when(dense, F.col("district")).otherwise("（稀疏併縣市）"))


WAVE = ["date", "city", "wave_district", "type"]


def distance(rows: DataFrame, keys: list[str], zone: str, zones: DataFrame) -> DataFrame:
    """Twice the distance to each distinct zone that the keys visit; unknown zones count nothing."""
    visited = rows.where(F.col(zone).isNotNull()).select(*keys, F.col(zone).alias("zone_id")).distinct()
    return visited.join(F.broadcast(zones), "zone_id").groupBy(*keys).agg((F.sum("distance_m") * 2).alias("dist"))


def seed_rounds(orders: DataFrame, items: DataFrame, places: DataFrame, zones: DataFrame, capacity: int = R.CAPACITY) -> DataFrame:
    """Each wave's items in order of zone distance, cut into rounds. places: item_id, zone. Adds round (from 0)."""
    waved = items.join(orders.select("ship_no", *WAVE), "ship_no").groupBy(*WAVE, "item_id").agg(F.sum("qty").alias("qty"), F.count("*").alias("serves"))
    placed = waved.join(places, "item_id", "left").join(F.broadcast(zones), F.col("zone") == F.col("zone_id"), "left")
    order = Window.partitionBy(*WAVE).orderBy(F.coalesce("distance_m", F.lit(R.FAR_AWAY)), "zone", "item_id")
    return placed.withColumn("round", F.floor((F.row_number().over(order) - 1) / capacity)).select(*WAVE, "item_id", "qty", "serves", "zone", "round")


def wave_table(waved: DataFrame, seeds: DataFrame, zones: DataFrame) -> DataFrame:
    """One row for each wave: orders, lines, items, rounds and distance. A wave without items counts one round."""
    seeds = cut_lineage(seeds)
    base = waved.groupBy(*WAVE).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    picks = seeds.groupBy(*WAVE).agg(F.count("*").alias("sku_count"), F.count_distinct("round").alias("rounds"))
    dist = distance(seeds, [*WAVE, "round"], "zone", zones).groupBy(*WAVE).agg(F.sum("dist").alias("wave_dist"))
    out = base.join(picks, WAVE, "left").join(dist, WAVE, "left")
    return out.select(*WAVE, "orders", "lines", F.coalesce("sku_count", F.lit(0)).alias("sku_count"), F.coalesce("rounds", F.lit(1)).alias("rounds"), F.coalesce("wave_dist", F.lit(0.0)).alias("wave_dist"))


def strategies(sales: DataFrame, zones: DataFrame, threshold: int = R.WAVE_THRESHOLD, capacity: int = R.CAPACITY, places: DataFrame | None = None) -> DataFrame:
    """One row: order-by-order picking (before and after the new places) against seeded waves over the window. places (item_id, zone,
    before_zone): both written, and sales without zones, which are not written again."""
    if places is None:
        sales = cut_lineage(sales.select("row_id", "ship_no", "ship_date", "city", "district", "item_id", "qty", "zone", "before_zone"))  # read for orders, items and places
        places = cut_lineage(sales.where("item_id is not null").groupBy("item_id").agg(F.min_by("zone", "row_id").alias("zone"), F.min_by("before_zone", "row_id").alias("before_zone")))
    # the window is a few months of all: only its orders keep a table, and only their items are rolled up
    waved = settled(sales.sparkSession, lambda: waves(in_window(cut_lineage(rollup(sales)[0])), threshold))
    held = cut_lineage(order_items(of_orders(sales.select("ship_no", "item_id", "qty"), waved.select("ship_no"))))
    table = wave_table(waved, seed_rounds(waved, held, places.select("item_id", "zone"), zones, capacity), zones)
    seed = table.agg(F.sum("orders").alias("orders"), F.sum("lines").alias("lines"), F.sum("rounds").alias("seed_rounds"), F.sum("wave_dist").alias("seed_dist"), F.sum("sku_count").alias("seed_picks"), F.median("sku_count").alias("median_skus"), F.count_if(F.col("sku_count") > capacity).alias("bound_waves"), F.count("*").alias("waves"))
    located = held.join(places, "item_id")
    single = distance(located, ["ship_no"], "zone", zones).agg(F.coalesce(F.sum("dist"), F.lit(0.0)).alias("single_dist"))
    before = distance(located, ["ship_no"], "before_zone", zones).agg(F.coalesce(F.sum("dist"), F.lit(0.0)).alias("before_dist"))
    return seed.crossJoin(single).crossJoin(before)  # one row each


def improvement(before: Column, after: Column) -> Column:
    return F.when(before != 0, (before - after) * 100.0 / before).otherwise(0.0)


def kpi(s: DataFrame, speed: float = R.WALK_SPEED, handle: float = R.HANDLE_SECONDS) -> DataFrame:
    """Improvements of distance, rounds and work time in percent, and whether the targets are met."""
    work = lambda dist, picks: (F.col(dist) / speed + F.col(picks) * handle) / 3600.0
    out = s.select(improvement(F.col("before_dist"), F.col("seed_dist")).alias("dist_improvement"), improvement(F.col("orders"), F.col("seed_rounds")).alias("rounds_improvement"), improvement(work("before_dist", "lines"), work("seed_dist", "seed_picks")).alias("worktime_improvement"))
    for k, least in R.KPI_TARGETS.items():
        out = out.withColumn(f"{k}_met", F.col(f"{k}_improvement") >= least)
    return out


def geo_top(orders: DataFrame, limit: int = 15) -> DataFrame:
    """A report: districts by orders within the window."""
    return in_window(orders).groupBy("city", "district").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines")).orderBy(F.desc("orders"), "city", "district").limit(limit)


def day_plan(sales: DataFrame, day: str, zones: DataFrame, threshold: int = R.WAVE_THRESHOLD, capacity: int = R.CAPACITY) -> DataFrame:
    """Picks of one day: waves take orders by rising number of items, items by first sight, rounds of capacity items; serves: orders served."""
    orders, items = rollup(sales)
    waved = waves(orders.where(F.col("date") == day), threshold)
    held = items.join(waved.select("ship_no", *WAVE), "ship_no")
    size = held.groupBy("ship_no").agg(F.count("*").alias("k"))
    ranked = held.join(size, "ship_no")
    sight = ranked.groupBy(*WAVE, "item_id").agg(F.min(F.struct("k", "ship_no", "item_id")).alias("at"), F.sum("qty").alias("qty"), F.count("*").alias("serves"))
    seq = F.row_number().over(Window.partitionBy(*WAVE).orderBy("at"))
    places = sales.where("item_id is not null").groupBy("item_id").agg(F.min_by("zone", "row_id").alias("zone"))
    return sight.withColumn("round", F.floor((seq - 1) / capacity) + 1).join(places, "item_id", "left").select(*WAVE, "item_id", "zone", "serves", "qty", "round")


def completion(sales: DataFrame, day: str, zones: DataFrame, threshold: int = R.WAVE_THRESHOLD, capacity: int = R.CAPACITY) -> DataFrame:
    """Per wave and round: orders complete in it and up to it. An order is complete in its last item's round."""
    orders, items = rollup(sales)
    waved = waves(orders.where(F.col("date") == day), threshold)
    plan = day_plan(sales, day, zones, threshold, capacity).select(*WAVE, "item_id", "round")
    last = items.join(waved.select("ship_no", *WAVE), "ship_no").join(plan, [*WAVE, "item_id"]).groupBy(*WAVE, "ship_no").agg(F.max("round").alias("round"))
    done = last.groupBy(*WAVE, "round").agg(F.count("*").alias("done"))
    every = plan.select(*WAVE, "round").distinct().join(done, [*WAVE, "round"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return every.withColumn("cum_done", F.sum("done").over(Window.partitionBy(*WAVE).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))


def places_of(layout_record: DataFrame) -> DataFrame:
    """Places of items as strategies takes them. layout_record: id, after_zone, before_zone."""
    return layout_record.select(F.col("id").alias("item_id"), F.col("after_zone").alias("zone"), "before_zone")


def located(sales: DataFrame, layout_record: DataFrame) -> DataFrame:
    """sales with zone and before_zone as a layout gives them."""
    return sales.drop("zone", "before_zone").join(places_of(layout_record), "item_id", "left")


def day_waves(sales: DataFrame, day: str, threshold: int = R.WAVE_THRESHOLD) -> DataFrame:
    """A report: the waves of one day by their orders, with their place."""
    waved = waves(rollup(sales)[0].where(F.col("date") == day), threshold)
    table = waved.groupBy(*WAVE).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    return table.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("orders"), "city", "wave_district")))  # the waves of one day
