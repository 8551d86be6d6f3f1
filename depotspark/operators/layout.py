"""Slots, largest-remainder shares, item clusters, placement before and after and zone classes; distances over a plan are in geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.operators import graph
from depotspark.operators.abc import ranked

SECTIONS, MATERIALS = ("upper", "middle", "lower"), ("shelf", "pallet")


def zones(spark: SparkSession) -> DataFrame:
    """The zone fixture: ten shelf zones R00-R09 and fourteen pallet zones L00-L13 with distinct distances."""
    rows = [(f"R{i:02d}", f"zone R{i}", SECTIONS[i % 3], "shelf", 20.0 + 7 * i, 10.0 + 3 * i) for i in range(10)]
    rows += [(f"L{i:02d}", f"zone L{i}", SECTIONS[i % 3], "pallet", 41.0 + 5 * i, 11.5 + 4 * i) for i in range(14)]
    return spark.createDataFrame(rows, "zone_id string, name string, section string, material string, area_m2 double, distance_m double")


def slot_pool(zs: DataFrame, sections=SECTIONS, materials=MATERIALS) -> DataFrame:
    """Slots of each zone (its area over the slot area, half to even, one at least) in order of distance: slot from 0."""
    n = F.greatest(F.lit(1), F.bround(F.col("area_m2") / R.SLOT_AREA).cast("int"))
    pool = zs.where(F.col("section").isin(list(sections)) & F.col("material").isin(list(materials))).select("zone_id", "material", "distance_m", F.explode(F.sequence(F.lit(0), n - 1)).alias("cell"))
    return pool.withColumn("slot", F.row_number().over(Window.orderBy("distance_m", "zone_id", "cell")) - 1)  # over the slots of one floor


def largest_remainder(freq: DataFrame, pool: DataFrame) -> DataFrame:
    """freq (key, freq): slots in proportion, nearest first to the most frequent: cell_count and distances."""
    one = Window.partitionBy(F.lit(1))  # over categories
    n = pool.agg(F.count("*").alias("n"))
    raw = freq.crossJoin(F.broadcast(n)).withColumn("total", F.sum("freq").over(one))
    raw = raw.withColumn("base", F.floor(F.col("n") * F.col("freq") / F.col("total"))).withColumn("frac", (F.col("n") * F.col("freq")) % F.col("total"))
    extra = F.row_number().over(Window.orderBy(F.desc("frac"), F.desc("freq"), "key")) <= F.col("n") - F.sum("base").over(one)
    got = raw.withColumn("cell_count", F.col("base") + extra.cast("long"))
    end = F.sum("cell_count").over(Window.orderBy(F.desc("freq"), "key").rowsBetween(Window.unboundedPreceding, 0))
    spans = got.withColumn("end", end).withColumn("start", F.col("end") - F.col("cell_count"))
    owned = spans.join(F.broadcast(pool), (F.col("slot") >= F.col("start")) & (F.col("slot") < F.col("end")), "left")  # both sides are one floor
    return owned.groupBy("key", "freq", "cell_count").agg(F.avg("distance_m").alias("avg_dist"), F.min("distance_m").alias("min_dist"), F.max("distance_m").alias("max_dist"))


def layout_summary(shares: DataFrame, pool: DataFrame) -> DataFrame:
    """Mean distance of all slots against the mean weighted by frequency, the improvement, and slots in use in percent."""
    base = pool.agg(F.avg("distance_m").alias("baseline"), F.count("*").alias("slots"))
    w = shares.where("cell_count > 0").agg((F.sum(F.col("avg_dist") * F.col("freq")) / F.sum("freq")).alias("weighted"), F.sum("cell_count").alias("used"))
    return base.crossJoin(w).select("baseline", "weighted", ((F.col("baseline") - F.col("weighted")) * 100 / F.col("baseline")).alias("improvement"), (F.col("used") * 100.0 / F.col("slots")).alias("coverage"))


def clusters(items: DataFrame, pairs: DataFrame, min_lift: float = R.CLUSTER_LIFT, min_count: int = 0) -> DataFrame:
    """id, component over pairs (a, b, count, lift) that are strong and join two of the items."""
    strong = pairs.where((F.col("lift") >= min_lift) & (F.col("count") >= min_count)).select("a", "b")
    strong = strong.join(items.select(F.col("id").alias("a")), "a", "left_semi").join(items.select(F.col("id").alias("b")), "b", "left_semi")
    return graph.components(items.select("id"), graph.cut_lineage(strong))  # few, and read from both ends


def pack_before(categories: DataFrame, zs: DataFrame) -> DataFrame:
    """categories (key, sku_count, material): in order of size each goes to the zone with most area left and takes its share of the whole.

    Sequential by nature, over a few dozen categories and zones of each material.
    """
    import pandas as pd

    areas = {m: [] for m in MATERIALS}
    for r in zs.select("zone_id", "material", "area_m2").orderBy("distance_m", "zone_id").collect():  # the zones of one floor
        areas[r.material].append((r.zone_id, r.area_m2))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sku_count", "key"], ascending=[False, True])
        left = [list(z) for z in areas[pdf["material"].iloc[0]]]
        area, total = sum(z[1] for z in left) or 1, pdf["sku_count"].sum() or 1
        out = []
        for k, n in zip(pdf["key"], pdf["sku_count"]):
            if left:
                left.sort(key=lambda z: -z[1])
                out.append((k, left[0][0]))
                left[0][1] -= n / total * area
        return pd.DataFrame(out, columns=["key", "zone_id"])

    return categories.groupBy("material").applyInPandas(pack, "key long, zone_id string")


def placement_order(items: DataFrame, ab_clusters: DataFrame, category_clusters: DataFrame) -> DataFrame:
    """items (id, category_id, material, freq, cls, flex): position from 0 within each material.

    Clusters of only A, the A of mixed clusters, their B, clusters of only B, each by their largest frequency; then C and
    flexible items by category cluster, category and frequency. Ties by the smallest id.
    """
    by_c = Window.partitionBy("material", "component")
    soft = (F.col("cls") == "C") | F.col("flex")
    hard = items.where(~soft).join(ab_clusters.withColumnRenamed("component", "component"), "id")
    hard = hard.withColumn("has_a", F.max((F.col("cls") == "A").cast("int")).over(by_c)).withColumn("has_b", F.max((F.col("cls") == "B").cast("int")).over(by_c)).withColumn("top", F.max("freq").over(by_c))
    tier = F.when((F.col("has_a") == 1) & (F.col("has_b") == 0), 0).when(F.col("has_a") == 0, 3).when(F.col("cls") == "A", 1).otherwise(2)
    hard = hard.select("id", "material", "cls", "flex", tier.alias("tier"), F.col("top").alias("g1"), F.col("component").alias("g2"), F.lit(0.0).alias("c1"), F.lit(0).cast("long").alias("c2"), F.col("freq").alias("f"))
    cat = items.where(soft).groupBy("material", "category_id").agg(F.sum("freq").alias("cat_freq"))
    cat = cat.join(category_clusters.select(F.col("id").alias("category_id"), "component"), "category_id", "left").withColumn("component", F.coalesce("component", "category_id")).withColumn("top", F.max("cat_freq").over(by_c))
    loose = items.where(soft).join(cat, ["material", "category_id"])
    loose = loose.select("id", "material", "cls", "flex", F.lit(4).alias("tier"), F.col("top").alias("g1"), F.col("component").alias("g2"), F.col("cat_freq").alias("c1"), F.col("category_id").cast("long").alias("c2"), F.col("freq").alias("f"))
    order = [F.asc("tier"), F.desc("g1"), F.asc("g2"), F.desc("c1"), F.asc("c2"), F.desc("f"), F.asc("id")]
    return ranked(hard.unionByName(loose), ["material"], order).withColumn("pos", F.col("rank") - 1).select("id", "material", "cls", "flex", "tier", "pos")


def hand_out(order: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """order (id, material, cls, flex, pos) gets cells (zone_id, material, cell, dist) in order of distance: item i of n the cells [i T / n, (i + 1) T / n).

    Returns (item -> home zone and cell, cell -> class). With more items than cells an item has one cell, and a cell takes the class of its last item.
    """
    slot = cells.withColumn("slot", F.row_number().over(Window.partitionBy("material").orderBy("dist", "zone_id", "cell")) - 1).withColumn("t", F.count("*").over(Window.partitionBy("material")))
    order = graph.cut_lineage(order)
    totals = slot.groupBy("material").agg(F.max("t").alias("t")).join(order.groupBy("material").agg(F.count("*").alias("n")), "material")  # one row for each material
    spans = order.join(F.broadcast(totals), "material").withColumn("start", F.floor(F.col("pos") * F.col("t") / F.col("n")))
    stop = F.floor((F.col("pos") + 1) * F.col("t") / F.col("n"))
    spans = spans.withColumn("stop", F.greatest(stop, F.least(F.col("t"), F.col("start") + 1))).withColumn("pcls", F.when(F.col("flex"), "C").otherwise(F.col("cls")))
    home = spans.join(slot.select("material", F.col("slot").alias("start"), "zone_id", "cell"), ["material", "start"]).select("id", "zone_id", "cell", "pos", "pcls")
    covered = spans.select("material", "pos", "pcls", F.explode(F.sequence("start", F.col("stop") - 1)).alias("slot"))
    last = covered.groupBy("material", "slot").agg(F.max_by("pcls", "pos").alias("cell_class"))
    return home, last.join(slot, ["material", "slot"]).select("zone_id", "cell", "cell_class")


def zone_classes(home: DataFrame) -> DataFrame:
    """Items of each class by zone, the leading class (A before B before C) and shares in percent."""
    n = lambda c: F.count_if(F.col("pcls") == c)
    out = home.groupBy("zone_id").agg(n("A").alias("n_a"), n("B").alias("n_b"), n("C").alias("n_c"), F.count("*").alias("n"))
    lead = F.when((F.col("n_a") >= F.col("n_b")) & (F.col("n_a") >= F.col("n_c")), "A").when(F.col("n_b") >= F.col("n_c"), "B").otherwise("C")
    return out.select("zone_id", "n_a", "n_b", "n_c", lead.alias("lead"), (F.col("n_a") * 100.0 / F.col("n")).alias("a_pct"))


def category_clusters(categories: DataFrame, pairs: DataFrame, min_lift: float = R.CLUSTER_LIFT) -> DataFrame:
    """categories (id, material), pairs (a, b, lift) -> id, component over strong pairs of one material."""
    of = lambda s: categories.select(F.col("id").alias(s), F.col("material").alias(f"m{s}"))
    strong = pairs.where(F.col("lift") >= min_lift).join(of("a"), "a").join(of("b"), "b").where("ma = mb").select("a", "b")
    return graph.components(categories.select("id"), strong)


def class_mix(home: DataFrame, zs: DataFrame) -> DataFrame:
    """Shares of the classes by the material of the zones that items lie in."""
    rows = home.join(F.broadcast(zs.select("zone_id", "material")), "zone_id")  # the zones of one floor
    share = lambda c: (F.count_if(F.col("pcls") == c) / F.count("*")).alias(f"share_{c.lower()}")
    return rows.groupBy("material").agg(*[share(c) for c in "ABC"])


def record(items: DataFrame, home: DataFrame, before: DataFrame, zs: DataFrame) -> DataFrame:
    """One row for each item: category, frequency, class and placed class, place in the order, zone and cell, the zone its category had, and both distances.

    before: key, zone_id by category. An item without a place lies where its category was.
    """
    z = lambda p: zs.select(F.col("zone_id").alias(f"{p}_zone"), F.col("distance_m").alias(f"{p}_distance"), F.col("material").alias(f"{p}_material"))
    was = before.select(F.col("key").alias("category_id"), F.col("zone_id").alias("before_zone"))
    rows = items.join(home.select("id", F.col("zone_id").alias("home"), "cell", "pos", "pcls"), "id", "left").join(F.broadcast(was), "category_id", "left")  # a row for each category
    rows = rows.withColumn("after_zone", F.coalesce("home", "before_zone"))
    return rows.join(F.broadcast(z("before")), "before_zone", "left").join(F.broadcast(z("after")), "after_zone", "left").select(
        "id", "category_id", "material", "freq", "cls", "pcls", "flex", "pos", "before_zone", "before_distance", "after_zone", "after_material", "cell", "after_distance"
    )


def partner_rows(pairs: DataFrame, placed: DataFrame, item: int, min_count: int, min_lift: float = R.CLUSTER_LIFT, limit: int = 10) -> DataFrame:
    """A report: partners of an item in its material by lift, with their zone, gap in the order, and whether they lie side by side.

    pairs: a, b, count, lift; placed: id, material, zone_id, pos, cls.
    """
    mine = pairs.where(((F.col("a") == item) | (F.col("b") == item)) & (F.col("count") >= min_count) & (F.col("lift") >= min_lift))
    mine = mine.select(F.when(F.col("a") == item, F.col("b")).otherwise(F.col("a")).alias("id"), "count", "lift")
    own = placed.where(F.col("id") == item).select(F.col("material"), F.col("zone_id").alias("own_zone"), F.col("pos").alias("own_pos"))  # one row
    rows = mine.join(placed, "id").join(F.broadcast(own), "material")
    gap = F.abs(F.col("pos") - F.col("own_pos"))
    return rows.select("id", "count", "lift", "cls", "zone_id", gap.alias("order_gap"), (F.col("zone_id") == F.col("own_zone")).alias("same_zone"), (gap == 1).alias("adjacent")).orderBy(F.desc("lift"), "id").limit(limit)


def cold_start_cards(new: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each new item: its peers (items of its category and material that aren't new), the upper median of their frequencies, and whether it is placed loosely.

    new: id, flex; items: id, category_id, material, freq. Medians come from counts of distinct frequencies.
    """
    old = items.join(new.select("id"), "id", "left_anti").groupBy("category_id", "material", "freq").agg(F.count("*").alias("n"))
    by = Window.partitionBy("category_id", "material")
    run = old.withColumn("hi", F.sum("n").over(by.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    at = F.floor(F.col("all") / 2)
    mid = run.where((F.col("hi") > at) & (F.col("hi") - F.col("n") <= at)).select("category_id", "material", F.col("all").alias("peers"), F.col("freq").alias("median_freq"))
    return items.join(new, "id").join(mid, ["category_id", "material"], "left").select("id", "category_id", "material", "flex", F.coalesce("peers", F.lit(0)).alias("peers"), "median_freq")
