"""Period totals, calendars, model selection, multi-step checks, life cycle, cold start, predicted classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.functions import series as S
from depotspark.functions import text as T
from depotspark.operators.abc import classes
from depotspark.operators.errors import NotFound, TooFewPeriods, one_of, within
from depotspark.operators.graph import cut_lineage

TEST_WEEKS = 13  # test length of weekly series


def with_period(sales: DataFrame, granularity: str = "month") -> DataFrame:
    key = T.month_key(F.col("ship_date")) if granularity == "month" else T.week_key(F.col("ship_date"))
    return sales.where("ship_date is not null and qty > 0").withColumn("period", key)


def period_totals(sales: DataFrame, granularity: str = "month") -> DataFrame:
    """One pass for three groupings: level (all, category, item), key, period, qty, cnt."""
    rows = with_period(sales, granularity)
    sets = rows.groupingSets([[F.col("period")], [F.col("category_id"), F.col("period")], [F.col("item_id"), F.col("period")]], F.col("category_id"), F.col("item_id"), F.col("period"))
    out = sets.agg(F.sum("qty").alias("qty"), F.count("*").alias("cnt"), F.grouping("category_id").alias("gc"), F.grouping("item_id").alias("gi"))
    level = F.when((F.col("gc") == 1) & (F.col("gi") == 1), "all").when(F.col("gc") == 0, "category").otherwise("item")
    return out.select(level.alias("level"), F.coalesce(F.when(F.col("gc") == 0, F.col("category_id").cast("long")), F.when(F.col("gi") == 0, F.col("item_id"))).alias("key"), "period", "qty", "cnt")


def calendar(sales: DataFrame, granularity: str = "month") -> DataFrame:
    """(idx, period) from first to last without gaps; the last month is left out when its data stop before its end."""
    ends = sales.where("ship_date is not null and qty > 0").agg(F.min("ship_date").alias("lo"), F.max("ship_date").alias("hi")).where("lo is not null")
    if granularity == "month":
        days = ends.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("d"), "hi").where((F.last_day("d") <= F.col("hi")) | (F.trunc("hi", "month") > F.col("d")))
        return days.select((F.months_between("d", F.min("d").over(_all())).cast("int")).alias("idx"), T.month_key(F.col("d")).alias("period"))
    days = ends.select(F.explode(F.sequence(F.date_trunc("week", "lo").cast("date"), F.date_trunc("week", "hi").cast("date"), F.expr("interval 7 day"))).alias("d"))
    return days.select((F.datediff("d", F.min("d").over(_all())) / 7).cast("int").alias("idx"), F.date_format("d", "yyyy-MM-dd").alias("period"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # over the calendar: as many rows as periods


def dense(sales: DataFrame, key: str, target: str = "qty", granularity: str = "month", cal: DataFrame | None = None) -> DataFrame:
    """key, s: array of the target for every period of the calendar (by default that of the sales), 0 where nothing was shipped."""
    cal = F.broadcast(calendar(sales, granularity) if cal is None else cal)  # one row for each period
    value = F.sum("qty") if target == "qty" else F.count("*").cast("double")
    got = with_period(sales, granularity).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "period").agg(value.alias("v")).join(cal, "period")
    n = cal.agg(F.count("*").cast("int").alias("n"))
    m = got.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("idx", "v"))).alias("m"))  # at most one entry for each period
    return m.crossJoin(F.broadcast(n)).select("key", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("s"))


def train_end(s, test: int = R.TEST_MONTHS):
    return F.size(s) - test


def one_step(d: DataFrame) -> DataFrame:
    """The six models from the end of training."""
    h = F.slice("s", 1, train_end("s"))
    return d.select("key", *[f(h).alias(n) for f, n in zip(S.ONE_STEP, ["naive", "snaive", "ma3", "ses", "holt", "croston"])])


def select(d: DataFrame, horizon: int = 3) -> DataFrame:
    """Adds te, the chosen model's rank and name, its walk-forward mase, denom and predictions. Each series is walked once."""
    d = d.withColumn("te", train_end("s", horizon)).withColumn("w", S.walked(F.col("s"), F.col("te"))).withColumn("best", S.select_model(F.col("w"), F.col("te")))
    d = d.withColumn("rank", F.col("best.rank")).withColumn("train_mase", F.col("best.mase"))
    d = d.withColumn("model", F.get(F.array(*[F.lit(m) for m in R.MODELS]), F.col("rank"))).withColumn("denom", S.denominator(F.col("w")))
    d = d.withColumn("pred", S.multi_step(F.col("s"), F.col("w"), F.col("rank"), horizon)).withColumn("actual", F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.coalesce(F.get("s", F.col("te") + k), F.lit(0.0))))
    return d.drop("w", "best")


def _sum(a):
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def accuracy(chosen: DataFrame, horizon: int = 3) -> DataFrame:
    """wape (null for no actuals), mase (null for flat training) and total error in percent."""
    ae = _sum(F.zip_with("pred", "actual", lambda p, a: F.abs(p - a)))
    sa, sp = _sum(F.col("actual")), _sum(F.col("pred"))
    return chosen.select("key", "model", F.when(sa > 0, ae / sa * 100).alias("wape"), F.when(F.col("denom") > 0, ae / horizon / F.col("denom")).alias("mase"), F.when(sa > 0, F.abs(sp - sa) / sa * 100).alias("tot_err"), sp.alias("pred_sum"), sa.alias("actual_sum"))


def _first_last(d: DataFrame) -> DataFrame:
    idx = F.filter(F.transform("s", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    return d.withColumn("idx", idx).where(F.size("idx") > 0).withColumn("first", F.get("idx", F.lit(0))).withColumn("last", F.get("idx", F.size("idx") - 1)).drop("idx")


def lifecycle(d: DataFrame, recent: int = R.RECENT_PERIODS) -> DataFrame:
    """新品 (first shipped within the last periods of training or later), 滯銷 (not shipped lately), 正常; periods since the last shipment."""
    d = _first_last(d).withColumn("te", train_end("s")).withColumn("n", F.size("s"))
    cls = F.when(F.col("first") >= F.col("te") - recent, "新品").when(F.col("last") <= F.col("n") - 1 - recent, "滯銷").otherwise("正常")
    return d.select("key", "first", "last", (F.col("n") - 1 - F.col("last")).alias("dormant"), cls.alias("stage"))


def new_items(d: DataFrame, recent: int = R.RECENT_PERIODS) -> DataFrame:
    return _first_last(d).where(F.col("first") >= train_end("s") - recent).select("key", "first")


def item_profile(sales: DataFrame) -> DataFrame:
    """Category and storage class of each item's first row."""
    return sales.where("item_id is not null").groupBy(F.col("item_id").alias("key")).agg(F.min_by(F.struct("category_id", "storage_class"), "row_id").alias("p")).select("key", "p.*")


def analogue_levels(d: DataFrame, profile: DataFrame, recent: int = R.RECENT_PERIODS) -> DataFrame:
    """Upper median of mature items' mean training level by category and storage class, and their number."""
    mature = d.join(new_items(d, recent).select("key"), "key", "left_anti").withColumn("te", train_end("s"))
    level = mature.withColumn("level", _sum(F.slice("s", 1, F.col("te"))) / F.col("te")).where("level > 0").join(profile, "key")
    peers = level.groupBy("category_id", "storage_class").agg(F.sort_array(F.collect_list("level")).alias("a"))  # a category's items
    return peers.select("category_id", "storage_class", F.size("a").alias("peers"), F.get("a", F.floor(F.size("a") / 2).cast("int")).alias("level"))


def cold_start(d: DataFrame, profile: DataFrame, recent: int = R.RECENT_PERIODS) -> DataFrame:
    """New items: their last non-zero training value, else the analogue level, else 0; flat over the horizon."""
    new = d.join(new_items(d, recent).select("key"), "key", "left_semi").withColumn("te", train_end("s"))
    own = F.filter(F.slice("s", 1, F.greatest(F.lit(0), F.col("te"))), lambda v: v > 0)
    new = new.withColumn("own", F.get(own, F.size(own) - 1)).join(profile, "key").join(analogue_levels(d, profile, recent), ["category_id", "storage_class"], "left")
    return new.select("key", F.when(F.col("own").isNotNull(), "own").when(F.col("level").isNotNull(), "analogue").otherwise("none").alias("source"), F.coalesce("own", "level", F.lit(0.0)).alias("level"))


def weekly_naive(sales: DataFrame, key: str = "item_id", test: int = TEST_WEEKS) -> DataFrame:
    """Picks of each item (or category) by week: key, n weeks, total, the naive forecast for each of the last `test` weeks, their actual sum and mean absolute error."""
    d = dense(sales, key, "cnt", "week").withColumn("k", F.greatest(F.size("s") - test, F.lit(0)))
    d = d.withColumn("naive", S.naive(F.slice("s", F.lit(1), F.col("k")))).withColumn("last", F.slice("s", F.col("k") + 1, F.size("s")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    error = add(F.transform("last", lambda x: F.abs(x - F.col("naive")))) / F.size("last")
    return d.select("key", F.size("s").alias("n"), add("s").alias("total"), "naive", add("last").alias("actual"), error.alias("mae"))


def totals_in_window(sales: DataFrame, lo: str, hi: str, granularity: str = "month") -> DataFrame:
    """Items with a positive total between two periods."""
    rows = with_period(sales, granularity).where(F.col("period").between(lo, hi) & F.col("item_id").isNotNull())
    return rows.groupBy("item_id").agg(F.sum("qty").alias("total")).where("total > 0")


def predicted_items(sales: DataFrame, target: str = "qty", recent: int = R.RECENT_PERIODS, horizon: int = 3, profile: DataFrame | None = None) -> DataFrame:
    """key, value (sum over the horizon), is_new: selection for mature items, cold start for new ones. profile: item_profile(sales), where it is written already."""
    # every step below reads the series, some more than once: they are written
    d, profile = cut_lineage(dense(sales, "item_id", target)), cut_lineage(item_profile(sales)) if profile is None else profile
    mature = accuracy(select(d.join(new_items(d, recent).select("key"), "key", "left_anti"), horizon), horizon).select("key", F.col("pred_sum").alias("value"), F.lit(0).alias("is_new"))
    new = cold_start(d, profile, recent).select("key", (F.col("level") * horizon).alias("value"), F.lit(1).alias("is_new"))
    return cut_lineage(mature.unionByName(new))  # else a filter above would run the selection again below


def predicted_categories(sales: DataFrame, horizon: int = 3) -> DataFrame:
    """Categories by storage class: shelf ones by predicted picks, pallet ones by predicted quantity, classed within each."""
    shelf = F.sum((F.col("storage_class") == "貨架").cast("int"))
    pallet = F.sum((F.col("storage_class") == "棧板").cast("int"))
    material = sales.where("category_id is not null").groupBy(F.col("category_id").alias("key")).agg(F.when(pallet > shelf, "棧板").otherwise("貨架").alias("material"))
    value = lambda t: accuracy(select(dense(sales, "category_id", t), horizon), horizon).select("key", F.round("pred_sum", 6).alias(t))
    both = cut_lineage(value("qty")).join(cut_lineage(value("cnt")), "key").join(material, "key").withColumn("value", F.when(F.col("material") == "貨架", F.col("cnt")).otherwise(F.col("qty"))).where("value > 0")
    return classes(both.select("key", "material", "value"), "value", "key", within="material")


def with_history(predicted: DataFrame, freq: DataFrame, n_periods: int, horizon: int = 3) -> DataFrame:
    """Predicted value, or history times horizon over periods for items without one."""
    out = freq.select(F.col("item_id").alias("key"), "freq").join(predicted, "key", "full_outer")
    return out.select("key", F.coalesce("value", F.col("freq") * F.lit(float(horizon)) / n_periods).alias("value"), F.col("value").isNull().cast("int").alias("from_history"))


def context(d: DataFrame, horizon: int = 3) -> DataFrame:
    """One row: periods, where training ends, and whether there are too few for a forecast."""
    return d.limit(1).select(F.size("s").alias("n_periods"), (F.size("s") - horizon).alias("train_end"), F.lit(horizon).alias("horizon"), (F.size("s") < horizon + R.MIN_TRAIN).alias("insufficient"))


def rolling(d: DataFrame, horizon: int = 3) -> DataFrame:
    """key, h, pred, actual: the chosen model one step ahead in each test period, with the actual values up to it."""
    chosen = select(d, horizon)
    steps = chosen.select("key", "s", "te", "rank", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
    past = F.slice("s", F.lit(1), F.col("te") + F.col("h"))
    value = F.get(F.array(*[f(past) for f in S.ONE_STEP]), F.col("rank"))
    return steps.select("key", (F.col("h") + 1).alias("h"), F.greatest(F.lit(0.0), value).alias("pred"), F.coalesce(F.get("s", F.col("te") + F.col("h")), F.lit(0.0)).alias("actual"))


def series(sales: DataFrame, item: int | None = None, category: int | None = None, target: str = "qty", granularity: str = "month", recent: int = R.RECENT_PERIODS, horizon: int = 3) -> DataFrame:
    """One series, of an item, a category or of all: idx, period, actual, in_test, pred (in the test periods), model, wape, mase, is_new.

    A new item (by month) has its cold start for a prediction and no errors. RequestError: parameters out of bounds;
    TooFewPeriods: the calendar is too short; NotFound: nothing was shipped.
    """
    one_of("granularity", granularity, ("month", "week"))
    one_of("target", target, ("qty", "cnt"))
    within("recent", recent, 1, 24)
    within("horizon", horizon, 1, R.TEST_MONTHS)
    cal = cut_lineage(calendar(sales, granularity))
    if cal.count() < horizon + R.MIN_TRAIN:
        raise TooFewPeriods(f"fewer than {horizon + R.MIN_TRAIN} periods")
    mine = sales.where(F.col("item_id") == item) if item is not None else sales.where(F.col("category_id") == category) if category is not None else sales
    d = cut_lineage(dense(mine.withColumn("_key", F.lit(0)), "_key", target, granularity, cal).where(F.exists("s", lambda v: v > 0)))
    if d.isEmpty():
        raise NotFound(f"nothing shipped of {'item ' + str(item) if item is not None else 'category ' + str(category) if category is not None else 'anything'}")
    chosen = select(d, horizon)
    told = chosen.join(accuracy(chosen, horizon).select("key", "wape", "mase"), "key").select("s", "te", "pred", "model", "wape", "mase", F.lit(0).alias("is_new"))
    if item is not None and granularity == "month":
        every, profile = dense(sales, "item_id", target), item_profile(sales)
        cold = cut_lineage(cold_start(every, profile, recent).where(F.col("key") == item))
        if not cold.isEmpty():
            none = F.lit(None).cast("double")
            flat = F.array_repeat("level", horizon)
            told = d.join(cold.select("source", "level")).select("s", train_end("s", horizon).alias("te"), flat.alias("pred"), F.concat(F.lit("cold start: "), "source").alias("model"), none.alias("wape"), none.alias("mase"), F.lit(1).alias("is_new"))  # one row each
    rows = told.select("te", "pred", "model", "wape", "mase", "is_new", F.posexplode("s").alias("idx", "actual")).join(F.broadcast(cal), "idx")
    test = F.col("idx") >= F.col("te")
    return rows.select("idx", "period", "actual", test.alias("in_test"), F.when(test, F.get("pred", F.col("idx") - F.col("te"))).alias("pred"), "model", "wape", "mase", "is_new")


def breakdown(sales: DataFrame, names: DataFrame, target: str = "qty", horizon: int = 3) -> DataFrame:
    """One row for each category: label, actual and predicted sums, errors and model. names: category_id, category_name."""
    rows = accuracy(select(dense(sales, "category_id", target), horizon), horizon)
    rows = rows.join(F.broadcast(names), rows["key"] == names["category_id"], "left")  # the list of categories
    return rows.select("key", T.category_label(F.col("key"), F.col("category_name")).alias("label"), "actual_sum", "pred_sum", "wape", "mase", "model")


def item_rows(sales: DataFrame, names: DataFrame, target: str = "qty", recent: int = R.RECENT_PERIODS, horizon: int = 3) -> DataFrame:
    """One row for each item shipped: code, name, category, label, sums, errors, model, is_new. New items have a cold start and no errors."""
    d, profile = dense(sales, "item_id", target), item_profile(sales)
    new = cut_lineage(new_items(d, recent).select("key"))
    mature = accuracy(select(d.join(new, "key", "left_anti"), horizon), horizon).select("key", "model", "pred_sum", "actual_sum", "wape", "tot_err", F.lit(0).alias("is_new"))
    tail = _sum(F.slice("s", train_end("s", horizon) + 1, F.lit(horizon)))
    cold = cold_start(d, profile, recent).join(d.select("key", tail.alias("actual_sum")), "key")
    none = F.lit(None).cast("double")
    cold = cold.select("key", F.concat(F.lit("cold start: "), "source").alias("model"), (F.col("level") * horizon).alias("pred_sum"), "actual_sum", none.alias("wape"), none.alias("tot_err"), F.lit(1).alias("is_new"))
    total = d.select("key", _sum(F.col("s")).alias("total")).where("total > 0")
    first = F.min_by(F.struct("item_code", "item_name", "category_id"), "row_id").alias("m")
    meta = sales.where("item_id is not null").groupBy(F.col("item_id").alias("key")).agg(first).select("key", "m.*")
    rows = cut_lineage(mature.unionByName(cold)).join(total, "key").join(meta, "key").join(F.broadcast(names), "category_id", "left")
    return rows.select("key", F.col("item_code").alias("code"), F.col("item_name").alias("name"), "category_id", T.category_label(F.col("category_id"), F.col("category_name")).alias("label"), "total", "actual_sum", "pred_sum", "wape", "tot_err", "model", "is_new")


def item_top(rows: DataFrame, candidates: int = 200, top: int = 20) -> DataFrame:
    """A report in two stages: the items with the largest totals, and of these the ones with the largest actual sums. rows: see item_rows."""
    within("candidates", candidates, 1, 1000)
    within("top", top, 1, 100)
    pool = rows.orderBy(F.desc("total"), "key").limit(candidates)
    return pool.orderBy(F.desc("actual_sum"), "key").limit(top)
