"""Repair of item dimensions and weight, volume, item master and storage class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.functions import text as T
from depotspark.operators.cleaning import _left
from depotspark.operators.graph import cut_lineage

EDGES = ["len_cm", "wid_cm", "hgt_cm"]
ALL = [*EDGES, "weight_kg"]


def typed(df: DataFrame) -> DataFrame:
    """Numbers without sign, zeros as null; x_<col>: above the limit."""
    df = df.withColumns({c: F.nullif(F.abs(T.number(F.col(c))), F.lit(0.0)) for c in ALL})
    return df.withColumns({f"x_{c}": _extreme(c) for c in ALL})


def _extreme(c: str, limit: str | None = None) -> Column:
    return F.coalesce(F.col(c) > R.EXTREME_MAX[limit or c], F.lit(False))


def value_counts(df: DataFrame, n: str | None = None) -> DataFrame:
    """(item_id, category_final, c, v, x, n, row_id): how often each item and category have each value of each column, null among
    them, x above the limit, and the first row of extreme ones. n: a column with how often each row stands in df."""
    # rows are counted before each becomes one for each column; only extreme values ask for their first row
    odd = F.greatest(*[_extreme(c) for c in ALL])
    rows = df.groupBy("item_id", "category_final", *ALL).agg(_times(n), F.min(F.when(odd, F.col("row_id"))).alias("row_id"))
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v"), _extreme(c).alias("x")) for c in ALL]))
    return rows.select("row_id", "item_id", "category_final", "n", long).groupBy("item_id", "category_final", "c", "v", "x").agg(F.sum("n").alias("n"), F.min("row_id").alias("row_id"))


def _times(n: str | None) -> Column:
    return (F.sum(n) if n else F.count("*")).alias("n")


def weighted_median(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, v, n) -> (keys, med, n): exact medians, the mean of both middle values, from running counts over distinct values."""
    per = counts.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.withColumn("hi", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    # places of the middle values, from 1
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    holds = lambda at: (F.col("hi") >= at) & (F.col("hi") - F.col("n") < at)
    mid = run.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"), F.sum("n").alias("n"))
    return mid.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("med"), "n")


def category_medians(counts: DataFrame) -> DataFrame:
    """(category_final, c, med, n): exact median and number of valid rows of each category and column."""
    return weighted_median(counts.where("not x and v is not null and category_final is not null"), ["category_final", "c"])


def _wide(long: DataFrame, key: str, values: dict[str, str], columns: list[str]) -> DataFrame:
    """long (key, c, values) -> one row for each key: <new>_<c> for each value and column. values: name -> new name."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col(v))).alias(f"{new}_{c}") for c in columns for v, new in values.items()])


def category_statistics(df: DataFrame) -> DataFrame:
    """Per category of the rows: exact median and number of valid rows of each column."""
    counts = cut_lineage(value_counts(df))
    every = counts.where("category_final is not null").select("category_final").distinct()
    out = every.join(_wide(category_medians(counts), "category_final", {"med": "med", "n": "n"}, ALL), "category_final", "left")
    return out.select("category_final", *[x for c in ALL for x in (f"med_{c}", F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}"))])


def shared_extremes(counts: DataFrame) -> DataFrame:
    """(c, v): extreme values that are the first extreme value of many items: likely defaults."""
    first = counts.where("x").groupBy("item_id", "c").agg(F.min_by("v", "row_id").alias("v"))
    return first.groupBy("c", "v").agg(F.count("*").alias("items")).where(F.col("items") >= R.SHARED_VALUE_ITEMS).select("c", "v")


def shared_values(df: DataFrame, c: str) -> DataFrame:
    return shared_extremes(value_counts(df)).where(F.col("c") == c).select(F.col("v").alias(f"shared_{c}"))


def _item_modes(counts: DataFrame) -> DataFrame:
    """(item_id, c, mode): each item's commonest valid value, ties to the smallest text."""
    sums = counts.where("not x and v is not null and item_id is not null").groupBy("item_id", "c", "v").agg(F.sum("n").alias("n"))
    return sums.groupBy("item_id", "c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v").cast("string"))).alias("mode"))


def _factor(v: Column, x: Column, mode: Column, med: Column, n: Column, shared: Column, limit: Column) -> Column:
    """What an extreme value has to be divided by to fit its category; null where it doesn't or where something else repairs it."""
    fits = lambda f: (v / f).between(med * (1.0 / R.PLAUSIBLE_RATIO), med * R.PLAUSIBLE_RATIO) & (v / f <= limit)
    scaled = F.lit(None).cast("int")
    for f in reversed(R.UNIT_FACTORS):
        scaled = F.when(fits(f), F.lit(f)).otherwise(scaled)
    return F.when(x & mode.isNull() & ~shared & (n >= R.MIN_CATEGORY_ROWS), scaled)


def _decide(v: Column, x: Column, mode: Column, shared: Column, factor: Column) -> tuple[Column, Column]:
    """(source, repaired value) of a value v, x above its limit: item mode, category range ÷f, excluded, missing, extreme, or as it was."""
    by_item, suspect = (v.isNull() | x) & mode.isNotNull(), x & shared
    source = (
        F.when(v.isNotNull() & ~x, "original").when(by_item, "item mode").when(suspect, "excluded").when(factor.isNotNull(), F.concat(F.lit("category range /"), factor.cast("string")))
        .when(v.isNull(), "missing").otherwise("extreme")
    )
    return source, F.when(by_item, mode).when(suspect, None).when(factor.isNotNull(), v / factor).otherwise(v)


class Findings:
    """What the counts of values say: item modes, category medians, shared extremes, and the medians that fill what is missing.

    All come from one table of counts (items, categories and distinct values), never from a second look at the rows: repaired
    values are decided for counts as they are for rows. Each is written, so that rows meet tables of known size.
    """

    def __init__(self, df: DataFrame, n: str | None = None):
        """df: rows with typed columns, see typed; n: see value_counts."""
        self.counts = cut_lineage(value_counts(df, n))
        self.modes, self.medians, self.shared = (cut_lineage(x) for x in (_item_modes(self.counts), category_medians(self.counts), shared_extremes(self.counts)))

    def decided(self) -> DataFrame:
        """Counts with source and value after repair."""
        marked = self.counts.join(self.modes, ["item_id", "c"], "left").join(self.medians.withColumnRenamed("n", "k"), ["category_final", "c"], "left").join(self.shared.withColumn("s", F.lit(True)), ["c", "v"], "left")
        limit = F.create_map(*[x for c in ALL for x in (F.lit(c), F.lit(R.EXTREME_MAX[c]))])[F.col("c")]
        shared = F.coalesce("s", F.lit(False))
        marked = marked.withColumn("f", _factor(F.col("v"), F.col("x"), F.col("mode"), F.col("med"), F.col("k"), shared, limit))
        source, value = _decide(F.col("v"), F.col("x"), F.col("mode"), shared, F.col("f"))
        return marked.select("item_id", "category_final", "c", "n", source.alias("source"), value.alias("v"))

    def fills(self) -> DataFrame:
        """(category_final, c, fill, k): median over the medians of a category's items, and their number. Weight is never filled."""
        known = self.decided().where("source <> 'extreme' and v is not null and category_final is not null and item_id is not null").where(F.col("c").isin(EDGES))
        items = weighted_median(known, ["category_final", "item_id", "c"]).select("category_final", "c", F.col("med").alias("v"), F.lit(1).alias("n"))
        return weighted_median(items, ["category_final", "c"]).select("category_final", "c", F.col("med").alias("fill"), F.col("n").alias("k"))


def _repaired(df: DataFrame, found: Findings, fills: DataFrame | None = None) -> DataFrame:
    """Only rows with a value that is missing or extreme meet what was found; the others stay as they are."""
    ask = _asks()
    mended = _mended(df.where(ask), found)
    return _as_it_was(df.where(~ask)).unionByName(mended if fills is None else _with_medians(mended, fills))


def _asks(suffix: str = "") -> Column:
    """A value is missing or extreme."""
    return F.greatest(*[F.col(f"{c}{suffix}").isNull() | _extreme(f"{c}{suffix}", c) for c in ALL])


def _as_it_was(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_source": F.lit("original") for c in ALL} | {f"{c}_before": F.col(c) for c in ALL})


def _mended(df: DataFrame, found: Findings) -> DataFrame:
    out = _left(df, cut_lineage(_wide(found.modes, "item_id", {"mode": "mode"}, ALL)), "item_id")
    out = out.join(cut_lineage(_wide(found.medians, "category_final", {"med": "med", "n": "n"}, ALL)), "category_final", "left")
    for c in ALL:
        out = out.join(found.shared.where(F.col("c") == c).select(F.col("v").alias(f"shared_{c}")), out[c] == F.col(f"shared_{c}"), "left")
    of = lambda p, c: F.col(f"{p}_{c}")
    # one step for each decision, so that no expression stands in another more than once
    out = out.withColumns({f"f_{c}": _factor(F.col(c), of("x", c), of("mode", c), of("med", c), of("n", c), of("shared", c).isNotNull(), F.lit(R.EXTREME_MAX[c])) for c in ALL})
    new = {}
    for c in ALL:
        source, value = _decide(F.col(c), of("x", c), of("mode", c), of("shared", c).isNotNull(), of("f", c))
        new |= {f"{c}_source": source, f"{c}_before": F.col(c), c: value}
    out = out.withColumns(new).withColumns({f"x_{c}": F.col(f"{c}_source") == "extreme" for c in ALL})
    return out.drop(*[f"{p}_{c}" for c in ALL for p in ("mode", "med", "n", "shared", "f")])


def repair(cleaned: DataFrame) -> DataFrame:
    """Each column and its <col>_source: original, item mode, category range ÷f, excluded, missing or extreme. cleaned is read for the counts and for the rows."""
    df = typed(cleaned)
    return _repaired(df, Findings(df))


def measure(cleaned: DataFrame) -> DataFrame:
    """repair, missing edges filled by the category's median over item medians from three items on, and volumes. Rows are read twice and not written in between."""
    df = typed(cleaned)
    found = Findings(df)
    fills = cut_lineage(_wide(found.fills(), "category_final", {"fill": "m", "k": "k"}, EDGES))
    return with_volume(_repaired(df, found, fills))


ALIKE = ["item_id", "name_filled", "category_final"]  # with the values: what repairs and the master know of a row


def repairs(cleaned: DataFrame) -> DataFrame:
    """measure, once for all rows that are equal in ALIKE and their four values: n rows, and the first of them. Its rows are narrow
    and fewer than those of cleaned, which is read once."""
    alike = cut_lineage(typed(cleaned).groupBy(*ALIKE, *ALL).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")))
    df, found = typed(alike), Findings(alike, "n")
    fills = cut_lineage(_wide(found.fills(), "category_final", {"fill": "m", "k": "k"}, EDGES))
    return with_volume(_repaired(df, found, fills))


def _alike(suffix: str = "") -> dict[str, Column]:
    """128 bits of what equal rows share, nulls told apart from values."""
    of = [F.col(c) for c in ALIKE] + [F.col(f"{c}{suffix}") for c in ALL]
    return {f"_a{i}": F.xxhash64(F.lit(i), *[x for c in of for x in (c, c.isNull())]) for i in range(2)}


def mended(cleaned: DataFrame, repaired: DataFrame) -> DataFrame:
    """What measure gives for the rows, from their repairs. Rows with a missing or extreme value meet their repair in one join; the
    others need none."""
    df, ask = typed(cleaned), _asks()
    plain = with_volume(_as_it_was(df.where(~ask)))
    new = [c for c in plain.columns if c not in cleaned.columns or c in ALL]
    fixes = repaired.where(_asks("_before")).select(*[k.alias(a) for a, k in _alike("_before").items()], F.struct(*new).alias("_fix"))
    met = df.where(ask).withColumns(_alike()).join(fixes, ["_a0", "_a1"], "left")
    return plain.unionByName(met.select(*[F.col("_fix")[c].alias(c) if c in new else c for c in plain.columns]))


def _with_medians(df: DataFrame, fills: DataFrame) -> DataFrame:
    """Missing edges by the category's fill, see measure."""
    out = df.join(fills, "category_final", "left")
    new = {}
    for c in EDGES:
        use = F.col(c).isNull() & (F.coalesce(F.col(f"k_{c}"), F.lit(0)) >= R.MIN_CATEGORY_ITEMS)
        new |= {f"{c}_source": F.when(use, "category median").otherwise(F.col(f"{c}_source")), c: F.when(use, F.col(f"m_{c}")).otherwise(F.col(c))}
    return out.withColumns(new).drop(*[f"{p}_{c}" for c in EDGES for p in ("m", "k")])


def with_volume(df: DataFrame) -> DataFrame:
    """volume_cm3, volume_source (實測, 類別推估, 無法計算) and volume_review."""
    volume = F.col("len_cm") * F.col("wid_cm") * F.col("hgt_cm")
    guessed = (F.col("len_cm_source") == "category median") | (F.col("wid_cm_source") == "category median") | (F.col("hgt_cm_source") == "category median")
    odd = F.col("x_len_cm") | F.col("x_wid_cm") | F.col("x_hgt_cm") | F.coalesce(volume > R.EXTREME_VOLUME, F.lit(False))
    return df.withColumn("volume_cm3", volume).withColumn("volume_source", F.when(volume.isNull(), "無法計算").when(guessed, "類別推估").otherwise("實測")).withColumn("volume_review", odd.cast("int"))


SOURCES = ["len_cm_source", "wid_cm_source", "hgt_cm_source", "weight_kg_source", "volume_source"]


def item_master(df: DataFrame, n: str | None = None) -> DataFrame:
    """One row for each item: modes, volume, longest edge, what each dimension comes from, conflicts, storage class and its reason.
    n: a column with how often each row counts.

    Every column is unpivoted once into counts of (item, column, value); modes, conflicts and sources are aggregations of those.
    """
    texts = ["name_filled", "category_final", *ALL, *SOURCES]
    # the rows are read once: their number is that of a text which every row has. Equal rows of an item are counted before they are unpivoted
    equal = df.where("item_id is not null").groupBy("item_id", *texts).agg(_times(n))
    long = F.inline(F.array(F.struct(F.lit("row").alias("c"), F.lit("").alias("v")), *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in texts]))
    counts = equal.select("item_id", "n", long).where("v is not null").groupBy("item_id", "c", "v").agg(F.sum("n").alias("n"))
    told = F.col("c").isin(SOURCES)
    tops = counts.groupBy("item_id", "c").agg(
        F.min_by("v", F.struct(-F.col("n"), "v")).alias("v"), F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.col("v") == "類別推估").alias("imputed"), F.sort_array(F.collect_list(F.when(told, F.struct((-F.col("n")).alias("m"), "v")))).alias("s"), F.max(F.col("v") == "category median").alias("guessed"),
    )
    tops = tops.withColumn("s", F.transform("s", lambda x: F.concat(x["v"], F.lit("×"), (-x["m"]).cast("string"))))
    tops = tops.withColumn("s", F.array_join(F.when(F.col("c") == "volume_source", F.sort_array("s")).otherwise(F.col("s")), "; "))
    one = lambda c, x="v": F.max(F.when(F.col("c") == c, F.col(x)))
    edge_guess = F.coalesce(F.max(F.when(F.col("c").isin([f"{c}_source" for c in EDGES]), F.col("guessed"))), F.lit(False))
    out = tops.groupBy("item_id").agg(
        one("name_filled").alias("item_name"), one("category_final").cast("int").alias("category_id"), *[one(c).cast("double").alias(c) for c in ALL],
        *[(F.coalesce(one(c, "k"), F.lit(0)) > 1).cast("int").alias(f"{c}_conflict") for c in ALL], *[one(c, "s").alias("sources" if c == "volume_source" else f"{c}s") for c in SOURCES], edge_guess.alias("guessed"),
        one("row", "n").alias("n_rows"), F.max(F.when(F.col("c") == "volume_source", F.col("imputed"))).cast("int").alias("any_imputed"),
    )
    out = out.withColumn("volume_cm3", F.col("len_cm") * F.col("wid_cm") * F.col("hgt_cm")).withColumn("edge_cm", F.greatest(*EDGES))
    size = F.when(F.col("volume_cm3").isNull(), "無法計算(缺維度)").when(F.col("guessed"), "類別推估").otherwise("實測")
    out = out.withColumn("size_source", size).withColumn("volume_usable", F.col("volume_cm3").isNotNull()).drop("guessed")
    return out.withColumn("storage_class", T.storage_class(F.col("volume_cm3"), F.col("edge_cm"))).withColumn("class_reason", T.storage_reason(F.col("volume_cm3"), F.col("edge_cm")))
