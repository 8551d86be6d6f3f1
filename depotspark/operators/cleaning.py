"""Isolation of faulty order lines, category repair, change log.

One DataFrame carries clean and isolated rows; the reason is a nullable column. First means smallest row_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.functions import text as T
from depotspark.operators.graph import cut_lineage

WORDS = 1 << 19  # most rows of a table of bits, which is broadcast: 64 keys' bits in each
RAW_COLUMNS = ["ship_no", "store_order_no", "store_code", "address", "item_id", "item_code", "item_name", "category_id", "qty", "unit", "len_cm", "wid_cm", "hgt_cm", "weight_kg"]


def require_columns(df: DataFrame) -> DataFrame:
    """Headers are trimmed; the required columns must be there; others are dropped."""
    df = df.toDF(*[c.strip() for c in df.columns])
    missing = [c for c in ["row_id", *RAW_COLUMNS] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select("row_id", *RAW_COLUMNS)


def _hash(columns: list[str], *seed: Column) -> Column:
    """64 bits of the columns, nulls told apart from texts."""
    return F.xxhash64(*seed, *[x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())])


def row_key(columns: list[str]) -> list[Column]:
    """Two independent 64-bit hashes of the columns: rows with equal keys are equal."""
    return [_hash(columns).alias("_k1"), _hash(columns, F.lit(1)).alias("_k2")]


def word_of(key: Column) -> Column:
    """The row of a table of bits that a hash falls into, and bit_of its bit there."""
    return F.pmod(key, F.lit(WORDS)).cast("int")


def bit_of(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(key, 40), F.lit(64)).cast("int"))


def may_meet(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with `_may`: false where the hash `key` is surely none of keys, so that only the other rows need to be shuffled to meet
    them. The bits of all keys are a table of at most WORDS rows, whatever their number; with more keys more rows say true."""
    bit, word = bit_of(F.col(key)), word_of(F.col(key))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return met.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def repeats(rows: DataFrame, name: str) -> DataFrame:
    """rows (row_id, _k1, _k2) -> (_k1, _k2, name): of keys that several rows have, the smallest row_id. Map-side combining shrinks hot keys."""
    return rows.groupBy("_k1", "_k2").agg(F.min("row_id").alias(name), F.count("*").alias("_n")).where("_n > 1").drop("_n")


def mark_repeats(keyed: DataFrame, name: str) -> DataFrame:
    """keyed (rows with _k1 and _k2, see row_key) with `name` instead: an earlier row has the same key. keyed is a written table: it
    is read for the repeats, which are few and written before the rows meet them, and for the rows."""
    first = cut_lineage(repeats(keyed.select("row_id", "_k1", "_k2"), "_first"))
    keyed = may_meet(keyed, first, "_k1")
    later = keyed.where("_may").join(first, ["_k1", "_k2"], "left").withColumn(name, F.coalesce(F.col("row_id") > F.col("_first"), F.lit(False))).drop("_first")
    return keyed.where("not _may").withColumn(name, F.lit(False)).unionByName(later).drop("_k1", "_k2", "_may")


def with_repeat(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows with `name`: an earlier row is equal in the columns. rows is a table that can be read twice."""
    return mark_repeats(rows.select("*", *row_key(columns)), name)


def typed(raw: DataFrame) -> DataFrame:
    """Typed columns; qty_raw keeps the text. A projection: what nobody reads isn't made."""
    return require_columns(raw).select(*_typed())


def _typed() -> list[str | Column]:
    return [
        "row_id", "ship_no", T.null_tokens(F.col("store_order_no")).alias("store_order_no"), "store_code", "address",
        T.to_int(F.col("item_id")).alias("item_id"), T.strip(F.col("item_code")).alias("item_code"), T.strip(F.col("item_name")).alias("item_name"),
        T.to_int(F.col("category_id")).cast("int").alias("category_id"), F.col("qty").alias("qty_raw"), T.number(F.col("qty")).alias("qty"),
        T.strip(F.col("unit")).alias("unit"), *RAW_COLUMNS[10:],
    ]


def normalize(raw: DataFrame) -> DataFrame:
    """typed, with raw_dup: repeats of an earlier raw row."""
    keyed = require_columns(raw).select(*_typed(), *row_key(RAW_COLUMNS))
    return mark_repeats(cut_lineage(keyed), "raw_dup")  # read for the repeats, the modes and the rows


def mode_of(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """counts (key, value, n) -> the value with the largest sum of n for each key; ties to the smallest text. Nulls don't count."""
    sums = counts.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.sum("n").alias("_n"))
    return sums.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value).cast("string"))).alias(name))


def mode_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value for each key; ties to the smallest text. Nulls don't count."""
    return mode_of(df.select(key, value, F.lit(1).alias("n")), key, value, name)


def _left(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on a key that may be null in many rows: those get a second key of their own and meet nothing, so they aren't one hot group."""
    lone = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("row_id"), F.lit(1 << 16)) + 1).otherwise(F.lit(0))
    side = side.withColumnRenamed(key, "_side").withColumn("_s", F.lit(0).cast("long"))
    filler = F.coalesce(F.col(key), F.lit("" if dict(df.dtypes)[key] == "string" else 0).cast(dict(df.dtypes)[key]))
    keyed = df.withColumn("_s0", lone).withColumn("_key", filler)
    return keyed.join(side, (F.col("_key") == F.col("_side")) & (F.col("_s0") == F.col("_s")), "left").drop("_s0", "_key", "_side", "_s")


def _modes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, _name, _cat) and (name_filled, _by_name): modes over all rows, from one table of counts."""
    counts = cut_lineage(df.groupBy("item_id", "item_name", "category_id").agg(F.count("*").alias("n")))
    items = mode_of(counts, "item_id", "item_name", "_name").join(mode_of(counts, "item_id", "category_id", "_cat"), "item_id", "full_outer")
    items = cut_lineage(items)
    named = counts.join(items, "item_id", "left").select(F.coalesce("item_name", "_name").alias("name_filled"), F.coalesce("category_id", "_cat").alias("c"), "n")
    return items, cut_lineage(mode_of(named, "name_filled", "c", "_by_name"))


def _filled(df: DataFrame, items: DataFrame, by_name: DataFrame) -> DataFrame:
    df = _left(df, items, "item_id").withColumn("name_filled", F.coalesce("item_name", "_name")).withColumn("_c1", F.coalesce("category_id", "_cat"))
    df = _left(df, by_name, "name_filled")
    return df.withColumn("category_filled", F.coalesce("_c1", "_by_name")).drop("_name", "_cat", "_c1", "_by_name")


def _whole() -> Column:
    """Nothing has to be filled."""
    return F.col("item_name").isNotNull() & F.col("category_id").isNotNull()


def _as_it_is(df: DataFrame) -> DataFrame:
    return df.withColumn("name_filled", F.col("item_name")).withColumn("category_filled", F.col("category_id"))


def fill(df: DataFrame) -> DataFrame:
    """Names by the item's mode, categories by the item's mode and then by the name's. Only rows that lack one meet the modes."""
    return _as_it_is(df.where(_whole())).unionByName(_filled(df.where(~_whole()), *_modes(df)))


MEASURES = RAW_COLUMNS[10:]
SAME = ["ship_no", "store_order_no", "store_code", "address", "item_id", "item_code", "qty_raw", "unit", "len_cm", "wid_cm", "hgt_cm", "weight_kg"]  # what no rule fills


def bad_qty() -> Column:
    return F.col("qty").isNull() | (F.col("qty") <= 0)


def bad_unit() -> Column:
    return F.col("unit").isNull() | ~F.col("unit").isin(R.UNITS)


def isolate(raw: DataFrame) -> DataFrame:
    """All rows with filled columns, numbers for the measures, and isolation_reason: the first rule hit, null for clean rows.
    _keyword and _odd are for reclassify: the category of the first keyword rule, for rows without a category, and a name of codes.

    Rows are written once. Repeats of either kind are equal in what no rule fills, so only rows that share that with another row are
    compared; rows that lack nothing and share it with none are never shuffled.
    """
    rows = require_columns(raw).select(*_typed(), _hash(RAW_COLUMNS, F.lit(1)).alias("_k2"))
    keys = [_hash(SAME).alias("_k1"), _hash(SAME, F.lit(2)).alias("_k3")]  # the measures' texts are in these; numbers are read often
    rows = cut_lineage(rows.select(*[T.number(F.col(c)).alias(c) if c in MEASURES else c for c in rows.columns], *keys))
    several = cut_lineage(rows.groupBy("_k1").agg(F.count("*").alias("n")).where("n > 1").select("_k1"))
    items, by_name = _modes(rows)
    rows = may_meet(rows, several, "_k1")
    few = _filled(rows.where("_may").drop("_may").join(several, "_k1", "left_semi"), items, by_name)
    few = mark_repeats(cut_lineage(few.select("row_id", F.struct("_k1", "_k2").alias("_raw"), *[_hash(["name_filled", "category_filled"], F.col(k)).alias(to) for k, to in (("_k1", "_k1"), ("_k3", "_k2"))])), "norm_dup")
    few = mark_repeats(cut_lineage(few.select("row_id", "_raw", "norm_dup", "_raw.*")), "raw_dup")
    few = cut_lineage(few.where("raw_dup or norm_dup").select("row_id", "_raw.*", "raw_dup", "norm_dup").distinct())
    alone = _whole() & ~F.col("_may")
    no = F.lit(False)
    met = _filled(rows.where(~alone), items, by_name).join(few, ["row_id", "_k1", "_k2"], "left")
    # only rows that lacked something may be without a category: the long list of rules isn't there for the others
    word = F.when(F.col("category_filled").isNull(), T.keyword_category(F.col("name_filled")))
    met = met.withColumns({c: F.coalesce(c, no) for c in ("raw_dup", "norm_dup")} | {"_keyword": word})
    df = _as_it_is(rows.where(alone)).withColumns({"raw_dup": no, "norm_dup": no, "_keyword": F.lit(None).cast("int")}).unionByName(met)
    df = df.drop("_k1", "_k2", "_k3", "_may").withColumn("_odd", T.nondescriptive(F.col("name_filled")))
    reason = (
        F.when(~F.coalesce(F.col("ship_no").rlike(R.SHIP_NO), F.lit(False)), "bad_ship_no")
        .when(F.col("raw_dup"), "duplicate").when(F.col("item_id").isNull(), "no_item").when(F.col("name_filled").isNull(), "no_name")
        .when(F.col("category_filled").isNull(), "no_category").when(bad_qty(), "bad_qty").when(bad_unit(), "bad_unit")
        .when(F.col("norm_dup"), "normalized_duplicate").when(F.col("category_filled").isin(R.TEST_CATEGORIES), "test_category")
    )
    return df.withColumn("isolation_reason", reason)


def reclassify(isolated: DataFrame) -> DataFrame:
    """Rows without category get one by keyword and leave isolation unless quantity or unit is bad; then names of codes only are isolated."""
    word = F.col("_keyword") if "_keyword" in isolated.columns else T.keyword_category(F.col("name_filled"))
    df = isolated.withColumn("keyword", F.when(F.col("isolation_reason") == "no_category", word)).drop("_keyword")
    hit = F.coalesce(F.col("keyword") >= 0, F.lit(False))
    df = df.withColumn("category_final", F.when(hit, F.col("keyword")).otherwise(F.col("category_filled")))
    df = df.withColumn("isolation_reason", F.when(hit, F.when(bad_qty(), "bad_qty").when(bad_unit(), "bad_unit")).otherwise(F.col("isolation_reason")))
    odd = F.col("isolation_reason").isNull() & (F.col("_odd") if "_odd" in isolated.columns else T.nondescriptive(F.col("name_filled")))
    return df.withColumn("isolation_reason", F.when(odd, "nondescriptive_name").otherwise(F.col("isolation_reason"))).drop("_odd")


def reclass_stats(isolated: DataFrame) -> DataFrame:
    """One row about the rows without category: how many, moved back, test data, hit but still bad, and hit by no rule."""
    rows = isolated.where("isolation_reason = 'no_category'").withColumn("k", T.keyword_category(F.col("name_filled")))
    hit, bad = F.col("k") >= 0, bad_qty() | bad_unit()
    return rows.agg(
        F.count("*").alias("target_total"), F.count_if(hit & ~bad).alias("moved"), F.count_if(F.col("k") < 0).alias("test_placeholder"),
        F.count_if(hit & bad).alias("still_bad"), F.count_if(F.col("k").isNull()).alias("still_unmatched"),
    )


def changes() -> list[Column]:
    """(column, rule, before, after) of a filled or repaired name and category, null where nothing changed."""
    def changed(column: str, rule: str, before: Column, after: Column) -> Column:
        return F.when(~before.eqNullSafe(after), F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"), before.cast("string").alias("before"), after.cast("string").alias("after")))

    return [
        changed("item_name", "item mode", F.col("item_name"), F.col("name_filled")),
        changed("category_id", "item or name mode", F.col("category_id"), F.col("category_filled")),
        changed("category_id", "keyword", F.col("category_filled"), F.col("category_final")),
    ]


def change_log(cleaned: DataFrame) -> DataFrame:
    """row_id, column, rule, before, after for every filled or repaired name and category."""
    return cleaned.select("row_id", F.inline(F.filter(F.array(*changes()), lambda x: x.isNotNull())))


def reconciliation(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count("*").alias("n_rows"), F.count_if(F.col("isolation_reason").isNull()).alias("n_clean"), F.count_if(F.col("isolation_reason").isNotNull()).alias("n_isolated"))
