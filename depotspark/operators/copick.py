"""Items and categories picked together: count, support, lift.

An order of k keys holds k (k - 1) / 2 pairs. Two things keep that bounded. A pair can't be counted more often than its rarer
key, so keys below the least count leave before orders meet themselves. An order of at most BLOCK keys is one array, which makes
its pairs by itself. One with more keys left is dealt as a triangle of blocks: its keys fall into blocks of about BLOCK by hash,
and each pair of blocks is a group of its own in a join, so that no task makes more than about BLOCK * BLOCK rows of one order at
a time; they are counted on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotspark import reference_values as R
from depotspark.operators.errors import one_of, within
from depotspark.operators.graph import cut_lineage

#: Keys of one order that meet each other in one group of the join.
BLOCK = 500


def order_keys(sales: DataFrame, key: str) -> DataFrame:
    return sales.where(F.col(key).isNotNull() & F.col("ship_no").isNotNull()).select("ship_no", F.col(key).alias("k")).distinct()


def _least(min_count: int | None, n: Column) -> Column:
    """The least count of a pair, by default from the number of orders."""
    return F.lit(min_count) if min_count else F.when(n < R.PAIR_COUNTS[0][0], R.PAIR_COUNTS[0][1]).when(n < R.PAIR_COUNTS[1][0], R.PAIR_COUNTS[1][1]).otherwise(R.PAIR_COUNTS[2][1])


def frequencies(keys: DataFrame, min_count: int | None = None) -> DataFrame:
    """keys (ship_no, k) -> k, f (orders that hold it), n (all orders), least (count that a pair needs)."""
    n = keys.select("ship_no").distinct().agg(F.count("*").alias("n"))
    return keys.groupBy("k").agg(F.count("*").alias("f")).crossJoin(F.broadcast(n)).withColumn("least", _least(min_count, F.col("n")))  # one row


def _blocks(keys: DataFrame, block: int) -> DataFrame:
    """keys (ship_no, k, ...) with nb, the number of blocks of the order, and blk, the key's block."""
    sizes = keys.groupBy("ship_no").agg(F.count("*").alias("s"))
    large = sizes.where(F.col("s") > block).select("ship_no", F.ceil(F.col("s") / block).cast("int").alias("nb"))
    out = keys.join(large, "ship_no", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    return out.withColumn("blk", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))


def pair_rows(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """keys (ship_no, k) -> one row a, b for each order that holds both, a < b: see the head of the module. keys is a table that can be
    read twice."""
    sizes = keys.groupBy("ship_no").agg(F.count("*").alias("s"))
    large = cut_lineage(sizes.where(F.col("s") > block).select("ship_no"))
    held = keys.join(large, "ship_no", "left_anti").groupBy("ship_no").agg(F.sort_array(F.collect_list("k")).alias("ks"))  # at most block keys
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    after = lambda i: F.slice("ks", i + 2, F.size("ks"))
    small = held.where(F.size("ks") > 1).select(F.inline(F.flatten(F.transform("ks", lambda x, i: F.transform(after(i), lambda y: pair(x, y))))))
    if large.isEmpty():
        return small
    return small.unionByName(_large_rows(keys.join(large, "ship_no", "left_semi"), block))


def _large_rows(keys: DataFrame, block: int) -> DataFrame:
    """The same for orders that are dealt into blocks."""
    dealt = cut_lineage(_blocks(keys, block))  # read for both sides
    left = dealt.select("ship_no", F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("nb") - 1)).alias("j"), F.col("k").alias("x"))
    right = dealt.select("ship_no", F.explode(F.sequence(F.lit(0), "blk")).alias("i"), F.col("blk").alias("j"), F.col("k").alias("y"))
    met = left.join(right, ["ship_no", "i", "j"]).where("i < j or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pairs(sales: DataFrame, key: str = "item_id", min_count: int | None = None, block: int = BLOCK, keys: DataFrame | None = None) -> DataFrame:
    """a < b in the same order: count, support (percent of orders), lift; count from min_count on (default by the number of orders).
    keys: order_keys of the sales, if they are written already."""
    keys = cut_lineage(order_keys(sales, key)) if keys is None else keys  # read for the orders, the frequencies and the pairs
    freq = cut_lineage(frequencies(keys, min_count))
    # where no key is rare, the keys are not written again
    often = keys if freq.where("f < least").isEmpty() else cut_lineage(keys.join(freq.where("f >= least").select("k"), "k", "left_semi"))
    both = pair_rows(often, block).groupBy("a", "b").agg(F.count("*").alias("count"))  # as narrow as can be: one row for each pair is shuffled
    both = both.crossJoin(F.broadcast(freq.limit(1).select("n", "least"))).where("count >= least")  # one row
    of = lambda c: freq.select(F.col("k").alias(c), F.col("f").alias(f"f{c}"))  # noqa: E731  only pairs that count ask for the frequencies
    both = both.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "count", (F.col("count") * 100.0 / F.col("n")).alias("support"), (F.col("count") * F.col("n") / (F.col("fa") * F.col("fb"))).alias("lift"))


def pairs_of(sales: DataFrame, one: int, key: str = "item_id", min_count: int | None = None) -> DataFrame:
    """Those rows of pairs() that hold one key: only the orders of that key are looked at for pairs."""
    keys = cut_lineage(order_keys(sales, key))  # read for the orders, the frequencies and the pairs
    freq = cut_lineage(frequencies(keys, min_count))
    own = freq.where(F.col("k") == one).select(F.col("f").alias("f1"))  # one row
    mine = cut_lineage(keys.where(F.col("k") == one).select("ship_no"))
    both = keys.where(F.col("k") != one).join(mine, "ship_no", "left_semi").groupBy("k").agg(F.count("*").alias("count"))
    both = both.join(freq, "k").crossJoin(F.broadcast(own)).where("count >= least and f >= least and f1 >= least")
    lift = F.col("count") * F.col("n") / (F.col("f") * F.col("f1"))
    return both.select(F.least("k", F.lit(one)).alias("a"), F.greatest("k", F.lit(one)).alias("b"), "count", (F.col("count") * 100.0 / F.col("n")).alias("support"), lift.alias("lift"))


def pair_work(sales: DataFrame, key: str = "item_id", min_count: int | None = None) -> DataFrame:
    """One row about the work of pairs(): orders, keys and those often enough, rows before counting with and without them, the largest order."""
    keys = cut_lineage(order_keys(sales, key))
    freq = cut_lineage(frequencies(keys, min_count))
    often = keys.join(freq.where("f >= least").select("k", F.lit(1).alias("often")), "k", "left")
    per = often.groupBy("ship_no").agg(F.count("*").alias("s"), F.count("often").alias("t"))
    rows = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0)).cast("long")
    work = per.agg(F.count("*").alias("orders"), rows("s").alias("rows_all"), rows("t").alias("rows_made"), F.coalesce(F.max("s"), F.lit(0)).alias("largest_order"))
    return work.crossJoin(F.broadcast(freq.agg(F.count("*").alias("keys"), F.count_if(F.col("f") >= F.col("least")).alias("often"))))  # one row each


def category_matrix(sales: DataFrame, cap: int = R.MATRIX_CAP) -> DataFrame:
    """a, b, count, lift over the categories that most orders hold; the diagonal is left out."""
    rows = sales.where("category_id is not null and ship_no is not null")
    orders = cut_lineage(rows.groupBy("ship_no").agg(F.sort_array(F.collect_set("category_id")).alias("ks")).groupBy("ks").agg(F.count("*").alias("m")))  # how many orders hold each set
    n = orders.agg(F.sum("m").alias("n"))
    top = cut_lineage(orders.select(F.explode("ks").alias("k"), "m").groupBy("k").agg(F.sum("m").alias("f")).orderBy(F.desc("f"), "k").limit(cap))
    every = lambda c: F.explode("ks").alias(c)
    held = orders.crossJoin(F.broadcast(top.agg(F.collect_list("k").alias("top")))).select(F.array_intersect("ks", "top").alias("ks"), "m")  # at most cap of each order
    both = held.select("ks", "m", every("a")).select("a", "m", every("b")).where("a <> b").groupBy("a", "b").agg(F.sum("m").alias("count"))
    side = lambda c: F.broadcast(top.select(F.col("k").alias(c), F.col("f").alias(f"f{c}")))  # noqa: E731  at most cap rows
    both = both.join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(n))
    return both.select("a", "b", "count", (F.col("count") * F.col("n") / (F.col("fa") * F.col("fb"))).alias("lift"))


def top_pairs(p: DataFrame, by: str = "lift", limit: int = 50) -> DataFrame:
    """A report: the first pairs by count or lift."""
    one_of("by", by, ("count", "lift"))
    within("limit", limit, 1, 500)
    return p.orderBy(F.desc(by), "a", "b").limit(limit)


def partners(p: DataFrame, item: int, limit: int = 10) -> DataFrame:
    """A report: the partners of one item by lift."""
    mine = p.where((F.col("a") == item) | (F.col("b") == item))
    return mine.select(F.when(F.col("a") == item, F.col("b")).otherwise(F.col("a")).alias("partner"), "count", "lift").orderBy(F.desc("lift"), "partner").limit(limit)
