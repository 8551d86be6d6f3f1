"""What a session keeps, background work, pairs of large orders, versions of busy stores, one-pass selection, errors."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF
from depotspark import reference_values as R
from depotspark.functions import series as S
from depotspark.operators import abc, addresses, cleaning, copick, forecast, graph
from depotspark.operators.cache import Cache
from depotspark.operators.errors import NotFound, NotReady, RequestError, TooFewPeriods
from depotspark.operators.jobs import Jobs
from depotspark.sources.star import raw_lines, sales


def tables(spark):
    folder = f"{graph.shared_dir(spark)}/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


# ---- results of a session


def test_a_step_runs_once_and_leaves_its_result_only(spark):
    cache, before = Cache(spark), tables(spark)
    first = cache.get(cleaning.isolate, raw_lines(spark, SF), holder="a")
    again = cache.get(cleaning.isolate, raw_lines(spark, SF), holder="b")
    assert first is again and cache.made == {"depotspark.operators.cleaning.isolate": 1}
    assert first.count() == raw_lines(spark, SF).count() and len(tables(spark) - before) == 1
    cache.get(cleaning.isolate, raw_lines(spark, SF).where("qty = '7'"), holder="c")
    assert cache.made["depotspark.operators.cleaning.isolate"] == 2
    cache.give_back("a")
    assert len(tables(spark) - before) == 2
    cache.give_back("b")
    assert len(tables(spark) - before) == 1
    cache.close()
    assert tables(spark) == before and not cache.entries


def doubled(df, by):
    return df.select((F.col("id") * by).alias("id"))


def test_a_changed_file_drops_the_result(spark, tmp_path):
    cache, path = Cache(spark), str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    assert cache.get(doubled, read(), params=(2,)).count() == 5
    assert cache.get(doubled, read(), params=(3,)).agg(F.sum("id")).first()[0] == 30
    assert cache.get(doubled, read(), params=(2,)).count() == 5 and cache.made[f"{__name__}.doubled"] == 2
    time.sleep(0.01)
    spark.range(9).write.mode("overwrite").parquet(path)
    assert cache.get(doubled, read(), params=(2,)).count() == 9 and cache.made[f"{__name__}.doubled"] == 3
    cache.close()


# ---- background work


def test_jobs(spark):
    jobs, before = Jobs(spark), tables(spark)
    with pytest.raises(NotFound):
        jobs.get("export")
    job = jobs.start("export", lambda: graph.cut_lineage(spark.range(1000)).count())
    assert job.wait(60).status == "ready" and job.result() == 1000 and jobs.get("export") is job
    assert 0 < job.progress()["done"] <= job.progress()["known"] and tables(spark) == before
    bad = jobs.start("export", lambda: 1 // 0).wait(60)
    assert bad is not job and bad.status == "error"
    with pytest.raises(ZeroDivisionError):
        bad.result()

    def slow():
        graph.cut_lineage(spark.range(10))
        return spark.range(0, 10**13, 1, 4).where("hash(id) = 1 and hash(id, 1) = 2").count()

    job = jobs.start("slow", slow)
    assert jobs.start("slow", slow) is job and job.status == "processing"
    with pytest.raises(NotReady):
        job.result()
    time.sleep(2)
    job.cancel()
    assert job.status == "cancelled" and tables(spark) == before
    assert spark.range(10).count() == 10


# ---- pairs


def brute_pairs(orders, least):
    count = {}
    for items in orders.values():
        items = sorted(items)
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                count[a, b] = count.get((a, b), 0) + 1
    return {k: n for k, n in count.items() if n >= least}


@pytest.mark.parametrize("block", [4, 500])
def test_pairs_in_blocks(spark, block):
    r = random.Random(3)
    orders = {f"o{i}": set(r.sample(range(40), r.choice([1, 2, 3, 5, 30]))) for i in range(60)}
    df = spark.createDataFrame([(o, k) for o, items in orders.items() for k in items for _ in range(2)], "ship_no string, item_id long")
    got = {(x.a, x.b): x["count"] for x in copick.pairs(df, "item_id", 3, block).collect()}
    assert got == brute_pairs(orders, 3)
    f = {k: sum(k in s for s in orders.values()) for k in range(40)}
    x = copick.pairs(df, "item_id", 3, block).where("a = 1").first()
    assert abs(x.lift - x["count"] * 60 / (f[1] * f[x.b])) < 1e-9 and abs(x.support - x["count"] * 100 / 60) < 1e-9


def test_an_order_of_many_items(spark):
    """20,000 items that no other order holds leave before the join; of 3,000 that two orders share every block is small."""
    rare = spark.range(20000).select(F.lit("big").alias("ship_no"), (F.col("id") + 10**6).alias("item_id"))
    both = spark.range(3000).select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("ship_no"), F.col("id").alias("item_id"))
    df = graph.cut_lineage(rare.unionByName(both))
    work = copick.pair_work(df, "item_id", 2).first()
    assert (work.rows_all, work.rows_made, work.largest_order) == (19999 * 10000 + 2 * 2999 * 1500, 2 * 2999 * 1500, 20000)
    assert copick.pairs(df, "item_id", 2).where("count = 2").count() == 2999 * 1500
    sizes = copick._blocks(df.withColumnRenamed("item_id", "k"), copick.BLOCK).groupBy("ship_no", "blk").count().agg(F.max("count")).first()[0]
    assert sizes < 1.5 * copick.BLOCK


# ---- versions of addresses


def brute_nearest(day, versions):
    gap = lambda v: 1 << 30 if v[3] is None else 0 if v[3] <= day <= v[4] else min(abs(day - v[3]), abs(day - v[4]))
    return min(versions, key=lambda v: (gap(v), v[:3]))[:3]


def test_nearest_versions(spark):
    r = random.Random(4)
    versions, asks = [], []
    for s in range(30):
        for _ in range(r.choice([1, 2, 8, 40])):
            lo = r.randrange(-50, 400)
            dated = r.random() < 0.9
            versions.append((f"s{s}", r.choice("ab"), r.choice("cd"), str(r.randrange(30)), lo if dated else None, lo + r.choice([0, 0, 3, 100]) if dated else None))
        asks += [(f"s{s}", d) for d in r.sample(range(-80, 560), 25)]
    asks.append(("nobody", 5))
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    v = spark.createDataFrame(versions, "store_code string, city string, district string, rest string, lo int, hi int").withColumn("lo", date("lo")).withColumn("hi", date("hi"))
    a = spark.createDataFrame(asks, "store_code string, d int").select("store_code", date("d").alias("day"))
    got = {(x.store_code, x.d): tuple(x.best) if x.best else None for x in addresses.nearest_versions(a, v).withColumn("d", F.datediff("day", F.lit("1970-01-01").cast("date"))).collect()}
    for s, d in asks:
        mine = [(c, t, x, lo, hi) for k, c, t, x, lo, hi in versions if k == s]
        assert got.get((s, d)) == (brute_nearest(d, mine) if mine else None), (s, d)


def test_a_store_of_many_versions(spark):
    """100,000 versions of one store and each day asked for: no version meets every day."""
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c.cast("int"))
    i = F.col("id")
    v = spark.range(100_000).select(F.lit("s").alias("store_code"), F.lit("a").alias("city"), F.lit("b").alias("district"), F.lpad(i.cast("string"), 6, "0").alias("rest"), day(i % 3000).alias("lo"), day(i % 3000 + i % 7).alias("hi"))
    a = spark.range(3500).select(F.lit("s").alias("store_code"), day(i).alias("day"))
    start = time.time()
    got = {x.n: x.best.rest for x in addresses.nearest_versions(a, v).withColumn("n", F.datediff("day", F.lit("2000-01-01").cast("date"))).collect()}
    assert time.time() - start < 60 and len(got) == 3500
    first = {}
    for k in range(100_000):
        for d in range(k % 3000, k % 3000 + k % 7 + 1):
            first.setdefault(d, f"{k:06d}")
    last = max(first)
    assert all(got[d] == first[d] for d in first) and got[3499] == first[last]


# ---- series


def test_one_pass_equals_the_models_from_each_origin(spark):
    r = random.Random(5)
    data = [(i, [float(r.choice([0, 0, 3, 8, r.randrange(50)])) for _ in range(r.randrange(0, 40))]) for i in range(80)] + [(100, [0.0] * 20), (101, [5.0] * 20)]
    df = spark.createDataFrame(data, "key long, s array<double>").withColumn("te", F.greatest(F.size("s") - 3, F.lit(0)))
    walked = df.withColumn("w", S.walk(F.col("s"), F.col("te"))).withColumn("best", S.select_model(F.col("w"), F.col("te")))
    pred = [S.multi_step(F.col("s"), F.col("w"), F.lit(k), 3).alias(f"p{k}") for k in range(6)]
    history = F.slice("s", F.lit(1), F.col("te"))
    whole = [F.greatest(F.lit(0.0), f(history)).alias(f"q{k}") for k, f in enumerate(S.ONE_STEP)]
    for x in walked.select("key", "s", "te", "best", S.denominator(F.col("w")).alias("denom"), S.mean_abs_diff(history).alias("denom0"), *pred, *whole).collect():
        assert abs(x.denom - x.denom0) < 1e-9
        if x.te > 0:
            assert all(abs(x[f"p{k}"][0] - x[f"q{k}"]) < 1e-9 for k in range(6)), x.key
    # errors from each origin, model by model
    origins = df.where("te > 3").select("key", "s", "te", F.explode(F.sequence(F.greatest(F.lit(3), F.col("te") - R.LOOK_BACK), F.col("te") - 1)).alias("t"))
    past = F.slice("s", F.lit(1), F.col("t"))
    errors = origins.select("key", *[F.abs(F.get("s", F.col("t")) - f(past)).alias(f"e{k}") for k, f in enumerate(S.ONE_STEP)]).groupBy("key").agg(*[F.avg(f"e{k}").alias(f"e{k}") for k in range(6)])
    both = walked.join(errors, "key").select("best", S.denominator(F.col("w")).alias("denom"), *[f"e{k}" for k in range(6)]).collect()
    for x in both:
        scaled = [x[f"e{k}"] / (x.denom or 1.0) for k in range(6)]
        assert abs(x.best.mase - min(scaled)) < 1e-9 and abs(scaled[x.best.rank] - min(scaled)) < 1e-9
    assert len(both) > 50


def test_walk_of_a_batch_equals_the_walk_of_each(spark):
    """Series of all lengths, bit by bit."""
    r = random.Random(6)
    data = [(i, [float(r.choice([0, 0, 3, 8, r.random() * 50])) for _ in range(r.randrange(0, 40))]) for i in range(120)] + [(200, [0.0] * 30), (201, [])]
    df = spark.createDataFrame(data, "key long, s array<double>").withColumn("te", F.size("s") - 3)
    both = df.withColumn("a", S.walk(F.col("s"), F.col("te"))).withColumn("b", S.walked(F.col("s"), F.col("te"))).collect()
    assert len(both) == 122
    for x in both:
        assert x.a.asDict() == x.b.asDict(), x.key


def test_errors_of_requests(spark):
    s = sales(spark, SF)
    with pytest.raises(NotFound) as e:
        forecast.series(s, item=-5)
    assert e.value.status == 404
    with pytest.raises(TooFewPeriods):
        forecast.series(s.where("ship_date < date'1992-03-15'"))
    for bad in (lambda: forecast.series(s, horizon=9), lambda: forecast.series(s, target="x"), lambda: abc.classes(s, "qty", "item_id", 95, 80), lambda: copick.top_pairs(s, "x")):
        with pytest.raises(RequestError):
            bad()


def test_fixed_tables():
    assert len(dict(R.TOWNSHIPS)) == len(R.TOWNSHIPS) and len({t for t, _, _ in R.OLD_TOWNSHIPS}) == len(R.OLD_TOWNSHIPS)
    assert ("三民鄉", "高雄市", "那瑪夏區") in R.OLD_TOWNSHIPS and ("琉球鄉", "屏東縣") in R.TOWNSHIPS


def test_orders_make_their_pairs_from_one_shuffle_and_one_key_only_from_its_orders(spark):
    rows = [(f"O{i % 40}", (i * 13) % 17, (i * 13) % 17 % 5) for i in range(300)] + [("O1", None, None), (None, 3, 3)]
    sales = spark.createDataFrame(rows, "ship_no string, item_id long, category_id int")
    keys = copick.order_keys(sales, "item_id").withColumn("f", F.lit(1))
    # no order meets itself in a join of all rows
    assert "ship_no#" in keys._jdf.queryExecution().executedPlan().toString() and " Inner" not in copick.pair_rows(keys)._jdf.queryExecution().optimizedPlan().toString()
    every = copick.pairs(sales, "item_id", 2)
    for one in (0, 3, 16, 99):
        got, want = (sorted(map(tuple, x.select("a", "b", "count", "support", "lift").collect())) for x in (copick.pairs_of(sales, one, "item_id", 2), every.where((F.col("a") == one) | (F.col("b") == one))))
        assert got == want and bool(got) == (one != 99)
    held = {}
    for o, _, c in rows:
        if o is not None and c is not None:
            held.setdefault(o, set()).add(c)
    want = {(a, b): sum({a, b} <= s for s in held.values()) for a in range(5) for b in range(5) if a != b}
    assert {(r.a, r.b): r["count"] for r in copick.category_matrix(sales).collect()} == {p: n for p, n in want.items() if n}
