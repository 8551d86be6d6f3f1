"""Mixing sources to target weights: complete epochs first, then an Efraimidis-Spirakis weighted sample.

Sizes are words. Targets: sources in code point order (null last) weigh 3, 1, 2 repeating and share `budget` times
all words; a target stops at `max_epochs` times its source's words and the excess is reshared by weight until none
is above. A source's words are taken floor(target / source) times over, and the rest is drawn without replacement:
each document has the key -ln(u) / w (u from a hash of its id, w its quality weight), keys ascend, and a prefix sum
of words is cut at the rest. The document at the cut gives only the words that are missing.

Nothing is sorted whole. Keys are counted in cells of ln(key): under any mixture of weights a cell of width d holds
at most d / e of a source's rows in expectation, as the logarithm of an exponential variate has a density of 1 / e at
most. The cell in which a source's cut falls is cut into finer cells, and those once more, so that the last step orders
only the distinct (key, id, size) of a few rows for each source. The result is one cut for each source; every row
compares itself with its source's cut, and no row but the source's few at the cut is shuffled. Reruns agree: the hash
decides.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated ids
with equal text get equal keys, and where they stand at the cut they share its words equally (a rest of fewer words
than there are copies is left); rows of equal key and different size are ordered by size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotspark.llm.common import materialize, n_words, release, table

WEIGHTS = (3, 1, 2)
SEED = "mix-1"
#: Cells for each unit of ln(key), and cells that a cell is cut into each time.
CELLS = 64
FINER = 1024


def targets(sizes: list[tuple], budget: float, weights=WEIGHTS, max_epochs: int = 2) -> list[float]:
    """Water filling over sources in order: [(name, words)] -> targets. One entry for each source."""
    total = sum(s for _, s in sizes) * budget
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap = [float(max_epochs * s) for _, s in sizes]
    full: set[int] = set()
    while True:
        left = total - sum(cap[i] for i in sorted(full))
        live = sum(w[i] for i in range(len(w)) if i not in full)
        share = [cap[i] if i in full else left * w[i] / live for i in range(len(w))]
        over = {i for i in range(len(w)) if i not in full and share[i] > cap[i]}
        if not over:
            return share
        full |= over
        if len(full) == len(w):
            return cap


def with_keys(docs: DataFrame) -> DataFrame:
    """size: words; weight: quality weight in (0, 1], the share of words without symbol characters, smoothed; key: -ln(u) / weight."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bad = F.regexp_count(text, F.lit(r"[#*$%&|<>]+"))
    docs = docs.withColumn("size", n_words(F.col("text")))
    weight = F.greatest(F.lit(0.05), (1.0 + F.col("size") - F.least(F.col("size"), bad)) / (1.0 + F.col("size")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.withColumn("weight", weight).withColumn("key", F.greatest(F.lit(1e-9), F.round(-F.log(u) / F.col("weight"), 9)))


def _first_over(cells: DataFrame, rest: DataFrame, value: str) -> DataFrame:
    """cells (source_, value, words) -> per source the first value at which the running words pass rest, and the words before it."""
    upto = Window.partitionBy("source_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(rest, "source_")
    last = run.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    return last.select("source_", value, (F.col("rest") - F.col("before")).alias("rest"))


def cuts(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(source_, cut, each): per source the first (key, doc_id, size) that the prefix sum cuts, and the words each row of it gives.

    rows: source_, key, doc_id, size, read several times; rest: source_, rest (words to draw). A source with less than
    rest has no row here: all of it is taken.
    """
    log_cell = lambda n: F.floor(F.log("key") * n).cast("long")
    n, left = CELLS, rest
    inside = rows.where("size > 0")
    for k in range(3):
        cell = inside.groupBy("source_", log_cell(n).alias("cell")).agg(F.sum("size").alias("words"))
        left = materialize(_first_over(cell, left, "cell"))
        inside = inside.join(left.select("source_", "cell"), "source_").where(log_cell(n) == F.col("cell")).drop("cell")
        left, n = left.select("source_", "rest"), n * FINER
    at = F.struct("key", "doc_id", "size").alias("cut")
    ties = inside.groupBy("source_", at).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = Window.partitionBy("source_").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    run = ties.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(left, "source_")
    over = run.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    return over.select("source_", "cut", F.floor((F.col("rest") - F.col("before")) / F.col("n")).cast("long").alias("each"))


def _placed(per: DataFrame) -> DataFrame:
    """per with place: the rank of each source in code point order, null last, from range partitions and their sizes."""
    order = F.col("source").asc_nulls_last()
    dealt = materialize(per.repartitionByRange(order).withColumn("part_", F.spark_partition_id()))
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offset = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(order))
    return dealt.join(offset, "part_").withColumn("place", F.col("offset_") + inside - 1).drop("part_", "offset_")


def source_targets(rows: DataFrame, budget: float, weights, max_epochs: int) -> DataFrame:
    """One row for each source: source_, source_size, target, epochs, rest; `targets` over a table. rows: source_, source, size."""
    per = _placed(rows.groupBy("source_", "source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = materialize(per.select("source_", "source_size", w.alias("w"), (F.col("source_size") * max_epochs).alias("cap")))
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * budget
    full, before = F.lit(False), -1
    while True:
        r = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("cap"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if r.n == before or not r.w:
            break
        before, share = r.n, F.lit(float(total - r.cap)) * F.col("w") / F.lit(r.w)
        full = full | (share > F.col("cap"))
    target = F.when(full, F.col("cap").cast("double")).otherwise(share) if before >= 0 else F.col("cap").cast("double")
    epochs = F.coalesce(F.least(F.lit(max_epochs), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))), F.lit(0)).cast("long")
    plan = per.withColumn("target", target).withColumn("epochs", epochs)
    return plan.select("source_", "source_size", "target", "epochs", F.bround(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("rest"))


def mixed(docs: DataFrame, budget: float = 1.5, weights=WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """row_ (each row of docs as a struct), size, source_size, target, taken."""
    base = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", F.col("source").cast("string").alias("source"), "text")
    # an exact name for each source that is never null
    keyed = with_keys(base).withColumn("source_", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = materialize(keyed.select("source_", "source", "key", "doc_id", "size"))
    plan = materialize(source_targets(rows, budget, weights, max_epochs))
    plan = materialize(plan.join(cuts(rows.drop("source"), plan.select("source_", "rest")), "source_", "left"))
    release(rows)
    out = keyed.join(plan, "source_", "left")
    own = F.struct("key", "doc_id", "size")
    part = F.when(F.col("cut").isNull() | (own < F.col("cut")), F.col("size")).when(own == F.col("cut"), F.col("each")).otherwise(F.lit(0))
    part = F.when(F.col("rest") > 0, part).otherwise(F.lit(0))
    return out.select("row_", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, budget: float = 1.5, weights=WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """The rows of docs (doc_id, source, text and others; columns of the names made here are replaced) with size, source_size, target and taken."""
    made = ("size", "source_size", "target", "taken")
    return mixed(docs, budget, weights, max_epochs).select(*[F.col("row_")[c].alias(c) for c in docs.columns if c not in made], *made)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
