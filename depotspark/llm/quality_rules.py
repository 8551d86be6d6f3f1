"""Quality rules: plain floors first, then robust outliers by minimum covariance determinant per language and source.

Every text gives a vector of transformed statistics (log words, log mean word length, symbol, repeated-line and
repeated-word shares). For each (lang, source), and for all rows together, a minimum covariance determinant estimate is
taken over the rows that pass the floors: three starts (median and median deviations alone; with the spatial sign
covariance; with the covariance of hyperbolic tangents), two concentration steps from each, then the start with the
smallest determinant goes on until a step no longer lowers its determinant. A concentration step takes mean and
covariance of the share `h` of rows with the smallest distances. The estimate of a group of m chosen rows is then mixed
with that of all rows as if it held `prior` more rows like those: weights m / (m + prior) and prior / (m + prior), a
smooth function of the group's size. A row is rejected where its squared Mahalanobis distance, scaled for consistency,
exceeds `cut`. Only DataFrame functions run, no Python. Quantiles come from counts of fixed-width bins and sums are over
fixed-point integers, so that reruns and other partitionings agree.

Ties fall into one bin and are taken or left together.

Defined cases: a null text has no words and fails the floors; null lang or source form groups of their own; repeated
rows count as often as they occur; an empty table gives no rows; other columns stay, except those of the names made here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotspark.llm.common import SPACES, materialize, release, table, tidy

SYMBOLS = "#*$%&|<>"
FIXED = 1000  # fixed-point unit of the statistics
DIMS = ("f1", "f2", "f3", "f4", "f5")
#: Smallest standard deviation taken for each dimension: shares that are nearly always 0 would else reject any other value.
FLOORS = (0.25, 0.06, 0.05, 0.05, 0.12)
#: Largest squared distance kept: the 0.9999 quantile of a chi-square law with five degrees. On labels of sf0.1 (3,243
#: good, 291 bad texts above the floors) it rejects 41 good and all bad ones; 0.999 rejects 50 good, 0.99 59 good.
CUT = 25.745
#: Rows of all groups that are mixed into the estimate of each.
PRIOR = 100
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def consistency(h: float) -> float:
    """What the covariance of the share h of nearest rows is short by under a normal law: h / F7(q), q the h quantile of F5 (chi-square laws)."""
    f5 = lambda x: math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    lo, hi = 0.0, 200.0
    for _ in range(100):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if f5(q) < h else (lo, q)
    return h / (f5(q) - math.sqrt(2 / math.pi) * q**2.5 * math.exp(-q / 2) / 15)


def _let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Sorting (hash, position) brings equal windows together."""
    n = F.size(words)

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"], F.bitwise_not(x["h"])) == x["h"]) | (F.coalesce(F.get(s, k + 1)["h"], F.bitwise_not(x["h"])) == x["h"]))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(F.sort_array(windows), marked), covered)

    return F.when(n >= 4, _let(words, of)).otherwise(F.lit(0)).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("_words")))
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_words")


def vector(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    fixed = lambda c: F.round(c * FIXED).cast("long")
    return (
        df.withColumn("f1", fixed(F.log1p(F.col("n_words").cast("double"))))
        .withColumn("f2", fixed(F.log1p(F.col("word_chars") / n)))
        .withColumn("f3", fixed(F.log1p(10.0 * F.col("n_symbols") / n)))
        .withColumn("f4", fixed(F.log1p(2.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))))
        .withColumn("f5", fixed(F.log1p(2.0 * F.col("n_repeat_words") / n)))
    )


def with_group(df: DataFrame) -> DataFrame:
    """grp: the exact text of (lang, source); the empty text stands for all rows."""
    return df.withColumn("grp", F.to_json(F.struct("lang", "source")))


def _lower(name) -> list:
    return [name(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _small(df: DataFrame) -> DataFrame:
    """Writes a table of a few rows for each group to a few files, so that its size, not its footers, decides how it is joined."""
    return materialize(df.coalesce(8))


def _moments(rows: DataFrame, ys: tuple[str, ...]) -> DataFrame:
    """(grp, start): rows m, sums s_i and sums of products p_ij of the fixed-point columns ys."""
    aggs = [F.count("*").alias("m")] + [F.sum(x).alias(f"s_{i}") for i, x in enumerate(ys)]
    return rows.groupBy("grp", "start").agg(*aggs, *_lower(lambda i, j: F.sum(F.col(ys[i]) * F.col(ys[j])).alias(f"p_{i}{j}")))


def _covariance(mom: DataFrame) -> DataFrame:
    """(grp, start, m) with means c_i and covariances v_ij."""
    m = F.col("m").cast("double") * FIXED
    mean = [F.col(f"s_{i}") / m for i in range(len(DIMS))]
    return mom.select("grp", "start", "m", *[c.alias(f"c_{i}") for i, c in enumerate(mean)], *_lower(lambda i, j: (F.col(f"p_{i}{j}") / m / FIXED - mean[i] * mean[j]).alias(f"v_{i}{j}")))


def _factor(est: DataFrame) -> DataFrame:
    """est (grp, start, m, c_i, v_ij) with the lower Cholesky factor l_ij of the covariance, floors added on its diagonal, and logdet."""
    names = est.columns
    for i in range(len(DIMS)):
        row = []
        for j in range(i + 1):
            v = F.col(f"v_{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - row[k] * (F.col(f"l_{j}{k}") if j < i else row[k])
            row.append(F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}{j}"))
        # one projection for each row of the factor: the next one reads its columns
        est = est.select("*", *[x.alias(f"l_{i}{j}") for j, x in enumerate(row)])
    logdet = sum((F.log(F.col(f"l_{i}{i}")) for i in range(len(DIMS))), F.lit(0.0)) * 2
    return est.select(*names, *_lower(lambda i, j: f"l_{i}{j}"), logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    ys: list[Column] = []
    for i, x in enumerate(DIMS):
        y = F.col(x) / FIXED - F.col(f"c_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}{k}") * ys[k]
        ys.append(y / F.col(f"l_{i}{i}"))
    out = F.lit(0.0)
    for y in ys:
        out = out + y * y
    return out


def _quantile(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per key the smallest value q at which the running share of the counts _c reaches `share`."""
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_run", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(Window.partitionBy(*keys))).where(F.col("_run") >= F.col("_all") * share).groupBy(*keys).agg(F.min(value).alias("q"))


def _centres(good: DataFrame) -> DataFrame:
    """(grp, mid_i, s_i): medians and median deviations with floors, for each group and for all rows (grp '')."""
    width = FIXED // 50
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) / width).cast("long").alias("b")) for i, x in enumerate(DIMS)])).alias("x")
    counts = good.select("grp", pairs).select("grp", "x.*").groupBy("grp", "dim", "b").agg(F.count("*").alias("_c"))
    every = F.explode(F.array("grp", F.lit(""))).alias("grp")
    counts = materialize(counts.select(every, "dim", "b", "_c").groupBy("grp", "dim", "b").agg(F.sum("_c").alias("_c")))
    med = _quantile(counts, ["grp", "dim"], "b", 0.5)
    dev = counts.join(med, ["grp", "dim"]).withColumn("e", F.abs(F.col("b") - F.col("q")))
    mad = _quantile(dev.groupBy("grp", "dim", "e", F.col("q").alias("mid")).agg(F.sum("_c").alias("_c")), ["grp", "dim", "mid"], "e", 0.5)
    one = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    out = mad.groupBy("grp").agg(
        *[one(i, (F.col("mid") + 0.5) * width / FIXED).alias(f"mid_{i}") for i in range(len(DIMS))],
        *[one(i, F.sqrt(F.pow(F.col("q") * width / FIXED * 1.4826, 2) + FLOORS[i] ** 2)).alias(f"s_{i}") for i in range(len(DIMS))],
    )
    out = _small(out)
    release(counts)
    return out


def _starts(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Three estimates for each group: median deviations alone (0), with spatial signs (1), with hyperbolic tangents (2)."""
    d = len(DIMS)
    z = rows.join(centres, "grp").select("grp", *[((F.col(x) / FIXED - F.col(f"mid_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, x in enumerate(DIMS)])
    z = z.withColumn("norm", F.greatest(F.lit(1e-9), F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(d)), F.lit(0.0)))))
    fixed = lambda c, i: F.round(c * FIXED).cast("long").alias(f"y_{i}")
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("start"), *[fixed(F.col(f"z_{i}") / F.col("norm"), i) for i in range(d)]), F.struct(F.lit(2).alias("start"), *[fixed(F.tanh(f"z_{i}"), i) for i in range(d)]))).alias("y")
    mom = _moments(z.select("grp", kinds).select("grp", "y.*"), tuple(f"y_{i}" for i in range(d)))
    m = F.col("m").cast("double") * FIXED * FIXED
    # second moments about the median; unit vectors have 1 / d of the variance in each direction
    second = F.when(F.col("start") == 1, F.lit(float(d))).otherwise(F.lit(1.0)) / m
    scaled = mom.drop(*[f"s_{i}" for i in range(d)]).join(centres, "grp")
    centre = [F.col(f"mid_{i}").alias(f"c_{i}") for i in range(d)]
    spread = scaled.select("grp", "start", "m", *centre, *_lower(lambda i, j: (F.col(f"p_{i}{j}") * second * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"v_{i}{j}")))
    alone = centres.select("grp", F.lit(0).alias("start"), F.lit(0).cast("long").alias("m"), *centre, *_lower(lambda i, j: (F.col(f"s_{i}") * F.col(f"s_{i}") if i == j else F.lit(0.0)).alias(f"v_{i}{j}")))
    return _small(_factor(alone.unionByName(spread)))


def _concentrated(rows: DataFrame, est: DataFrame, h: float) -> DataFrame:
    """One concentration step for each row of est (grp, start). Distances are counted in bins of about 3 % width; the table of
    limits is written first, so that rows meet it without a shuffle."""
    near = rows.join(est, "grp").select("grp", "start", *DIMS, F.round(F.log1p(_distance()) * 32).cast("int").alias("_b"))
    limit = _small(_quantile(near.groupBy("grp", "start", "_b").agg(F.count("*").alias("_c")), ["grp", "start"], "_b", h))
    out = _small(_factor(_covariance(_moments(near.join(limit, ["grp", "start"]).where(F.col("_b") <= F.col("q")), DIMS))))
    release(limit)
    return out


def estimates(good: DataFrame, h: float, starts: int = 2, least: float = 1e-3) -> DataFrame:
    """(grp, m, c_i, v_ij, logdet): for each group of good (grp and DIMS) and for all rows (grp ''), the estimate of the smallest determinant.

    starts: steps from each start; least: what a further step must take off the log determinant to count.
    """
    rows = good.select(F.explode(F.array("grp", F.lit(""))).alias("grp"), *DIMS)
    centres = _centres(good)
    est = _starts(rows, centres)
    for _ in range(starts):
        last, est = est, _concentrated(rows, est, h)
        release(last)
    columns = est.columns
    best = est.groupBy("grp").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("e")).select("e.*")
    best = _small(best.withColumn("open", F.lit(True)))
    release(centres, est)
    # groups that a step no longer improves are left out of the next; a determinant can't fall for ever
    while not best.where("open").isEmpty():
        step = _concentrated(rows, best.where("open").drop("open"), h)
        both = best.select("grp", F.struct(*columns).alias("old")).join(step.select("grp", F.struct(*columns).alias("new")), "grp", "left")
        better = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - least, F.lit(False))
        last, best = best, _small(both.select(F.when(better, F.col("new")).otherwise(F.col("old")).alias("e"), better.alias("open")).select("e.*", "open"))
        release(last, step)
    return best


def quality_rules(docs: DataFrame, h: float = 0.75, prior: int = PRIOR, cut: float = CUT, scale: float | None = None) -> DataFrame:
    """The rows of docs (lang, source, text) with the base counts, base_failed, distance and kept.

    h: share of rows in the subset; prior: rows of all groups mixed into each estimate; cut: largest squared distance kept;
    scale: what the subset's covariance is short by (None: `consistency(h)`).
    """
    made = {*BASE, *DIMS, "n_lines", "distance", "kept", "grp"}
    stats = vector(with_statistics(docs.select(*[c for c in docs.columns if c not in made]))).drop("n_lines")
    return judge(materialize(with_group(stats)), h, prior, cut, consistency(h) if scale is None else scale)


def judge(stats: DataFrame, h: float, prior: int, cut: float, scale: float) -> DataFrame:
    """stats: rows with grp, the base columns and DIMS; a table that can be read again and again."""
    d = len(DIMS)
    est = estimates(stats.where(~F.col("base_failed")).select("grp", *DIMS), h)
    tidy(stats.sparkSession)
    # groups none of whose rows passes the floors have no estimate and need none
    every = est.where("grp = ''").select(*[F.col(f"c_{i}").alias(f"a_{i}") for i in range(d)], *_lower(lambda i, j: F.col(f"v_{i}{j}").alias(f"w_{i}{j}")))
    own = est.where("grp != ''").join(F.broadcast(every))  # one row
    a, b = F.col("m") / (F.col("m") + prior), prior / (F.col("m") + prior)
    shift = [F.col(f"c_{i}") - F.col(f"a_{i}") for i in range(d)]
    mixed = _lower(lambda i, j: (a * F.col(f"v_{i}{j}") + b * F.col(f"w_{i}{j}") + a * b * shift[i] * shift[j]).alias(f"v_{i}{j}"))
    final = _small(_factor(own.select("grp", F.lit(0).alias("start"), "m", *[(a * F.col(f"c_{i}") + b * F.col(f"a_{i}")).alias(f"c_{i}") for i in range(d)], *mixed)).select("grp", *[f"c_{i}" for i in range(d)], *_lower(lambda i, j: f"l_{i}{j}")))
    release(est)
    out = stats.join(final, "grp", "left").withColumn("distance", F.round(_distance() / scale, 6))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return out.withColumn("kept", kept).drop("grp", *DIMS, *final.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = with_group(vector(with_statistics(docs))).drop("text", "n_lines", "lang", "source")
    out = judge(materialize(stats), 0.75, PRIOR, CUT, consistency(0.75))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
