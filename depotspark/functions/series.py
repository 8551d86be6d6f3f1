"""Forecast models as expressions over array<double> columns; h is the history, s a series, te the end of training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from depotspark import reference_values as R


def _zero_if_empty(h: Column, value: Column) -> Column:
    return F.when(F.size(h) > 0, value).otherwise(F.lit(0.0))


def nearest(x: Column, places: int) -> Column:
    """x as the nearest whole number of 10^-places, decided on the double itself; Spark's round decides on its shortest decimal text
    (22.90995, which is a little less as a double, becomes 22.9100 there and 22.9099 here, as in the SQL)."""
    return F.round(x * 10.0**places) / 10.0**places


def naive(h: Column) -> Column:
    return _zero_if_empty(h, F.get(h, F.size(h) - 1))


def seasonal_naive(h: Column, season: int = R.SEASON) -> Column:
    return _zero_if_empty(h, F.when(F.size(h) >= season, F.get(h, F.size(h) - season)).otherwise(F.get(h, F.size(h) - 1)))


def ma3(h: Column) -> Column:
    k = F.least(F.lit(3), F.size(h))
    last = F.slice(h, F.greatest(F.lit(1), F.size(h) - 2), F.lit(3))
    return _zero_if_empty(h, F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / k)


def ses(h: Column, alpha: float = R.SES_ALPHA) -> Column:
    return _zero_if_empty(h, F.aggregate(F.slice(h, 2, F.greatest(F.lit(1), F.size(h))), F.get(h, F.lit(0)), lambda a, x: F.lit(alpha) * x + F.lit(1 - alpha) * a))


def holt_state(h: Column, alpha: float = R.HOLT_ALPHA, beta: float = R.HOLT_BETA) -> Column:
    """struct(level, trend) after the history; needs two values."""
    start = F.struct(F.get(h, F.lit(0)).alias("level"), (F.get(h, F.lit(1)) - F.get(h, F.lit(0))).alias("trend"))

    def step(a: Column, x: Column) -> Column:
        level = F.lit(alpha) * x + F.lit(1 - alpha) * (a["level"] + a["trend"])
        return F.struct(level.alias("level"), (F.lit(beta) * (level - a["level"]) + F.lit(1 - beta) * a["trend"]).alias("trend"))

    return F.aggregate(F.slice(h, 2, F.greatest(F.lit(1), F.size(h))), start, step)


def holt(h: Column, steps: Column | int = 1) -> Column:
    state = holt_state(h)
    return F.when(F.size(h) == 0, 0.0).when(F.size(h) == 1, F.get(h, F.lit(0))).otherwise(F.greatest(F.lit(0.0), state["level"] + F.lit(steps) * state["trend"]))


def croston(h: Column, alpha: float = R.CROSTON_ALPHA) -> Column:
    """Size over interval, both smoothed over the non-zero periods; 0 without any."""
    hits = F.filter(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["v"] > 0)
    first = F.get(hits, F.lit(0))
    start = F.struct(first["v"].alias("z"), (first["i"] + 1).cast("double").alias("x"), first["i"].alias("last"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((F.lit(alpha) * x["v"] + F.lit(1 - alpha) * a["z"]).alias("z"), (F.lit(alpha) * (x["i"] - a["last"]) + F.lit(1 - alpha) * a["x"]).alias("x"), x["i"].alias("last"))

    end = F.aggregate(F.slice(hits, 2, F.greatest(F.lit(1), F.size(hits))), start, step)
    return F.when(F.size(hits) == 0, 0.0).otherwise(F.when(end["x"] > 0, end["z"] / end["x"]).otherwise(0.0))


ONE_STEP = [naive, seasonal_naive, ma3, ses, holt, croston]


def mean_abs_diff(h: Column) -> Column:
    n = F.size(h)
    steps = F.transform(F.slice(h, 2, F.greatest(F.lit(1), n)), lambda v, i: F.abs(v - F.get(h, i)))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - 1))


def _walk_start(s: Column) -> Column:
    zero, none = F.lit(0.0), F.lit(0)
    return F.struct(
        none.alias("t"), zero.alias("ses"), zero.alias("level"), zero.alias("trend"), zero.alias("z"), zero.alias("x"), F.lit(-1).alias("hit"), zero.alias("diff"), *[zero.alias(f"e{k}") for k in range(len(ONE_STEP))]
    )


def _next(s: Column, a: Column, steps: int = 1) -> list[Column]:
    """What each model says `steps` periods after the a.t values walked so far, from its state alone (s is read at single places). a.t is at least 1."""
    t = a["t"]
    back = lambda k: F.get(s, t - k)
    place = t + (steps - 1) - R.SEASON
    seasonal = F.when(place >= 0, F.get(s, place)).otherwise(back(1))
    mean = F.when(t >= 3, (F.lit(0.0) + back(3) + back(2) + back(1)) / 3).when(t == 2, (F.lit(0.0) + back(2) + back(1)) / 2).otherwise(back(1))
    line = F.when(t == 1, back(1)).otherwise(F.greatest(F.lit(0.0), a["level"] + F.lit(steps) * a["trend"]))
    return [back(1), seasonal, mean, a["ses"], line, F.when(a["hit"] < 0, 0.0).when(a["x"] > 0, a["z"] / a["x"]).otherwise(0.0)]


def walk(s: Column, te: Column) -> Column:
    """struct: the states of all models after the first te values of s, and what was met on the way: `diff`, the sum of absolute
    differences, and e0.. , the sums of the models' one-step errors over the last periods of training. One pass over the series.
    """
    start = F.greatest(F.lit(3), te - R.LOOK_BACK)

    def step(a: Column, v: Column) -> Column:
        t, last = a["t"], F.get(s, a["t"] - 1)
        asked = t >= start
        errors = [F.when(asked, a[f"e{k}"] + F.abs(v - p)).otherwise(a[f"e{k}"]).alias(f"e{k}") for k, p in enumerate(_next(s, a))]
        ses = F.when(t == 0, v).otherwise(F.lit(R.SES_ALPHA) * v + F.lit(1 - R.SES_ALPHA) * a["ses"])
        # from two values on; the first difference is the trend with which the second value is met
        level0 = F.when(t == 1, last).otherwise(a["level"])
        trend0 = F.when(t == 1, v - last).otherwise(a["trend"])
        level = F.when(t == 0, v).otherwise(F.lit(R.HOLT_ALPHA) * v + F.lit(1 - R.HOLT_ALPHA) * (level0 + trend0))
        trend = F.when(t == 0, 0.0).otherwise(F.lit(R.HOLT_BETA) * (level - level0) + F.lit(1 - R.HOLT_BETA) * trend0)
        hit, first = v > 0, a["hit"] < 0
        z = F.when(~hit, a["z"]).when(first, v).otherwise(F.lit(R.CROSTON_ALPHA) * v + F.lit(1 - R.CROSTON_ALPHA) * a["z"])
        x = F.when(~hit, a["x"]).when(first, (t + 1).cast("double")).otherwise(F.lit(R.CROSTON_ALPHA) * (t - a["hit"]) + F.lit(1 - R.CROSTON_ALPHA) * a["x"])
        diff = F.when(t == 0, 0.0).otherwise(a["diff"] + F.abs(v - last))
        return F.struct((t + 1).alias("t"), ses.alias("ses"), level.alias("level"), trend.alias("trend"), z.alias("z"), x.alias("x"), F.when(hit, t).otherwise(a["hit"]).alias("hit"), diff.alias("diff"), *errors)

    return F.aggregate(F.slice(s, F.lit(1), F.greatest(te, F.lit(0))), _walk_start(s), step)


def walked(s: Column, te: Column) -> Column:
    """What walk returns, for a whole Arrow batch of series at once: the same operations in the same order, period by period."""
    season, look_back, a_ses, a_holt, b_holt, a_croston = R.SEASON, R.LOOK_BACK, R.SES_ALPHA, R.HOLT_ALPHA, R.HOLT_BETA, R.CROSTON_ALPHA
    names = ["ses", "level", "trend", "z", "x", "diff", *[f"e{k}" for k in range(len(ONE_STEP))]]

    def of(m: np.ndarray, te: int) -> dict[str, np.ndarray]:
        a = {c: np.zeros(m.shape[0]) for c in names} | {"hit": np.full(m.shape[0], -1, dtype=np.int32)}
        start, te = max(3, te - look_back), min(max(te, 0), m.shape[1])
        for t in range(te):
            v, last = m[:, t], m[:, t - 1]
            hit, first = v > 0, a["hit"] < 0
            if t >= start:
                mean = (0.0 + m[:, t - 3] + m[:, t - 2] + m[:, t - 1]) / 3
                rate = np.where(~first & (a["x"] > 0), a["z"] / np.where(a["x"] > 0, a["x"], 1.0), 0.0)
                told = [last, m[:, t - season] if t >= season else last, mean, a["ses"], np.maximum(0.0, a["level"] + a["trend"]), rate]
                a |= {f"e{k}": a[f"e{k}"] + np.abs(v - p) for k, p in enumerate(told)}
            level0, trend0 = (last, v - last) if t == 1 else (a["level"], a["trend"])
            level = a_holt * v + (1 - a_holt) * (level0 + trend0) if t else v
            a["trend"] = b_holt * (level - level0) + (1 - b_holt) * trend0 if t else a["trend"]
            a["level"], a["ses"] = level, a_ses * v + (1 - a_ses) * a["ses"] if t else v
            a["z"] = np.where(hit, np.where(first, v, a_croston * v + (1 - a_croston) * a["z"]), a["z"])
            a["x"] = np.where(hit, np.where(first, t + 1.0, a_croston * (t - a["hit"]) + (1 - a_croston) * a["x"]), a["x"])
            a["hit"] = np.where(hit, np.int32(t), a["hit"])
            a["diff"] = a["diff"] + np.abs(v - last) if t else a["diff"]
        return a | {"t": np.full(m.shape[0], te, dtype=np.int32)}

    @F.pandas_udf("t int, hit int, " + ", ".join(f"{c} double" for c in names))
    def batch(s: pd.Series, te: pd.Series) -> pd.DataFrame:
        shape = pd.DataFrame({"n": s.map(len).to_numpy(), "te": te.to_numpy()})
        out = [pd.DataFrame(of(np.stack(s.to_numpy()[at]), int(end)), index=at) for (_, end), at in shape.groupby(["n", "te"]).indices.items()]
        columns = ["t", "hit", *names]
        return pd.concat(out).sort_index()[columns] if out else pd.DataFrame(columns=columns)

    return batch(s, te)


def denominator(w: Column) -> Column:
    """Mean absolute difference of the walked values; 0 for fewer than two."""
    return F.when(w["t"] < 2, 0.0).otherwise(w["diff"] / (w["t"] - 1))


def select_model(w: Column, te: Column) -> Column:
    """struct(mase, rank) from a walk: the model with the least walk-forward error over the last periods of training; ties to the earlier."""
    n, denom = te - F.greatest(F.lit(3), te - R.LOOK_BACK), denominator(w)

    def error(k: int) -> Column:
        mae = w[f"e{k}"] / n
        return F.when(n <= 0, F.lit(float("inf"))).otherwise(F.when(denom > 0, mae / denom).otherwise(mae))

    return F.array_min(F.array(*[F.struct(error(k).alias("mase"), F.lit(k).alias("rank")) for k in range(len(ONE_STEP))]))


def multi_step(s: Column, w: Column, rank: Column, horizon: int) -> Column:
    """array of predictions 1..horizon after a walk with the model of that rank, not below 0; 0 after no values."""
    at = lambda k: F.when(w["t"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.get(F.array(*_next(s, w, k)), rank)))
    return F.array(*[at(k) for k in range(1, horizon + 1)])
