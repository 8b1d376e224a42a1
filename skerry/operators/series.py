"""Series in order of time: smoothing, forecasting, grids, gaps, scaling. keys name an entity's columns, order those that sort it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import contracts


def window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, out: str = "smoothed") -> DataFrame:
    """Trailing mean of `size` values, of fewer at the start."""
    contracts.whole(size, 1, name="size")
    return df.withColumn(out, F.avg(value).over(window(keys, order).rowsBetween(-(size - 1), 0)))


def weighted_moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, out: str = "smoothed") -> DataFrame:
    """Trailing mean with weights size for the newest value down to 1; at the start the weights that have a value count."""
    contracts.whole(size, 1, name="size")
    w = window(keys, order)
    rn = F.row_number().over(w)
    top = sum((F.coalesce(F.lag(value, j).over(w), F.lit(0.0)) * (size - j) for j in range(size)), F.lit(0.0))
    bottom = sum((F.when(rn > j, size - j).otherwise(0) for j in range(size)), F.lit(0))
    return df.withColumn(out, top / bottom)


def ewma_last(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "smoothed") -> DataFrame:
    """Last value of s = alpha * s + (1 - alpha) * x, s starting at the first x: alpha weighs the past. A sum of values with weights by their place from the end, so no entity lies in one array."""
    contracts.number(alpha, 0, 1, name="alpha")
    n = F.row_number().over(window(keys, order))
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"), n.alias("_n"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_c"))
    own = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.lit(1.0 - alpha)) * F.pow(F.lit(float(alpha)), F.col("_c") - F.col("_n"))
    return rows.groupBy(*keys).agg(F.sum(F.col("_x") * own).alias(out))


#: Levels of blocks above the rows' own: entities of up to BLOCK ** (LEVELS + 2) rows have no array longer than BLOCK.
LEVELS = 2


def _carried(ends: DataFrame, keys: list[str], factor: float, block: int, levels: int = LEVELS) -> DataFrame:
    """ends (keys, _b from 0, _end) of s = factor * s + _end to keys, _b and _in, s before the block. Blocks of blocks are folded on their own and carry their ends on in the same way."""
    up = ends.withColumn("_u", F.floor(F.col("_b") / block) if levels else F.lit(0).cast("long")).groupBy(*keys, "_u").agg(F.sort_array(F.collect_list(F.struct("_b", "_end"))).alias("_e"))
    scan = F.aggregate("_e", F.array().cast("array<double>"), lambda acc, e: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) * factor + e["_end"])))
    up = up.withColumn("_s", scan)
    if levels:
        more = _carried(up.select(*keys, F.col("_u").alias("_b"), F.element_at("_s", -1).alias("_end")), keys, factor**block, block, levels - 1)
        up = up.join(more.select(*keys, F.col("_b").alias("_u"), "_in"), [*keys, "_u"], "left").withColumn("_in", F.coalesce("_in", F.lit(0.0)))
    else:
        up = up.withColumn("_in", F.lit(0.0))
    full = F.transform("_s", lambda s, i: F.struct((F.get("_e", i)["_b"] + 1).alias("_b"), (s + F.col("_in") * F.pow(F.lit(factor), i + 1)).alias("_in")))
    return up.select(*keys, F.inline(full))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "smoothed", block: int = 128) -> DataFrame:
    """All values of the same recursion. It is linear, so blocks of rows are folded on their own and the blocks' ends carried on by blocks of blocks: no entity is held in one array."""
    contracts.number(alpha, 0, 1, name="alpha")
    n = F.row_number().over(window(keys, order)) - 1
    row = F.struct(F.col("_n"), F.struct(*df.columns).alias("r"), F.col(value).cast("double").alias("x"))
    blocks = df.withColumn("_n", n).withColumn("_b", F.floor(F.col("_n") / block)).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    # within a block from 0, but the first row of all counts in full
    own = lambda x: F.when(x["_n"] == 0, x["x"]).otherwise(x["x"] * (1 - alpha))
    scan = F.aggregate("_rows", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) * alpha + own(x))))
    blocks = blocks.withColumn("_s", scan)
    carried = _carried(blocks.select(*keys, "_b", F.element_at("_s", -1).alias("_end")), keys, float(alpha) ** block, block)
    both = blocks.join(carried, [*keys, "_b"], "left").withColumn("_in", F.coalesce("_in", F.lit(0.0)))
    full = both.select(F.explode(F.arrays_zip("_rows", F.transform("_s", lambda s, i: s + F.col("_in") * F.pow(F.lit(float(alpha)), i + 1)).alias("_v"))).alias("_z"))
    return full.select(F.col("_z")["_rows"]["r"].alias("_r"), F.col("_z")["_v"].alias(out)).select("_r.*", out)


def estimate_next(xs: Column) -> Column:
    """Next value of an array by the mean slope to its last value: x[1] plus the sum of slopes."""
    n = F.size(xs)
    slopes = F.transform(F.slice(xs, F.lit(1), n - 1), lambda x, i: (F.element_at(xs, -1) - x) / (n - 1 - i))
    return F.get(xs, F.lit(1)) + F.aggregate(slopes, F.lit(0.0), lambda a, s: a + s)


def extend(df: DataFrame, column: str, count: int, look_ahead: int = 5) -> DataFrame:
    """Appends `count` estimates to an array column, each from the last look_ahead values."""
    contracts.whole(count, 0, name="count")
    contracts.whole(look_ahead, 2, name="look_ahead")
    step = lambda a, _: F.concat(a, F.array(estimate_next(F.slice(a, F.greatest(F.size(a) - look_ahead, F.lit(0)) + 1, F.lit(look_ahead)))))
    return df.withColumn(column, F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.col(column), step)) if count else df


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], at: Column, interval: float, out: str = "session") -> DataFrame:
    """Number of the part from 0; a new one starts where the step from the last position is more than the interval."""
    w = window(keys, order)
    return df.withColumn("_at", at).withColumn("_new", F.when(F.col("_at") - F.lag("_at").over(w) > interval, 1).otherwise(0)).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_new")


def grid(df: DataFrame, keys: list[str], tick: str, step: int, start: int | None = None) -> DataFrame:
    """keys and tick: start (the least tick) and on by step up to the greatest tick, for each entity."""
    contracts.whole(step, 1, name="step")
    ends = df.groupBy(*keys).agg((F.lit(start).cast("long") if start is not None else F.min(tick)).alias("_a"), F.max(tick).alias("_z"))
    ends = ends.withColumn("_z", F.when(F.col("_a") > F.col("_z"), F.raise_error(F.lit("start lies behind the last sample"))).otherwise(F.col("_z")))
    return ends.select(*keys, F.explode(F.sequence("_a", "_z", F.lit(step).cast("long"))).alias(tick))


def regrid(df: DataFrame, keys: list[str], tick: str, values: list[str], step: int, start: int | None = None) -> DataFrame:
    """The grid with the samples that lie on it; others go, grid points without a sample are null."""
    return grid(df, keys, tick, step, start).join(df.select(*keys, tick, *values), [*keys, tick], "left")


def tumble(df: DataFrame, keys: list[str], tick: str, value: str, step: int, how: str = "sum", start: int | None = None, out: str = "value") -> DataFrame:
    """Sum or mean of the bins [g, g + step) of a dense grid; an empty bin's sum is 0, its mean null. Samples before start go."""
    contracts.option(how, ("sum", "mean"), "how")
    a = F.lit(start).cast("long") if start is not None else F.col("_first")
    firsts = df.groupBy(*keys).agg(F.min(tick).alias("_first"))
    binned = df.join(firsts, keys).filter(F.col(tick) >= a).withColumn(tick, a + F.floor((F.col(tick) - a) / step) * step)
    got = binned.groupBy(*keys, tick).agg((F.sum(value) if how == "sum" else F.avg(value)).alias(out))
    full = grid(df, keys, tick, step, start).join(got, [*keys, tick], "left")
    return full.withColumn(out, F.coalesce(out, F.lit(0.0))) if how == "sum" else full


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs by Euclid's steps; 93 are enough for any longs."""
    start = F.struct(a.alias("x"), b.alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))), lambda s: s["x"])


def auto_step(df: DataFrame, keys: list[str], tick: Column, eps: int = 0) -> DataFrame:
    """Greatest common divisor of all steps from the first tick, over 10^eps; 0 for a single sample. Steps are made distinct before they are gathered."""
    t = df.select(*keys, (tick * 10**eps).cast("long").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_t")
    steps = t.distinct().withColumn("_d", F.col("_t") - F.lag("_t").over(w)).filter("_d is not null").select(*keys, "_d").distinct()
    folded = steps.groupBy(*keys).agg(F.collect_list("_d").alias("_ds")).withColumn("_g", F.aggregate("_ds", F.lit(0).cast("long"), gcd))
    return t.select(*keys).distinct().join(folded, keys, "left").select(*keys, (F.coalesce("_g", F.lit(0)) / float(10**eps)).alias("step"))


KINDS = ("linear", "slinear", "previous", "zero", "next", "nearest", "nearest-up", "quadratic", "cubic")


def interpolate(df: DataFrame, keys: list[str], tick: str, value: str, kind: str = "linear", out: str = "filled") -> DataFrame:
    """Fills nulls from the known samples around. linear goes on beyond the ends along the first and last known pair; previous has no value before the
    first and next none after the last, zero takes the first known there; nearest takes the earlier of two at one distance, nearest-up the later."""
    contracts.option(kind, KINDS, "kind")
    if kind in ("quadratic", "cubic"):
        return _spline(df, keys, tick, value, 3 if kind == "cubic" else 2, out)
    w = Window.partitionBy(*keys).orderBy(tick)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(tick).alias("t"), F.col(value).cast("double").alias("v")))
    p, q = F.last(known, True).over(back), F.first(known, True).over(ahead)
    d = df.withColumn("_p", p).withColumn("_q", q)
    P, Q, t = F.col("_p"), F.col("_q"), F.col(tick)
    if kind in ("previous", "zero"):
        d = d.withColumn(out, F.coalesce(P["v"], Q["v"]) if kind == "zero" else P["v"])
    elif kind == "next":
        d = d.withColumn(out, Q["v"])
    elif kind in ("nearest", "nearest-up"):
        early = (t - P["t"] <= Q["t"] - t) if kind == "nearest" else (t - P["t"] < Q["t"] - t)
        d = d.withColumn(out, F.when(Q.isNull() | (P.isNotNull() & early), P["v"]).otherwise(Q["v"]))
    else:
        # the two known samples before and the two behind, for the ends
        before = F.when(F.col(value).isNotNull(), F.lag("_p").over(w))
        behind = F.when(F.col(value).isNotNull(), F.lead("_q").over(w))
        d = d.withColumn("_k", before).withColumn("_l", behind).withColumn("_pp", F.last("_k", True).over(back)).withColumn("_qq", F.first("_l", True).over(ahead))
        line = lambda a, b: a["v"] + (b["v"] - a["v"]) * ((t - a["t"]) / (b["t"] - a["t"]))
        d = d.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(P.isNotNull() & Q.isNotNull(), line(P, Q)).when(P.isNull(), F.coalesce(line(Q, F.col("_qq")), Q["v"])).otherwise(F.coalesce(line(F.col("_pp"), P), P["v"])))
        d = d.drop("_k", "_l", "_pp", "_qq")
    return d.drop("_p", "_q")


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating spline of degree 2 or 3 (not-a-knot ends) at given places; polynomial through all points if there are too few."""
    n = len(x)
    if n == 0:
        return np.full(len(at), np.nan)
    if n <= degree:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    if degree == 3:
        h, s = np.diff(x), np.diff(y) / np.diff(x)
        lower, main, upper, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        a = np.zeros((n, n)) if n <= 4 else None
        if a is not None:
            return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
        # second derivatives m: rows 1..n-2 of a tridiagonal system, m[0] and m[n-1] eliminated by the not-a-knot ends
        lower[1:-1], main[1:-1], upper[1:-1], right[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * (s[1:] - s[:-1])
        main[1] += h[0] + h[0] ** 2 / h[1]
        upper[1] -= h[0] ** 2 / h[1]
        main[-2] += h[-1] + h[-1] ** 2 / h[-2]
        lower[-2] -= h[-1] ** 2 / h[-2]
        c, d = np.zeros(n), np.zeros(n)
        c[1], d[1] = upper[1] / main[1], right[1] / main[1]
        for i in range(2, n - 1):
            f = main[i] - lower[i] * c[i - 1]
            c[i], d[i] = upper[i] / f, (right[i] - lower[i] * d[i - 1]) / f
        m = np.zeros(n)
        m[n - 2] = d[n - 2]
        for i in range(n - 3, 0, -1):
            m[i] = d[i] - c[i] * m[i + 1]
        m[0] = m[1] - h[0] / h[1] * (m[2] - m[1])
        m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
        k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        u, v = x[k + 1] - at, at - x[k]
        return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
    # degree 2: knots midway between samples, all but the two nearest the ends
    knots = (x[:-1] + x[1:])[1:-1] / 2
    t = np.concatenate([[x[0]] * 3, knots, [x[-1]] * 3])
    return _basis(t, at, 2) @ np.linalg.solve(_basis(t, x, 2), y)


def _basis(t: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """B-spline values by the recursion of Cox and de Boor; the end pieces go on beyond the ends."""
    n = len(t) - k - 1
    piece = np.clip(np.searchsorted(t, at, side="right") - 1, k, n - 1)
    out = np.zeros((len(at), n))
    for r, (x, i) in enumerate(zip(at, piece, strict=True)):
        b = np.zeros(k + 1)
        b[0] = 1.0
        for d in range(1, k + 1):
            old = b.copy()
            b[:] = 0
            for j in range(d):
                left, right = t[i - d + 1 + j], t[i + 1 + j]
                w = 0.0 if right == left else old[j] / (right - left)
                b[j] += w * (right - x)
                b[j + 1] += w * (x - left)
        out[r, i - k : i + 1] = b
    return out


def per_entity(df: DataFrame, keys: list[str], order: list[str], value: str, kernel: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """A sequential kernel over each entity's values in order; it returns as many. Only for kernels that need a whole series at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        pdf[out] = kernel(pdf[value].to_numpy(float))
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)


def _spline(df: DataFrame, keys: list[str], tick: str, value: str, degree: int, out: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"

    def run(pdf):
        pdf = pdf.sort_values(tick)
        t, v = pdf[tick].to_numpy(float), pd.to_numeric(pdf[value]).to_numpy(float)
        ok = ~np.isnan(v)
        pdf[out] = spline_values(t[ok], v[ok], t, degree)
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)


def autocorrelations(df: DataFrame, keys: list[str], order: list[str], value: str, lags: tuple[int, ...]) -> DataFrame:
    """keys and, for each lag k, acf{k}: the sum of products of deviations k rows apart over the sum of squared ones."""
    w, all_ = window(keys, order), Window.partitionBy(*keys)
    c = df.withColumn("_m", F.col(value) - F.avg(value).over(all_))
    c = c.withColumns({f"_l{k}": F.lag("_m", contracts.whole(k, 0, name="lag")).over(w) for k in lags})
    g = c.groupBy(*keys).agg(F.sum(F.col("_m") * F.col("_m")).alias("_s"), *[F.sum(F.col("_m") * F.coalesce(f"_l{k}", F.lit(0.0))).alias(f"_s{k}") for k in lags])
    return g.select(*keys, *[(F.col(f"_s{k}") / F.col("_s")).alias(f"acf{k}") for k in lags])


def rows_between(df: DataFrame, keys: list[str], order: list[str], start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop of each entity, numbered from 0 in order."""
    contracts.whole(step, 1, name="step")
    n = F.row_number().over(window(keys, order)) - 1
    return df.withColumn("_n", n).filter((F.col("_n") >= start) & (F.col("_n") < stop) & ((F.col("_n") - start) % step == 0)).drop("_n")


def standardize(df: DataFrame, keys: list[str], tick: str, value: str, step: int, out: str = "filled") -> DataFrame:
    """Regrid by a step, then cubic interpolation; the step is often that of auto_step."""
    return interpolate(regrid(df, keys, tick, [value], step), keys, tick, value, "cubic", out)


def minmax(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(x - min) / (max - min) over each entity; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    scaled = {v: F.when(F.max(v).over(w) == F.min(v).over(w), F.lit(0.0)).otherwise((F.col(v) - F.min(v).over(w)) / (F.max(v).over(w) - F.min(v).over(w))) for v in values}
    return df.withColumns(scaled)


def normalize_rows(df: DataFrame, values: list[str]) -> DataFrame:
    """Each row's attributes over their Euclidean norm; a row of zeros stays."""
    norm = F.sqrt(sum((F.col(v) * F.col(v) for v in values), F.lit(0.0)))
    return df.withColumns({v: F.when(norm == 0, F.col(v).cast("double")).otherwise(F.col(v) / norm) for v in values})


def local_extrema(df: DataFrame, keys: list[str], order: list[str], value: str, how: str = "min", out: str = "extreme") -> DataFrame:
    """Whether a value is not above (min) or not below (max) both neighbours; an end compares with itself."""
    contracts.option(how, ("min", "max"), "how")
    w = window(keys, order)
    a, b, x = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value)), F.col(value)
    return df.withColumn(out, (x <= a) & (x <= b) if how == "min" else (x >= a) & (x >= b))


def spectral_residual(x: np.ndarray, size: int, extend_by: int = 0, look_ahead: int = 5) -> np.ndarray:
    """Saliency: the amplitude spectrum's logarithm less its moving average, back to time."""
    n, ext = len(x), list(map(float, x))
    for _ in range(extend_by):
        tail = ext[-look_ahead:]
        if len(tail) < 2:
            break
        m = len(tail)
        ext.append(tail[1] + sum((tail[-1] - tail[i]) / (m - 1 - i) for i in range(m - 1)))
    spec = np.fft.fft(ext)
    amp = np.abs(spec)
    low = amp <= 1e-8
    safe = np.where(low, 1e-8, amp)
    log = np.where(low, 0.0, np.log(safe))
    w = min(size, len(log))
    c = np.cumsum(np.insert(log, 0, 0.0))
    i = np.arange(1, len(log) + 1)
    mean = (c[i] - c[np.maximum(i - w, 0)]) / np.minimum(i, w)
    scaled = np.where(low, 0, spec * (np.exp(log - mean) / safe))
    return np.abs(np.fft.ifft(scaled))[:n]


def holt_winters(x: np.ndarray, alpha: float, beta: float | None = None, gamma: float | None = None, period: int = 0, level: float | None = None, trend: float | None = None) -> np.ndarray:
    """Additive exponential smoothing with fixed parameters; element i is the forecast of i + 1."""
    n = len(x)
    if not n:
        return np.empty(0)
    lev, tr = x[0] if level is None else level, (x[1] - x[0] if n > 1 else 0.0) if trend is None and beta is not None else trend or 0.0
    season = list(x[:period] - np.mean(x[:period])) if gamma is not None and period and n >= period else []
    out = np.empty(n)
    for i, v in enumerate(x):
        s = season[i % period] if season else 0.0
        old = lev
        lev = alpha * (v - s) + (1 - alpha) * (lev + tr)
        if beta is not None:
            tr = beta * (lev - old) + (1 - beta) * tr
        if season:
            season[i % period] = gamma * (v - lev) + (1 - gamma) * s
        out[i] = lev + tr + (season[(i + 1) % period] if season else 0.0)
    return out


def fit_holt_winters(x: np.ndarray, trend: bool = False, period: int = 0) -> np.ndarray:
    """The same with the parameters of a grid that leave the least squared error."""
    steps = (0.1, 0.3, 0.5, 0.7, 0.9)
    best = None
    for a in steps:
        for b in steps if trend else (None,):
            for g in steps if period else (None,):
                f = holt_winters(x, a, b, g, period)
                e = float(((x[1:] - f[:-1]) ** 2).sum())
                if best is None or e < best[0]:
                    best = (e, f)
    return best[1]


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean()
    c0 = float(d @ d)
    return np.array([1.0 if k == 0 else (float(d[k:] @ d[:-k]) / c0 if c0 else 0.0) for k in range(lags + 1)])


def partial_autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """By least squares of each value on its last k."""
    d, out = x - x.mean(), [1.0]
    for k in range(1, lags + 1):
        rows = np.column_stack([np.ones(len(d) - k)] + [d[k - j : len(d) - j] for j in range(1, k + 1)])
        out.append(float(np.linalg.lstsq(rows, d[k:], rcond=None)[0][-1]))
    return np.array(out)


def arima(x: np.ndarray, order: tuple[int, int, int] | str = "auto") -> np.ndarray:
    """ARIMA(p, d, q) by conditional least squares (Hannan and Rissanen); element i is the forecast of i + 1. auto: d = 1, p and q the first lags at which
    autocorrelation and partial autocorrelation fall below 1.96 / sqrt(n)."""
    n = len(x)
    if n < 4:
        return x.astype(float).copy()
    y, first = x - x[0], float(x[0])
    if order == "auto":
        lags = max(1, min(int(10 * math.log10(n)), n // 2 - 1))
        bound = 1.96 / math.sqrt(n)
        below = lambda v: next((k for k in range(1, len(v)) if abs(v[k]) < bound), len(v) - 1)
        order = (below(autocorrelation(y, lags)), 1, below(partial_autocorrelation(y, lags)))
    p, d, q = order
    z = np.diff(y, d) if d else y.copy()
    k = min(max(p, q) + 1 + (q > 0) * 2, max(1, len(z) // 3))
    e = np.zeros(len(z))
    lag = lambda v, m, j: v[m - j : len(v) - j]
    if q and len(z) > 2 * k:
        a = np.column_stack([np.ones(len(z) - k)] + [lag(z, k, j) for j in range(1, k + 1)])
        e[k:] = z[k:] - a @ np.linalg.lstsq(a, z[k:], rcond=None)[0]
    m = min(max(p, q, 1), max(1, len(z) - 1))
    a = np.column_stack([np.ones(len(z) - m)] + [lag(z, m, j) for j in range(1, min(p, m) + 1)] + [lag(e, m, j) for j in range(1, min(q, m) + 1)])
    coef = np.linalg.lstsq(a, z[m:], rcond=None)[0]
    f = np.zeros(len(z) + 1)
    for t in range(len(z) + 1):
        row = [1.0] + [z[t - j] if t >= j else 0.0 for j in range(1, min(p, m) + 1)] + [e[t - j] if t >= j else 0.0 for j in range(1, min(q, m) + 1)]
        f[t] = float(np.dot(coef, row))
    if d == 0:
        return f[1:] + first
    levels = [y]
    for _ in range(d - 1):
        levels.append(np.diff(levels[-1]))
    out = np.empty(n)
    for t in range(n):  # forecast of t + 1: the forecast difference plus the last value of each level
        zt = t + 1 - d
        out[t] = (f[zt] if zt >= 0 else 0.0) + sum(level[t - i] for i, level in enumerate(levels) if t - i >= 0)
    return out + first
