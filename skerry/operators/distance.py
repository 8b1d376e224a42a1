"""Distances of series and samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import contracts


def row_norm(x: Column, y: Column, p: float = 2) -> Column:
    """p-norm of the difference of two arrays."""
    contracts.number(p, 1, name="p")
    d = F.zip_with(x, y, lambda a, b: F.pow(F.abs(a.cast("double") - b.cast("double")), F.lit(float(p))))
    return F.pow(F.aggregate(d, F.lit(0.0), lambda s, v: s + v), F.lit(1.0 / p))


def lp_norm(df: DataFrame, keys: list[str], x: str, y: str, p: float = 2, out: str = "distance") -> DataFrame:
    """Mean over an entity's rows of the p-norm of x - y."""
    d = F.when(F.size(x) != F.size(y), F.raise_error(F.lit("arrays differ in length"))).otherwise(row_norm(F.col(x), F.col(y), p))
    return df.groupBy(*keys).agg(F.avg(d).alias(out))


def sbd(df: DataFrame, keys: list[str], pos: str, x: str, y: str, shifting: bool = True, out: str = "distance") -> DataFrame:
    """1 - the greatest normalised cross-correlation over all shifts (or none). Without shifts, plain sums; with them, one kernel an entity, by Fourier transforms (n log n); null where a series is all zeros."""
    norm = F.sqrt(F.sum(F.col(x) * F.col(x))) * F.sqrt(F.sum(F.col(y) * F.col(y)))
    if shifting:
        schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", _c double"

        def run(key, pdf):
            at = (pdf["p"] - pdf["p"].min()).to_numpy(np.int64)
            n = int(at.max()) + 1
            size = 1 << (2 * n - 1).bit_length()
            both = np.zeros((4, n))
            for row, v in enumerate((pdf["x"], pdf["y"])):
                v = pd.to_numeric(v).to_numpy(float)
                np.add.at(both[row], at, np.nan_to_num(v))
                np.add.at(both[2 + row], at, (~np.isnan(v)).astype(float))
            f = np.fft.rfft(both, size)
            got, pairs = (np.fft.irfft(f[a] * np.conj(f[a + 1]), size) for a in (0, 2))
            return pd.DataFrame([[*key, float(got[pairs > 0.5].max()) if (pairs > 0.5).any() else None]], columns=[*keys, "_c"])

        best = df.select(*keys, F.col(pos).cast("long").alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy(*keys).applyInPandas(run, schema)
    else:
        best = df.groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("_c"))
    norms = df.groupBy(*keys).agg(norm.alias("_n"))
    r = F.greatest(F.least(F.col("_c") / F.when(F.col("_n") == 0, None).otherwise(F.col("_n")), F.lit(1.0)), F.lit(-1.0))
    return best.join(norms, keys).select(*keys, (1 - r).alias(out))


def lb_kim(df: DataFrame, keys: list[str], pos: str, x: str, y: str, out: str = "bound") -> DataFrame:
    """Greatest of the differences of first, last, greatest and least values."""
    g = df.groupBy(*keys).agg(*[f(c, pos).alias(f"_{n}{k}") for n, f in (("f", F.min_by), ("l", F.max_by)) for k, c in (("x", x), ("y", y))], *[f(c).alias(f"_{n}{k}") for n, f in (("a", F.max), ("i", F.min)) for k, c in (("x", x), ("y", y))])
    return g.select(*keys, F.greatest(*[F.abs(F.col(f"_{n}x") - F.col(f"_{n}y")) for n in "flai"]).alias(out))


def lb_keogh(df: DataFrame, keys: list[str], pos: str, x: str, y: str, r: int = 1, out: str = "bound") -> DataFrame:
    """Sum of how far y leaves the envelope of x within r positions. Swap x and y for the reversed bound."""
    contracts.whole(r, 0, name="r")
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-r, r)
    over, under = F.col(y) - F.max(x).over(w), F.min(x).over(w) - F.col(y)
    return df.withColumn("_e", F.greatest(over, under, F.lit(0.0))).groupBy(*keys).agg(F.sum("_e").alias(out))


def dtw_value(a: np.ndarray, b: np.ndarray, weighted: bool = True) -> float:
    """Warping distance of two sequences of vectors; a diagonal step counts twice if weighted. Two rows of the table are held, and a row is swept
    by anti-diagonal-free recursion over the left neighbour."""
    f = 2.0 if weighted else 1.0
    prev = None
    for i in range(len(a)):
        w = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
        cum = np.cumsum(w)
        if prev is None:
            prev = cum
            continue
        up = prev + w
        up[1:] = np.minimum(up[1:], prev[:-1] + f * w[1:])
        # row[j] = min(up[j], row[j-1] + w[j])  <=>  row - cum = running minimum of up - cum
        prev = np.minimum.accumulate(up - cum) + cum
    return float(prev[-1])


def dtw(df: DataFrame, keys: list[str], pos: str, x: list[str], y: list[str], weighted: bool = True, out: str = "distance") -> DataFrame:
    """Dynamic time warping of x and y in order of pos, by entity. A table's row is needed as a whole, hence a grouped kernel; nulls in y or x (series of other length) are left out."""
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + f", `{out}` double"

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(pos)
        a, b = pdf[x].dropna().to_numpy(float), pdf[y].dropna().to_numpy(float)
        return pd.DataFrame([[*key, dtw_value(a, b, weighted) if len(a) and len(b) else None]], columns=[*keys, out])

    return df.groupBy(*keys).applyInPandas(run, schema)


def dtw_within(df: DataFrame, keys: list[str], pos: str, x: str, y: str, limit: float, out: str = "distance") -> DataFrame:
    """Entities whose warping distance is at most the limit: the cheap bound goes first, so that only what it lets pass is warped."""
    near = lb_kim(df, keys, pos, x, y).filter(F.col("bound") <= limit).select(*keys)
    return dtw(df.join(near, keys, "left_semi"), keys, pos, [x], [y], True, out).filter(F.col(out) <= limit)


def moments(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Mean and variance of the Gaussian kernel density (Scott's bandwidth) of an entity's weighted sample, as sums; both null where the density has no width."""
    v, w = F.col(value).cast("double"), (F.col(weight).cast("double") if weight else F.lit(1.0))
    s = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_wx"), F.sum(w * w).alias("_ww"))
    m = s.select(*keys, (F.col("_wx") / F.col("_w")).alias("mean"), (F.col("_ww") / F.col("_w") / F.col("_w")).alias("_s2"), "_w")
    d = df.join(m, keys).groupBy(*keys, "mean", "_s2", "_w").agg(F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("_q"))
    var = F.col("_q") / F.col("_w") * (1 + F.pow(F.col("_s2"), F.lit(0.4)) / (1 - F.col("_s2")))
    ok = (F.col("_s2") < 1) & (F.col("_q") > 0)
    return d.select(*keys, F.when(ok, F.col("mean")).alias("mean"), F.when(ok, var).alias("variance"))


def kl_of_moments(mx: Column, vx: Column, my: Column, vy: Column) -> Column:
    """Divergence of two Gaussians given by mean and variance."""
    return 0.5 * (vx / vy + (mx - my) * (mx - my) / vy - 1 - F.log(vx / vy))
