"""Data side of model training: losses, folds, early stopping, collation, graph convolution and forward passes with given weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import contracts
from skerry.operators.ranks import numbered


def reduced(df: DataFrame, loss: str, reduction: str = "mean") -> DataFrame:
    contracts.option(reduction, ("none", "mean", "sum"), "reduction")
    return df.select(loss) if reduction == "none" else df.agg((F.avg if reduction == "mean" else F.sum)(loss).alias(loss))


def kl_std_norm(mu: Column, logstd: Column) -> Column:
    """Divergence of N(mu, exp(logstd)) from the standard normal, one dimension; sum over dimensions and rows, over the rows, is the batch mean."""
    return -0.5 * (1 + 2 * logstd - mu * mu - F.exp(2 * logstd))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def inner_product(u: Column, v: Column) -> Column:
    """Probability of an edge between two latent vectors."""
    return 1 / (1 + F.exp(-dot(u, v)))


def graph_recon(positive: DataFrame, negative: DataFrame, prob: str = "prob") -> DataFrame:
    """Mean -ln p over edges plus mean -ln (1 - p) over non-edges."""
    a = positive.agg(F.avg(-F.log(F.col(prob) + 1e-16)).alias("a"))
    b = negative.agg(F.avg(-F.log(1 - F.col(prob) + 1e-16)).alias("b"))
    return a.join(F.broadcast(b)).select((F.col("a") + F.col("b")).alias("loss"))  # one row each


def sequence_nll(df: DataFrame, logp: str, target: str) -> DataFrame:
    """Mean of -logp[target] over rows with an array of log-probabilities a class."""
    return df.agg(F.avg(-F.get(F.col(logp), F.col(target))).alias("loss"))


def weighted_loss(df: DataFrame, keys: list[str], loss: str = "loss", n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def folds(df: DataFrame, order: list[str], k: int, count: int | None = None) -> DataFrame:
    """fold 0 .. k-1 of contiguous rows, the first n mod k folds one larger. Rows are ranged by order over all tasks, numbered in each and offset by the tasks before."""
    contracts.whole(k, 2, name="k")
    n = count if count is not None else df.count()
    small, extra = n // k, n % k
    at = F.col("_at")
    fold = F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(extra + F.floor((at - extra * (small + 1)) / max(small, 1)))
    return numbered(df, order, "_at").withColumn("fold", fold.cast("int")).drop("_at")


def early_stop(df: DataFrame, keys: list[str], step: str, metric: str, how: str = "desc", warmup: int = 20, laziness: int = 4, tolerance: float = 1e-3) -> DataFrame:
    """Each step with its lazy count and whether training is done. A metric within the tolerance of the best so far, or better, sets the count to -1, any other adds one; the best is always
    brought up to date. From the step numbered `warmup` (from 0) on, `laziness` ends it. A fold over a run's steps, which are few."""
    contracts.option(how, ("asc", "desc"), "how")
    sign = 1.0 if how == "desc" else -1.0
    rows = F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), (F.col(metric) * sign).cast("double").alias("m"))))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("lazy"), F.array().cast("array<struct<s:bigint,m:double,lazy:int,done:boolean>>").alias("out"))

    def fold(a, x):
        lazy = F.when(x["m"] < a["best"] + tolerance, F.lit(-1)).otherwise(a["lazy"] + 1)
        row = F.struct(x["s"].cast("long").alias("s"), x["m"].alias("m"), lazy.alias("lazy"), ((F.size(a["out"]) >= warmup) & (lazy >= laziness)).alias("done"))
        return F.struct(F.least(a["best"], x["m"]).alias("best"), lazy.alias("lazy"), F.concat(a["out"], F.array(row)).alias("out"))

    g = df.groupBy(*keys).agg(rows.alias("_r")).withColumn("_o", F.aggregate("_r", start, fold)["out"])
    return g.select(*keys, F.explode("_o").alias("o")).select(*keys, F.col("o.s").alias(step), (F.col("o.m") * sign).alias(metric), F.col("o.lazy").alias("lazy"), F.col("o.done").alias("done"))


def message_mean(edges: DataFrame, feats: DataFrame, how: str = "sum") -> DataFrame:
    """id and x: sum or mean over incoming edges of the sources' feature arrays, elementwise; nodes without edges keep zeros."""
    contracts.option(how, ("sum", "mean", "gcn"), "how")
    e = edges
    if how == "gcn":  # 1 / sqrt(d_u d_v), loops included
        deg = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d"))
        e = e.join(deg.select(F.col("id").alias("src"), F.col("d").alias("du")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dv")), "dst").withColumn("w", 1 / F.sqrt(F.col("du") * F.col("dv")))
    else:
        e = e.withColumn("w", F.lit(1.0))
    m = e.join(feats.select(F.col("id").alias("src"), "x"), "src").select("dst", "w", F.posexplode("x").alias("k", "v"))
    s = m.groupBy("dst", "k").agg((F.avg if how == "mean" else F.sum)(F.col("w") * F.col("v")).alias("v"))
    got = s.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda r: r["v"]).alias("_x"))
    return feats.join(got, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("_x", F.transform("x", lambda _: F.lit(0.0))).alias("x"))


def dense(x: Column, w: list[list[float]], b: list[float], act: str = "none") -> Column:
    """x w + b for an array column and given weights (in x out), with relu, sigmoid, tanh or none."""
    f = {"none": lambda c: c, "relu": lambda c: F.greatest(c, F.lit(0.0)), "sigmoid": lambda c: 1 / (1 + F.exp(-c)), "tanh": F.tanh}[act]
    cols = [F.array(*[F.lit(float(r[j])) for r in w]) for j in range(len(b))]
    return F.array(*[f(dot(x, c) + float(b[j])) for j, c in enumerate(cols)])


def mlp(x: Column, layers: list[tuple[list[list[float]], list[float]]], act: str = "relu") -> Column:
    """Layers with an activation, the last one plain."""
    for i, (w, b) in enumerate(layers):
        x = dense(x, w, b, act if i < len(layers) - 1 else "none")
    return x


def palette(df: DataFrame, category: str, pos: str, colors: list[str]) -> DataFrame:
    """category and color: categories in order of first appearance take the colours in turn."""
    first = df.groupBy(category).agg(F.min(pos).alias("_f"))
    rank = F.row_number().over(Window.orderBy("_f")) - 1  # a row a category
    return first.withColumn("rank", rank).select(category, F.col("rank").cast("int"), F.get(F.array(*map(F.lit, colors)), F.col("rank") % len(colors)).alias("color"))


def select_inputs(df: DataFrame, spec: str) -> DataFrame:
    """Columns by a selector such as `X, data.y`."""
    return df.select(*[F.col(s.strip()).alias(s.strip().replace(".", "_")) for s in spec.split(",") if s.strip()])


def gin(edges: DataFrame, feats: DataFrame, eps: float = 0.0) -> DataFrame:
    """(1 + eps) x plus the sum of incoming neighbours' features; a dense layer may follow."""
    s = message_mean(edges, feats, "sum").withColumnRenamed("x", "_s")
    return feats.join(s, "id").select("id", F.zip_with("x", "_s", lambda a, b: a * (1 + eps) + b).alias("x"))


def gat(edges: DataFrame, feats: DataFrame, w: list[list[float]], a_src: list[float], a_dst: list[float], slope: float = 0.2) -> DataFrame:
    """One attention head: x w of the sources, weighed by a softmax over each node's incoming edges of leaky a_src . h_u + a_dst . h_v."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    h = feats.select("id", dense(F.col("x"), w, [0.0] * len(w[0])).alias("h"))
    h = h.withColumns({"su": dot(F.col("h"), lit(a_src)), "sv": dot(F.col("h"), lit(a_dst))})
    e = edges.select("src", "dst").join(h.select(F.col("id").alias("src"), "h", "su"), "src").join(h.select(F.col("id").alias("dst"), "sv"), "dst")
    raw = F.col("su") + F.col("sv")
    e = e.withColumn("e", F.when(raw > 0, raw).otherwise(raw * slope))
    top = e.groupBy("dst").agg(F.max("e").alias("m"))
    e = e.join(top, "dst").withColumn("p", F.exp(F.col("e") - F.col("m")))
    parts = e.select("dst", "p", F.posexplode("h").alias("k", "v")).groupBy("dst", "k").agg((F.sum(F.col("p") * F.col("v")) / F.sum("p")).alias("v"))
    return parts.groupBy(F.col("dst").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda r: r["v"]).alias("x"))


def autoencode(x: Column, encoder: list, decoder: list, act: str = "relu") -> tuple[Column, Column]:
    """(latent, reconstruction) with given weights."""
    z = mlp(x, encoder, act)
    return z, mlp(z, decoder, act)


def squared_error(x: Column, y: Column) -> Column:
    """Mean squared difference of two arrays."""
    d = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def reparametrize(mu: Column, logstd: Column, noise: Column) -> Column:
    """mu + noise * exp(logstd), elementwise; noise comes from the caller, so that training is random and inference is not."""
    return F.zip_with(mu, F.zip_with(logstd, noise, lambda s, e: F.exp(s) * e), lambda m, d: m + d)


def greedy_decode(df: DataFrame, key: str, latent: str, embed: list, cell: tuple, out_w: list, out_b: list, steps: int, first: int = 0) -> DataFrame:
    """key and tokens: a gated recurrent decoder with given weights, each step fed with its own best token before."""
    e, w, ow, ob = np.asarray(embed, float), [np.asarray(c, float) for c in cell], np.asarray(out_w, float), np.asarray(out_b, float)

    def one(h):
        h, t, out = np.asarray(h, float), first, []
        n = len(h)
        sig = lambda v: 1 / (1 + np.exp(-v))
        for _ in range(steps):
            a, b = w[0] @ e[t] + w[2], w[1] @ h + w[3]
            r, z = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
            t = int((h @ ow + ob).argmax())
            out.append(t)
        return out

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "tokens": [one(h) for h in pdf[latent]]})

    return df.select(key, latent).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, tokens array<int>")
