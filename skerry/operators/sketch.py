"""Quantile sketches: a t-digest with partial and final aggregation, and the divergence of two digests; exact quantiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry import contracts
from skerry.operators.ranks import running_before
from skerry.storage import cut

#: Up to so many keys are broadcast to the rows of exact quantiles; beyond, rows are joined by shuffling.
BROADCAST_KEYS = 100_000
STATE = "min double, max double, total long, clusters array<struct<mean:double,cnt:long>>"


#: Scale functions by name: how many units of size lie left of a quantile. Each takes quantiles, delta and the number of values.
SCALES = {
    "k0": lambda q, delta, n: delta / 2 * q,
    "k1": lambda q, delta, n: delta / (2 * math.pi) * np.arcsin(2 * q - 1),
    "k2": lambda q, delta, n: delta / (4 * math.log(max(n / delta, 1)) + 24) * np.log(np.clip(q, 1e-15, 1) / np.clip(1 - q, 1e-15, 1)),
    "k3": lambda q, delta, n: delta / (4 * math.log(max(n / delta, 1)) + 21) * np.where(q <= 0.5, np.log(np.clip(2 * q, 1e-15, 1)), -np.log(np.clip(2 * (1 - q), 1e-15, 1))),
}


def scale(q: np.ndarray, delta: float = 57, name: str | Callable = "k1", n: float = 1) -> np.ndarray:
    return (name if callable(name) else SCALES[contracts.option(name, SCALES, "scale")])(np.clip(q, 0, 1), delta, n)


def merge(means: np.ndarray, counts: np.ndarray, delta: float = 57, name: str | Callable = "k1") -> tuple[np.ndarray, np.ndarray]:
    """Clusters in order of mean, neighbours drawn together from the left as long as a cluster spans at most one unit of the scale."""
    order = np.argsort(means, kind="stable")
    means, counts = means[order], counts[order]
    total, done = counts.sum(), 0
    edge = scale(np.concatenate([[0], np.cumsum(counts)]) / total, delta, name, total)
    out_m, out_c, start = [], [], 0
    while start < len(means):
        # the last cluster whose right edge is within one unit of this one's left edge
        end = max(int(np.searchsorted(edge, edge[start] + 1 + 1e-12, side="right")) - 1, start + 1)
        c = counts[start:end].sum()
        out_m.append(float((means[start:end] * counts[start:end]).sum() / c))
        out_c.append(int(c))
        done += c
        start = end
    return np.array(out_m), np.array(out_c)


def digest(df: DataFrame, keys: list[str], value: str, buffer: int = 10_000, delta: float = 57, scale_name: str | Callable = "k1") -> DataFrame:
    """keys with min, max, total and clusters. Each task keeps one digest a key, flushed at `buffer` values; digests of a key are then merged, a few hundred clusters each."""
    contracts.whole(buffer, 1, name="buffer")
    head = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    schema = f"{head}, {STATE}"

    def row(key, lo, hi, means, counts):
        return [*key, lo, hi, int(counts.sum()), [{"mean": float(m), "cnt": int(c)} for m, c in zip(means, counts, strict=True)]]

    names = [*keys, "min", "max", "total", "clusters"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            pdf = pdf.dropna(subset=[value])
            for key, g in pdf.groupby(keys, dropna=False, sort=False):
                x = g[value].to_numpy(float)
                lo, hi, m, c = held.get(key, (np.inf, -np.inf, np.empty(0), np.empty(0, np.int64)))
                for a in range(0, len(x), buffer):
                    part = x[a : a + buffer]
                    m, c = merge(np.concatenate([m, part]), np.concatenate([c, np.ones(len(part), np.int64)]), delta, scale_name)
                held[key] = (min(lo, x.min()), max(hi, x.max()), m, c)
        yield pd.DataFrame([row(k, *v) for k, v in held.items()], columns=names)

    def final(key, pdf):
        m = np.array([x["mean"] for c in pdf["clusters"] for x in c])
        n = np.array([x["cnt"] for c in pdf["clusters"] for x in c], np.int64)
        if len(pdf) > 1:
            m, n = merge(m, n, delta, scale_name)
        return pd.DataFrame([row(key, pdf["min"].min(), pdf["max"].max(), m, n)], columns=names)

    return df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(partial, schema).groupBy(*keys).applyInPandas(final, schema)


def quantile(q: float) -> Column:
    """A digest's quantile: min at 0, max at 1, between the breakpoints (0, min) and (mass up to a cluster, its mean) along lines."""
    contracts.number(q, 0, 1, name="q")
    if q in (0, 1):
        return F.col("min") if q == 0 else F.col("max")
    cl = F.col("clusters")
    points = F.aggregate(cl, F.struct(F.lit(0).cast("long").alias("n"), F.array(F.struct(F.lit(0.0).alias("q"), F.col("min").alias("v"))).alias("p")), lambda a, c: F.struct((a["n"] + c["cnt"]).alias("n"), F.concat(a["p"], F.array(F.struct(((a["n"] + c["cnt"]) / F.col("total")).alias("q"), c["mean"].alias("v")))).alias("p")), lambda a: a["p"])
    left, right = F.element_at(F.filter(points, lambda p: p["q"] <= q), -1), F.element_at(F.filter(points, lambda p: p["q"] > q), 1)
    return F.transform(F.array(F.struct(left.alias("a"), right.alias("b"))), lambda s: F.when(s["b"].isNull(), s["a"]["v"]).otherwise(s["a"]["v"] + (s["b"]["v"] - s["a"]["v"]) * (q - s["a"]["q"]) / (s["b"]["q"] - s["a"]["q"])))[0]


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys with min, max, total (nulls aside) and q, an array of the quantiles `at`, each on the line between the two values about its place; a key without values has nulls. Equal values are counted, counts
    are summed in ranges over all tasks, and only the values about a place leave them, so no task has all values of a key."""
    for q in at:
        contracts.number(q, 0, 1, name="q")
    v, name = F.col(value).cast("double"), [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*[F.col(k).alias(n) for k, n in zip(keys, name, strict=True)], v.alias("_v")).groupBy(*name, "_v").agg(F.count("_v").alias("_n"))  # 0 for null
    placed = running_before(counts, [*name, "_v"], "_n", "_at")
    whole = cut(placed.groupBy(*name).agg(F.min("_at").alias("_start"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum("_n").alias("total")))
    ours = whole.withColumnsRenamed({n: f"{n}w" for n in name})
    ours = F.broadcast(ours) if whole.count() <= BROADCAST_KEYS else ours
    both = placed.join(ours, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}w")) for n in name], F.lit(True)))
    first = F.col("_at") - F.col("_start")
    here = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("_n")), F.col("_v")))
    place = [(F.col("total") - 1) * F.lit(float(q)) for q in at]
    ends = [here(r).alias(f"_{end}{i}") for i, p in enumerate(place) for end, r in (("l", F.floor(p)), ("h", F.ceil(p)))]
    found = both.groupBy(*name, "min", "max", "total").agg(*ends)
    low, high = ([F.col(f"_{end}{i}") for i in range(len(at))] for end in "lh")
    between = [F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi) for p, lo, hi in zip(place, low, high, strict=True)]
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, name, strict=True)], "min", "max", "total", F.array(*between).alias("q"))


def divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Divergence of two digests' cluster means weighted by counts, by key."""
    from skerry.operators.distance import kl_of_moments, moments

    flat = lambda d: d.select(*keys, F.explode("clusters").alias("c")).select(*keys, F.col("c.mean").alias("x"), F.col("c.cnt").alias("w"))
    ma, mb = moments(flat(a), keys, "x", "w"), moments(flat(b), keys, "x", "w")
    j = ma.join(mb.withColumnsRenamed({"mean": "m2", "variance": "v2"}), keys)
    return j.select(*keys, kl_of_moments(F.col("mean"), F.col("variance"), F.col("m2"), F.col("v2")).alias("divergence"))
