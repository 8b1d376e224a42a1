"""Around training: accumulated metrics, batches of graphs, negative edges, masks, classifiers, losses of variational models, sequence models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import contracts
from skerry.operators.learn import dense, inner_product, kl_std_norm, mlp, squared_error
from skerry.operators.ranks import draw, numbered, running_before, unit


class Accumulator:
    """Sums of named attributes. add takes a list in their order or a dict of some of them; accumulate does the same for all rows of a table."""

    def __init__(self, attrs: list[str]):
        self.sums = dict.fromkeys(attrs, 0.0)

    def add(self, values: list[float] | dict[str, float]) -> Accumulator:
        if not isinstance(values, dict):
            if len(values) != len(self.sums):
                raise ValueError(f"{len(values)} values for {len(self.sums)} attributes")
            values = dict(zip(self.sums, values, strict=True))
        for k in values:
            contracts.option(k, self.sums, "attribute")
        for k, v in values.items():
            self.sums[k] += float(v)
        return self

    def get(self, attr: str) -> float:
        return self.sums[contracts.option(attr, self.sums, "attribute")]


def accumulate(df: DataFrame, keys: list[str], order: list[str], attrs: list[str]) -> DataFrame:
    """keys, order and, for each attribute, its sum up to the row; nulls count as 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*keys, *order, *[F.sum(F.coalesce(F.col(a).cast("double"), F.lit(0.0))).over(w).alias(a) for a in attrs])


def batch_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs (nodes: g, id from 0; edges: g, src, dst) as one: ids are offset by the numbers of nodes of the graphs before, in the order of g, and nodes bear their graph as batch."""
    sizes = running_before(nodes.groupBy("g").agg((F.max("id") + 1).alias("n")), ["g"], "n", "offset").select("g", "offset")
    n = nodes.join(sizes, "g")
    e = edges.join(sizes, "g")
    return n.select((F.col("id") + F.col("offset")).alias("id"), F.col("g").alias("batch"), *[c for c in nodes.columns if c not in ("g", "id")]), e.select((F.col("src") + F.col("offset")).alias("src"), (F.col("dst") + F.col("offset")).alias("dst"))


def negative_edges(edges: DataFrame, n_nodes: int, seed: int = 0) -> DataFrame:
    """src and dst of pairs that are no edges and no loops: one is drawn for each edge (by its number in the order of src and dst) from the ids below n_nodes, and those that are edges fall out."""
    contracts.whole(n_nodes, 1, name="n_nodes")
    e = edges.select("src", "dst").distinct()
    drawn = numbered(e, ["src", "dst"], "k").select(F.pmod(draw(seed, "k", F.lit(0)), F.lit(n_nodes)).alias("src"), F.pmod(draw(seed, "k", F.lit(1)), F.lit(n_nodes)).alias("dst"))
    return drawn.filter("src <> dst").distinct().join(e, ["src", "dst"], "left_anti")


def mask_rows(df: DataFrame, graph: list[str], node: str, values: list[str], p: float = 0.5, seed: int = 0, method: str = "zeros") -> DataFrame:
    """Masks the values of a share p of each graph's nodes, one at least, drawn by seed and node: by zeros, or by numbers drawn between each value's least and greatest in the graph."""
    contracts.option(method, ("zeros", "uniform"), "method")
    d = df.withColumn("_r", unit(seed, node))
    stats = [F.min("_r").alias("_m")] + [x for i, v in enumerate(values) for x in (F.min(v).cast("double").alias(f"_l{i}"), F.max(v).cast("double").alias(f"_h{i}"))]
    d = d.join(d.groupBy(*graph).agg(*stats), graph)
    hit = F.col("_r") <= F.greatest(F.col("_m"), F.lit(p))
    new = [F.lit(0.0) if method == "zeros" else F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * unit(seed + 1 + i, node) for i in range(len(values))]
    out = d.withColumns({v: F.when(hit, x).otherwise(F.col(v).cast("double")) for v, x in zip(values, new, strict=True)}).withColumn("masked", hit)
    return out.drop("_r", "_m", *[f"_{k}{i}" for i in range(len(values)) for k in "lh"])


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def classify(x: Column, encoder: list, classifier: tuple[list[list[float]], list[float]], act: str = "relu") -> tuple[Column, Column]:
    """(latent, class probabilities) with given weights. For nodes of a graph, x comes from a graph convolution."""
    z = mlp(x, encoder, act)
    return z, softmax(dense(z, *classifier))


def variational_loss(mu: Column, logstd: Column, x: Column, y: Column) -> Column:
    """Reconstruction error of a row plus the divergence of its latent from the standard normal, both means over their dimensions."""
    kl = F.aggregate(F.zip_with(mu, logstd, kl_std_norm), F.lit(0.0), lambda s, v: s + v) / F.size(mu)
    return squared_error(x, y) + kl


def variational_graph_loss(latent: DataFrame, edges: DataFrame, negative: DataFrame) -> DataFrame:
    """loss of a graph's latent rows (id, mu, logstd): mean -ln p over edges plus mean -ln (1 - p) over negative ones, p from inner products of mu, plus the mean divergence over the number of nodes."""
    mu = latent.select("id", "mu")
    pair = lambda e: e.select("src", "dst").join(mu.withColumnsRenamed({"id": "src", "mu": "u"}), "src").join(mu.withColumnsRenamed({"id": "dst", "mu": "v"}), "dst").select(inner_product(F.col("u"), F.col("v")).alias("prob"))
    a = pair(edges).agg(F.avg(-F.log(F.col("prob") + 1e-16)).alias("a"))
    b = pair(negative).agg(F.avg(-F.log(1 - F.col("prob") + 1e-16)).alias("b"))
    each = F.aggregate(F.zip_with("mu", "logstd", kl_std_norm), F.lit(0.0), lambda s, v: s + v)
    k = latent.agg((F.avg(each) / F.count(F.lit(1))).alias("k"))
    return a.join(F.broadcast(b)).join(F.broadcast(k)).select((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) + F.col("k")).alias("loss"))  # one row each


def _cell(kind: str, x: np.ndarray, h: np.ndarray, c: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A step of a gated recurrent unit (weights stacked as reset, update, new) or a long short-term memory (input, forget, cell, output)."""
    sig, n = lambda v: 1 / (1 + np.exp(-v)), len(h)
    a, b = w[0] @ x + w[2], w[1] @ h + w[3]
    if kind == "gru":
        r, z = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
        return (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h, c
    g = a + b
    c = sig(g[n : 2 * n]) * c + sig(g[:n]) * np.tanh(g[2 * n : 3 * n])
    return sig(g[3 * n :]) * np.tanh(c), c


def run_layers(kind: str, xs: np.ndarray, layers: list[list[list]]) -> tuple[np.ndarray, np.ndarray]:
    """(outputs by step, last states) of stacked layers; a layer has one set of weights (wi, wh, bi, bh) for each direction, one or two, whose outputs are joined."""
    last = []
    for directions in layers:
        outs = []
        for k, w in enumerate(directions):
            w = [np.asarray(v, float) for v in w]
            h = c = np.zeros(w[1].shape[1])
            steps = []
            for x in xs[::-1] if k else xs:
                h, c = _cell(kind, x, h, c, w)
                steps.append(h)
            outs.append(np.array(steps[::-1] if k else steps))
            last.append(h)
        xs = np.concatenate(outs, axis=1)
    return xs, np.concatenate(last[-len(layers[-1]) :])


def encode_layers(df: DataFrame, key: str, xs: str, kind: str, layers: list) -> DataFrame:
    """key and latent (the last layer's last states) of each row's array of vectors; weights are given."""
    contracts.option(kind, ("gru", "lstm"), "kind")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "latent": [run_layers(kind, np.array([np.asarray(v, float) for v in s]), layers)[1].tolist() for s in pdf[xs]]})

    return df.select(key, xs).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, latent array<double>")


def teacher_forced(df: DataFrame, key: str, latent: str, target: str, embed: list, cell: list, out_w: list, out_b: list, first: int = 0, kind: str = "gru") -> DataFrame:
    """key, loss (mean -ln p of the target tokens) and tokens (the best at each step) of a decoder that is fed with the target's token before; weights are given."""
    e, w, ow, ob = np.asarray(embed, float), [np.asarray(c, float) for c in cell], np.asarray(out_w, float), np.asarray(out_b, float)

    def one(h, goal):
        h, t, best, loss = np.asarray(h, float), first, [], []
        c = np.zeros(len(h))
        for g in goal:
            h, c = _cell(kind, e[t], h, c, w)
            o = h @ ow + ob
            loss.append(float(np.log(np.exp(o - o.max()).sum()) + o.max() - o[int(g)]))
            best.append(int(o.argmax()))
            t = int(g)
        return (float(np.mean(loss)) if loss else None), best

    def run(batches):
        for pdf in batches:
            got = [one(h, g) for h, g in zip(pdf[latent], pdf[target], strict=True)]
            yield pd.DataFrame({key: pdf[key], "loss": [x for x, _ in got], "tokens": [y for _, y in got]})

    return df.select(key, latent, target).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, loss double, tokens array<int>")


def k_fold_metrics(df: DataFrame, order: list[str], k: int, fit, predict, metric: Column) -> DataFrame:
    """fold and the mean metric of each held-out fold: fit(train) gives a model, predict(test, model) adds what metric needs. A driver loop over k folds; each step is distributed."""
    from skerry.operators.learn import folds

    f = folds(df, order, k)
    out = None
    for i in range(k):
        test = predict(f.filter(F.col("fold") == i), fit(f.filter(F.col("fold") != i)))
        one = test.groupBy("fold").agg(F.avg(metric).alias("metric"))
        out = one if out is None else out.unionByName(one)
    return out


def graph_plot(nodes: DataFrame, edges: DataFrame, category: str, colors: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a plot of a graph shows: nodes with a place on a circle in the order of their ids and their category's colour, edges with the places of both ends."""
    from skerry.operators.learn import palette

    n = nodes.count()
    at = numbered(nodes, ["id"], "_k").withColumn("_a", 2 * np.pi * F.col("_k") / max(n, 1))
    at = at.join(F.broadcast(palette(nodes, category, "id", colors).select(category, "color")), category).select("id", F.cos("_a").alias("x"), F.sin("_a").alias("y"), category, "color")
    e = edges.select("src", "dst").join(at.select(F.col("id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), "src").join(at.select(F.col("id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1")), "dst")
    return at, e
