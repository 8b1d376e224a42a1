"""Arrays and matrices: replacement, permutation, padding, assignment and graph matching; votes, grids and choices among runs."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import contracts


def replace_values(column: str, old: list, new: list):
    """Values of a column replaced all at once; of an old value given twice the last counts."""
    if len(old) != len(new):
        raise ValueError("as many new values as old ones are needed")
    mapping = dict(zip(old, new, strict=True))
    if not mapping:
        return F.col(column)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, F.col(column)), F.col(column))


def replace_in_array(column: str, old: list, new: list):
    mapping = dict(zip(old, new, strict=True))
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(column, lambda x: F.coalesce(F.element_at(m, x), x))


def permute(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """matrix (i, j, v) and order (new, old) to b[i, j] = a[order[i], order[j]]."""
    rows, cols = order.select(F.col("new").alias("_i"), F.col("old").alias("i")), order.select(F.col("new").alias("_j"), F.col("old").alias("j"))
    return matrix.join(rows, "i").join(cols, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "v")


def pad(df: DataFrame, column: str, batch: list[str], out: str = "padded") -> DataFrame:
    """Arrays padded on the right with zeros to the longest of their batch, and their own lengths."""
    longest = df.groupBy(*batch).agg(F.max(F.size(column)).alias("_n"))
    zero = F.lit(0).cast(df.schema[column].dataType.elementType)
    return df.join(longest, batch).withColumn("length", F.size(column)).withColumn(out, F.concat(column, F.array_repeat(zero, F.col("_n") - F.size(column)))).drop("_n")


def cost_matrix(a: DataFrame, b: DataFrame, block: int = 1000) -> DataFrame:
    """(i, j, cost): the difference of row sums of two matrices (i, j, v). The result has a row a pair; b's row sums are dealt in blocks, and each row of a meets each block."""
    ra, rb = a.groupBy("i").agg(F.sum("v").alias("x")), b.groupBy(F.col("i").alias("j")).agg(F.sum("v").alias("y"))
    n = max(1, -(-rb.count() // block))
    blocks = rb.groupBy(F.pmod(F.xxhash64("j"), F.lit(n)).alias("_k")).agg(F.collect_list(F.struct("j", "y")).alias("_b"))
    wide = ra.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return wide.join(blocks, "_k").select("i", "x", F.explode("_b").alias("q")).select("i", "q.j", F.abs(F.col("x") - F.col("q.y")).alias("cost"))


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least cost, by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        back = assign(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def match_graphs(a: np.ndarray, b: np.ndarray, method: str = "yaaq", rounds: int = 50, tol: float = 1e-3) -> np.ndarray:
    """t with b = a[t][:, t] as nearly as found. unary: row sums; lawler: power iteration; pairwise and yaaq: Frank-Wolfe on trace(a' p b p'), the products of
    a and b with p standing for the Kronecker matrix."""
    contracts.option(method, ("unary", "pairwise", "lawler", "yaaq"), "method")
    n = len(a)
    if method == "unary":
        return assign(np.abs(b.sum(1)[:, None] - a.sum(1)[None, :]))
    p = np.full((n, n), 1.0 / n)  # p[i, j]: row i of b is row j of a
    if method == "lawler":
        for _ in range(30):
            q = b @ p @ a.T
            q /= np.linalg.norm(q) or 1.0
            if np.abs(q - p).max() < 0.03 * max(np.abs(q).max(), 1e-12):
                p = q
                break
            p = q
        return assign(-p)
    for _ in range(rounds):
        grad = b @ p @ a.T + b.T @ p @ a
        q = np.zeros((n, n))
        q[np.arange(n), assign(-grad)] = 1
        d = q - p
        quad, lin = float((d * (b @ d @ a.T)).sum()), float((grad * d).sum())
        step = 1.0 if quad >= 0 else min(1.0, max(0.0, -lin / (2 * quad)))
        p = p + step * d
        if lin < tol or step == 0:
            break
    return assign(-p)


def match_pairs(df: DataFrame, keys: list[str], method: str = "yaaq", back: bool = False) -> DataFrame:
    """keys, i, j and two matrices' values a and b, to the permutation (i, t) for each pair of matrices; back: the one that leads back. One kernel a pair."""
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", i long, t long"

    def run(key, pdf):
        a, b = (pdf.pivot(index="i", columns="j", values=c).fillna(0).to_numpy(float) for c in ("a", "b"))
        t = match_graphs(b, a, method) if back else match_graphs(a, b, method)
        return pd.DataFrame([[*key, i, int(x)] for i, x in enumerate(t)], columns=[*keys, "i", "t"])

    return df.groupBy(*keys).applyInPandas(run, schema)


def soft_vote(df: DataFrame, weight: str | None = None) -> DataFrame:
    """source, sample, class, prob to sample, label: the class of the greatest weighted mean, the lowest of ties."""
    w = F.col(weight) if weight else F.lit(1.0)
    m = df.groupBy("sample", "class").agg((F.sum(w * F.col("prob")) / F.sum(w)).alias("p"))
    return m.groupBy("sample").agg(F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("b")).select("sample", (-F.col("b.c")).alias("label"), F.col("b.p").alias("prob"))


def hard_vote(df: DataFrame, weight: str | None = None) -> DataFrame:
    """source, sample, label to sample, label: the greatest sum of weights, the lowest label of ties."""
    w = F.col(weight) if weight else F.lit(1.0)
    m = df.groupBy("sample", "label").agg(F.sum(w).alias("v"))
    return m.groupBy("sample").agg(F.max(F.struct("v", (-F.col("label")).alias("c"))).alias("b")).select("sample", (-F.col("b.c")).alias("label"), F.col("b.v").alias("votes"))


def argmax_labels(df: DataFrame) -> DataFrame:
    """source, sample, class, prob to source, sample, label."""
    b = F.max(F.struct("prob", (-F.col("class")).alias("c")))
    return df.groupBy("source", "sample").agg(b.alias("b")).select("source", "sample", (-F.col("b.c")).alias("label"))


def kwargs_grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """A row for each combination, numbered from 0, the last key fastest."""
    d = spark.createDataFrame([(0,)], "combo long")
    for name, values in options.items():
        d = d.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_p", name)).withColumn("combo", F.col("combo") * len(values) + F.col("_p")).drop("_p")
    return d


def kwargs_list(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, v, strict=True)) for v in product(*options.values())]


def choose(runs: DataFrame, order: str, criterion: str, how: str = "global_min") -> DataFrame:
    """Runs at the global or a local extreme of their criterion; of equal global ones the first."""
    from skerry.operators.series import local_extrema

    contracts.option(how, ("global_min", "global_max", "local_min", "local_max"), "how")
    kind = how[-3:]
    if how.startswith("global"):
        best = runs.agg((F.min if kind == "min" else F.max)(F.struct(F.col(criterion), (F.col(order) if kind == "min" else -F.col(order)).alias("o"))).alias("b"))
        return runs.join(best, F.col(order) == (F.col("b.o") if kind == "min" else -F.col("b.o"))).drop("b")
    return local_extrema(runs.withColumn("_one", F.lit(0)), ["_one"], [order], criterion, kind, "_x").filter("_x").drop("_one", "_x")


def elbow(runs: DataFrame, order: str, criterion: str, how: str = "descending") -> DataFrame:
    """Runs where the min-max scaled criterion is locally farthest below the line from 1 to 0 (descending) or above the line from 0 to 1 (ascending), ends included; runs are few (a row a parameter set)."""
    from skerry.operators.series import local_extrema

    contracts.option(how, ("ascending", "descending"), "how")
    w, all_ = Window.partitionBy("_one").orderBy(order), Window.partitionBy("_one")
    r = runs.withColumn("_one", F.lit(0))
    low, high = F.min(criterion).over(all_), F.max(criterion).over(all_)
    scaled = F.when(low == high, F.lit(0.0)).otherwise((F.col(criterion) - low) / (high - low))
    share = (F.row_number().over(w) - 1) / F.greatest(F.count(F.lit(1)).over(all_) - 1, F.lit(1))
    r = r.withColumn("_d", scaled - (share if how == "ascending" else 1 - share))
    return local_extrema(r, ["_one"], [order], "_d", "max" if how == "ascending" else "min", "_x").filter("_x").select(*runs.columns, F.col("_d").alias("bend"))


def run_algorithm(grid: DataFrame, data: list, run, schema: str) -> DataFrame:
    """Calls run(data, **combination) for each row of a grid, in parallel; it returns the values of schema. data is broadcast: a sample, not a table."""
    held = grid.sparkSession.sparkContext.broadcast(data)
    names = [c for c in grid.columns if c != "combo"]

    def each(batches):
        for pdf in batches:
            yield pd.DataFrame([[int(r["combo"]), *run(held.value, **{n: r[n] for n in names})] for r in pdf.to_dict("records")])

    def named(batches):
        for out in each(batches):
            out.columns = cols
            yield out

    cols = ["combo", *[x.split()[0] for x in schema.split(",")]]
    return grid.mapInPandas(named, f"combo long, {schema}")
