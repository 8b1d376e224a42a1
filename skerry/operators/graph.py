"""Graphs as edges (src, dst, weight) and nodes (id). Degrees are sums of incoming weights. Iterations go on until they are done; each round's result is checkpointed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import contracts
from skerry.operators import components as contraction
from skerry.operators.ranks import draw, numbered, unit
from skerry.storage import cut

#: Parts of a growing table that are read side by side before they are written as one.
PARTS = 8


def add_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight")).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))


def remove_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst and weight <> 0")


def bidirectional(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Both directions of every edge, once, with weight 1. An edge is drawn together from its lower to its higher end (null comes last) before it is turned, so edges are read, exchanged and held once; by `parts` tasks, if given."""
    a, b = F.col("src"), F.col("dst")
    turn = b.isNotNull() & (a.isNull() | (b < a))
    low, high = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b)
    one = edges.select(low.alias("a"), high.alias("b"))
    one = (one.repartition(parts, "a", "b") if parts else one).distinct()
    there, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    return one.select(F.inline(F.when(F.col("a").eqNullSafe(F.col("b")), F.array(there)).otherwise(F.array(there, back)))).withColumn("weight", F.lit(1.0))


def deterministic(edges: DataFrame, nodes: DataFrame, least: float = 0.5, keep_weight: bool = False, connect: bool = True, both: bool = True) -> DataFrame:
    """Edges of at least `least`, loops added; connect: each row's greatest edge stays as 1 (a row without one leads to node 0); both: symmetric, all weights 1."""
    e = edges.filter("src <> dst")
    if connect:
        top = e.filter("weight > 0").groupBy("src").agg(F.max(F.struct("weight", (-F.col("dst")).alias("d"))).alias("t")).select("src", (-F.col("t.d")).alias("dst"))
        lone = nodes.select(F.col("id").alias("src")).join(top, "src", "left_anti").select("src", F.lit(0).cast(dict(edges.dtypes)["dst"]).alias("dst"))
        forced = top.unionByName(lone).withColumn("weight", F.lit(1.0))
        e = forced.unionByName(e.join(forced, ["src", "dst"], "left_anti").select("src", "dst", F.col("weight").cast("double").alias("weight")))
    e = e.filter(F.col("weight") >= least)
    e = e if keep_weight else e.withColumn("weight", F.lit(1.0))
    e = add_loops(e, nodes)
    return bidirectional(e) if both else e


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and degree of every node."""
    got = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("degree"))
    return nodes.select("id").join(got, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def degree_extremes(edges: DataFrame, nodes: DataFrame, how: str = "max") -> DataFrame:
    """All nodes of the greatest or least degree."""
    contracts.option(how, ("max", "min"), "how")
    d = degrees(edges, nodes)
    return d.join(d.agg((F.max if how == "max" else F.min)("degree").alias("_x")), F.col("degree") == F.col("_x")).select("id", "degree")


def _added(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """parts with a new one; many are written as one, so rows are written again only every PARTS rounds."""
    parts = [*parts, new]
    if len(parts) <= PARTS:
        return parts
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return [cut(whole)]


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, hop and parent (the least one a hop nearer) of all nodes that out-edges reach from the start nodes. A round adds the new frontier to what was seen."""
    front = cut(start.select("id", F.lit(0).alias("hop"), F.lit(None).cast(dict(start.dtypes)["id"]).alias("parent")))
    seen, k = [front], 0
    e = edges.filter("weight <> 0 and src <> dst").select("src", "dst")
    while True:
        k += 1
        near = front.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("_n")).agg(F.min("id").alias("_p"))
        front = cut(near.join(_union(seen).select(F.col("id").alias("_n")), "_n", "left_anti").select(F.col("_n").alias("id"), F.lit(k).alias("hop"), F.col("_p").alias("parent")))
        if front.isEmpty():
            return _union(seen)
        seen = _added(seen, front)


def bfs_path(edges: DataFrame, spark: SparkSession, start: int, end: int) -> list[int]:
    """One path of fewest hops, empty if there is none; the driver follows parents, a row a hop."""
    seen = hops(edges, spark.createDataFrame([(start,)], "id long"))
    at = seen.filter(F.col("id") == end).first()
    out = [end] if at else []
    while at and at["parent"] is not None:
        at = seen.filter(F.col("id") == at["parent"]).first()
        out.append(at["id"])
    return out[::-1]


def components(edges: DataFrame, nodes: DataFrame, last: int = contraction.LAST) -> DataFrame:
    """id and component (its least id), directions aside; a node without edges is its own."""
    found = contraction.components(edges, "src", "dst", last)
    return nodes.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    """Whether out-edges lead from the least node to all."""
    start = nodes.agg(F.min("id").alias("id"))
    return hops(edges, start).count() == nodes.select("id").distinct().count()


def connect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ways between the least nodes of consecutive components; one component remains."""
    comp = numbered(components(edges, nodes).select("component").distinct(), ["component"], "_i")
    follows = comp.select((F.col("_i") - 1).alias("_i"), F.col("component").alias("_next"))
    nxt = comp.join(follows, "_i").drop("_i")
    new = nxt.select(F.col("component").alias("src"), F.col("_next").alias("dst")).union(nxt.select("_next", "component")).withColumn("weight", F.lit(1.0))
    return edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).union(new)


def k_core(edges: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(remaining ids, removed ids with their round): nodes of degree above 0 and below k go, all at once, until there are none. Nodes of degree 0 are in neither."""
    contracts.whole(k, 1, name="k")
    left, gone = cut(edges.filter("weight <> 0").select("src", "dst", "weight")), []
    while True:
        out = cut(left.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("degree")).filter((F.col("degree") > 0) & (F.col("degree") < k)).select("id", F.lit(len(gone)).alias("round")))
        if out.isEmpty():
            rest = left.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("degree")).filter("degree > 0").select("id")
            return rest, _union(gone or [out])
        gone.append(out)
        left = _without(left, out)


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select(F.col("id").alias("_x"))
    return cut(edges.join(ids, F.col("src") == F.col("_x"), "left_anti").join(ids, F.col("dst") == F.col("_x"), "left_anti"))


def core_numbers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and core: the k up to which a node stays; nodes without edges never appear, nor do those that lose all edges in one round without going themselves."""
    left, parts, k = cut(edges.filter("weight <> 0").select("src", "dst", "weight")), [], 1
    while True:
        deg = left.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("degree")).filter("degree > 0")
        low = deg.agg(F.min("degree")).first()[0]
        if low is None:
            return _union(parts or [deg.select("id", F.lit(0).alias("core")).limit(0)])
        k = max(k, int(low) + 1)  # no node goes before k exceeds the least degree
        gone = cut(deg.filter(F.col("degree") < k).select("id", F.lit(k - 1).alias("core")))
        parts = _added(parts, gone)
        left = _without(left, gone)


def ordering(edges: DataFrame, nodes: DataFrame, how: str = "bfs") -> DataFrame:
    """id and place: by hops from the least of the nodes of greatest degree (ties by id), or from the innermost core outwards (ties by degree, then id, descending)."""
    contracts.option(how, ("bfs", "dfs", "k-core"), "how")
    if how == "dfs":
        return dfs(edges, degree_extremes(edges, nodes, "max").agg(F.min("id").alias("id")).first()["id"]).select("id", "place")
    if how == "bfs":
        start = degree_extremes(edges, nodes, "max").agg(F.min("id").alias("id"))
        return numbered(hops(edges, start).select("id", "hop"), ["hop", "id"], "place").select("id", "place")
    d = core_numbers(edges, nodes).join(degrees(edges, nodes), "id")
    return numbered(d, [F.desc("core"), F.desc("degree"), F.desc("id")], "place").select("id", "place")


def dfs(edges: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Visit order and path of a depth-first search: a node is visited when it is stacked, neighbours in ascending order, the last stacked goes on; with an end, the search
    ends when the end comes up. Sequential by nature: the part that the start reaches is handed to one kernel, nothing else."""
    spark = edges.sparkSession
    reach = hops(edges, spark.createDataFrame([(start,)], "id long")).select(F.col("id").alias("src"))
    out = edges.filter("weight <> 0").join(reach, "src", "left_semi").select("src", "dst")
    part = out.unionByName(spark.createDataFrame([(start, start)], "src long, dst long")).withColumn("g", F.lit(0))

    def run(pdf):
        near = {s: sorted(set(g["dst"].tolist())) for s, g in pdf.groupby("src")}
        stack, parent, visited = [start], {start: None}, [start]
        while stack:
            u = stack.pop()
            if u == end:
                break
            for v in near.get(u, []):
                if v not in parent:
                    parent[v] = u
                    visited.append(v)
                    stack.append(v)
        else:
            u = None
        path = set()
        while u is not None:
            path.add(u)
            u = parent[u]
        return pd.DataFrame({"id": visited, "place": range(len(visited)), "on_path": [v in path for v in visited]})

    return part.groupBy("g").applyInPandas(run, "id long, place long, on_path boolean")


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """walk, step and id: walks (walk, id) of `length` nodes, the next neighbour drawn by seed, walk and step, so the same however data is partitioned. A
    node without out-edges raises."""
    contracts.whole(length, 1, name="length")
    e = edges.filter("weight <> 0").select("src", "dst").distinct()
    e = cut(e.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("src"))))
    fan = e.select("src", "_n").distinct()
    at = starts.select("walk", "id")
    out = at.select("walk", F.lit(0).alias("step"), "id")
    for s in range(1, length):
        j = at.join(fan, F.col("id") == F.col("src"), "left").withColumn("_p", F.when(F.col("_n").isNull(), F.raise_error(F.lit("a walk ends at a node without out-edges"))).otherwise(F.pmod(draw(seed, "walk", F.lit(s)), F.col("_n"))))
        at = cut(j.select("walk", F.col("id").alias("src"), F.col("_p").cast("int").alias("_k")).join(e.select("src", "_k", "dst"), ["src", "_k"]).select("walk", F.col("dst").alias("id")))
        out = out.union(at.select("walk", F.lit(s).alias("step"), "id"))
    return out


def _coin(p, seed: int):
    return unit(seed, "src", "dst") < p


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All i < j: the output itself is of that size."""
    return spark.range(n).select(F.col("id").alias("src")).withColumn("dst", F.explode(F.when(F.col("src") < n - 1, F.sequence(F.col("src") + 1, F.lit(n - 1)))))


def _done(e: DataFrame, both: bool) -> DataFrame:
    e = e.select("src", "dst", F.lit(1.0).alias("weight"))
    return bidirectional(e) if both else e


def erdos_renyi(spark: SparkSession, n: int, density: float = 0.5, both: bool = True, seed: int = 0) -> DataFrame:
    contracts.number(density, 0, 1, name="density")
    return _done(_pairs(spark, n).filter(_coin(density, seed)), both)


def stochastic_blocks(spark: SparkSession, n: int, clusters: int, inner: tuple[float, float] = (0.4, 1.0), outer: tuple[float, float] = (0.0, 0.5), both: bool = True, seed: int = 0) -> DataFrame:
    """Each node's block, each pair of blocks' density and each edge are drawn with seed, seed + 1 and seed + 2."""
    block = lambda c: F.pmod(draw(seed, c), F.lit(clusters))
    d = _pairs(spark, n).withColumn("a", F.least(block("src"), block("dst"))).withColumn("b", F.greatest(block("src"), block("dst")))
    p = F.when(F.col("a") == F.col("b"), inner[0] + (inner[1] - inner[0]) * unit(seed + 1, "a", "b")).otherwise(outer[0] + (outer[1] - outer[0]) * unit(seed + 1, "a", "b"))
    return _done(d.filter(_coin(p, seed + 2)), both)


def preferential(spark: SparkSession, n: int, initial: int, both: bool = True, seed: int = 0) -> DataFrame:
    """A clique, then nodes that link in proportion to degrees, at least once each. Each step needs the last: made on the driver."""
    contracts.whole(initial, 2, n, name="initial")
    rng = np.random.default_rng(seed)
    deg, out = np.zeros(n), []
    for i in range(initial):
        for j in range(i + 1, initial):
            out.append((i, j))
    deg[:initial] = initial - 1
    for v in range(initial, n):
        p = deg[:v] / deg[:v].sum()
        near = np.flatnonzero(rng.random(v) < p)
        near = near if len(near) else np.array([rng.choice(v, p=p)])
        out += [(int(u), v) for u in near]
        deg[near] += 1
        deg[v] += len(near)
    return _done(spark.createDataFrame(out, "src long, dst long"), both)


def mesh(spark: SparkSession, layers: list[int], both: bool = True) -> DataFrame:
    """Every node of a layer with every node of the next."""
    start = np.concatenate([[0], np.cumsum(layers)]).tolist()
    rows = [(start[i], start[i + 1] - 1, start[i + 1], start[i + 2] - 1) for i in range(len(layers) - 1)]
    d = spark.createDataFrame(rows or [(0, -1, 0, -1)], "a long, b long, c long, d long").filter("a <= b and c <= d")
    return _done(d.select("c", "d", F.explode(F.sequence("a", "b")).alias("src")).select("src", F.explode(F.sequence("c", "d")).alias("dst")), both)


def random_graph(spark: SparkSession, n: int, both: bool = True, seed: int = 0) -> DataFrame:
    """A fair coin for each pair, and all loops."""
    return add_loops(_done(_pairs(spark, n).filter(_coin(0.5, seed)), both), spark.range(n))


def linear_data(spark: SparkSession, n: int, w: list[float], b: float = 0.0, noise: bool = True, eps: float = 1e-2, seed: int = 0) -> DataFrame:
    """x standard normal, y = x w + b, with normal noise of width eps. Normal numbers are made from pairs of draws by seed, row and place (Box and Muller)."""
    normal = lambda k: F.sqrt(-2 * F.log(1 - unit(seed, "id", F.lit(2 * k)))) * F.cos(2 * math.pi * unit(seed, "id", F.lit(2 * k + 1)))
    d = spark.range(n).withColumn("x", F.array(*[normal(i) for i in range(len(w))]))
    dot = F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, w))), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    return d.withColumn("y", dot + b + (normal(len(w)) * eps if noise else F.lit(0.0)))
