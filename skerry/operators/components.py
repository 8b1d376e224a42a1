"""Connected components of an edge table by contraction.

A round hooks each node to the neighbour (or itself) of least place, a hash of its number, draws edges together to those ends and keeps the pointers. A round leaves a
constant share of the edges at most, whatever the shape of the graph; once at most LAST edges are left, one task of bounded memory closes them, and the pointers are followed back.
Least places come from partial sums, so a node with many edges isn't gathered in one task. The same steps run at every size: LAST bounds the last task only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.storage import cut

#: Edges (16 bytes each) that the last task holds.
LAST = 1_000_000
#: Rows in a batch that the last task passes on.
OUT_ROWS = 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and for each the least node of its component."""
    ids = np.sort(np.concatenate([a, b]))  # unique() with the inverse, or by hashes, takes more memory
    apart = np.ones(len(ids), bool)
    apart[1:] = ids[1:] != ids[:-1]
    ids = ids[apart]
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    p = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(p[x], p[y]), np.maximum(p[x], p[y])
        apart = lo != hi
        if not apart.any():
            return ids, ids[p]
        x, y = x[apart], y[apart]
        np.minimum.at(p, hi[apart], lo[apart])
        while (p[p] != p).any():
            p = p[p]


def _close(edges: DataFrame) -> DataFrame:
    """node, root of all edges in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            node, root = forest(a, b)
            for i in range(0, len(node), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + OUT_ROWS]), pa.array(root[i : i + OUT_ROWS])], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str = "a", b: str = "b", last: int = LAST) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node of the component. Nodes are whole numbers."""
    low, high = F.col(a).cast("long"), F.col(b).cast("long")
    e = cut(edges.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).filter("u <> v").distinct())
    hooks = []
    while e.count() > last:
        ways = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        least = e.select(F.inline(ways)).groupBy("u").agg(F.min(place("v")).alias("m"))
        up = cut(least.select(F.col("u").alias("node"), F.least(F.col("m"), place("u"))["n"].alias("root")))
        hooks.append(up)
        ends = e.join(up.withColumnsRenamed({"node": "u", "root": "x"}), "u").join(up.withColumnsRenamed({"node": "v", "root": "y"}), "v")
        e = cut(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct())
    found = _close(e)
    if not hooks:
        return found.withColumnRenamed("root", "component")
    for up in reversed(hooks):  # a root without edges is its own
        far = found.select(F.col("node").alias("root"), F.col("root").alias("far"))
        found = cut(up.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root")))
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
