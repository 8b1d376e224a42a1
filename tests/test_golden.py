"""Small cases computed by hand."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import contracts
from skerry.functions import text, time
from skerry.operators import arrays, components, distance, graph, learn, series, sketch, templates, training


def line(spark, xs, ts=None):
    return spark.createDataFrame([("e", t, x) for t, x in zip(ts or range(len(xs)), xs, strict=True)], "e string, t long, x double")


def got(df, col, by="t"):
    return [r[0] if r[0] is None else round(r[0], 4) for r in df.orderBy(by).select(col).collect()]


def test_smoothing(spark):
    assert got(series.moving_average(line(spark, [1.0, 2.0, 3.0, 4.0, 10.0]), ["e"], ["t"], "x", 3), "smoothed") == [1, 1.5, 2, 3, 5.6667]
    assert got(series.moving_average(line(spark, [1.0, 2.0]), ["e"], ["t"], "x", 5), "smoothed") == [1, 1.5]
    assert got(series.weighted_moving_average(line(spark, [1.0, 2.0, 3.0, 4.0]), ["e"], ["t"], "x", 3), "smoothed") == [1, 1.6, 2.3333, 3.3333]
    for block in (1, 2, 128):
        assert got(series.ewma(line(spark, [1.0, 2.0, 3.0]), ["e"], ["t"], "x", 0.3, block=block), "smoothed") == [1, 1.7, 2.61]
    assert series.ewma_last(line(spark, [1.0, 2.0, 3.0]), ["e"], ["t"], "x", 0.3).first()["smoothed"] == pytest.approx(2.61)


def test_next_and_step(spark):
    xs = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    assert series.extend(xs, "x", 1).first()["x"] == [1, 2, 4, 5.5]
    s = spark.createDataFrame([("e", 0.0), ("e", 0.5), ("e", 2.0), ("one", 3.0)], "e string, t double")
    assert {r["e"]: r["step"] for r in series.auto_step(s, ["e"], F.col("t"), 4).collect()} == {"e": 0.5, "one": 0.0}


def test_bins_and_grid(spark):
    s = line(spark, [1.0, 2.0, 3.0, 4.0], [0, 1, 2, 5])
    assert got(series.tumble(s, ["e"], "t", "x", 1, "sum"), "value") == [1, 2, 3, 0, 0, 4]
    assert got(series.tumble(s, ["e"], "t", "x", 1, "mean"), "value") == [1, 2, 3, None, None, 4]
    assert got(series.tumble(s, ["e"], "t", "x", 2, "sum"), "value") == [3, 3, 4]
    assert got(series.regrid(s, ["e"], "t", ["x"], 2), "x") == [1, 3, None]
    with pytest.raises(Exception, match="behind the last"):
        series.tumble(s, ["e"], "t", "x", 1, "sum", start=9).collect()


def test_interpolation(spark):
    s = line(spark, [None, 1.0, None, 3.0, None], [0, 1, 2, 3, 4])
    want = {"linear": [0, 1, 2, 3, 4], "previous": [None, 1, 1, 3, 3], "zero": [1, 1, 1, 3, 3], "next": [1, 1, 3, 3, None], "nearest": [1, 1, 1, 3, 3], "nearest-up": [1, 1, 3, 3, 3]}
    for kind, v in want.items():
        assert got(series.interpolate(s, ["e"], "t", "x", kind), "filled") == v, kind
    t = np.arange(12.0)
    keep = np.array([0, 1, 3, 4, 6, 8, 9, 11])
    for degree in (2, 3):
        y = t**degree - 3 * t + 1
        assert np.allclose(series.spline_values(t[keep], y[keep], t, degree), y)


def test_sessions_and_scaling(spark):
    s = series.gap_sessions(line(spark, [0.0] * 4, [9, 1, 5, 2]), ["e"], ["t"], F.col("t"), 3)
    assert got(s, "session") == [0, 0, 0, 1]
    assert got(series.minmax(line(spark, [2.0, 2.0]), ["e"], ["x"]), "x") == [0, 0]
    z = series.normalize_rows(spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in z] == [(0, 0), (0.6, 0.8)]


def test_kernels():
    rng = np.random.default_rng(1)
    x = rng.random(60)
    assert len(series.spectral_residual(x, 3, 5)) == len(series.arima(x)) == len(series.fit_holt_winters(x, True, 7)) == 60
    ramp = np.arange(30.0)
    assert np.allclose(series.arima(ramp, (0, 1, 0)), ramp + 1)
    assert np.allclose(series.holt_winters(ramp, 0.5, 0.5)[-9:], ramp[-9:] + 1, atol=0.01)


def test_distances(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 2.0)], "g int, i int, x double, y double")
    assert distance.dtw(p, ["g"], "i", ["x"], ["y"]).first()["distance"] == 2
    assert distance.dtw(p, ["g"], "i", ["x"], ["y"], weighted=False).first()["distance"] == 1
    assert distance.lb_kim(p, ["g"], "i", "x", "y").first()["bound"] == 1
    assert distance.lb_keogh(p, ["g"], "i", "x", "y", 1).first()["bound"] == 1
    q = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 0.0, 1.0)], "g int, i int, x double, y double")
    assert distance.sbd(q, ["g"], "i", "x", "y").first()["distance"] == 0
    assert distance.sbd(q, ["g"], "i", "x", "y", shifting=False).first()["distance"] == 1
    r = spark.createDataFrame([(1, [0.0, 0.0], [0.0, 0.0]), (1, [3.0, 4.0], [0.0, 0.0])], "g int, x array<double>, y array<double>")
    assert distance.lp_norm(r, ["g"], "x", "y").first()["distance"] == 2.5
    m = distance.moments(spark.createDataFrame([("x", 0.0), ("x", 1.0), ("y", 0.0), ("y", 2.0), ("one", 1.0)], "k string, v double"), ["k"], "v")
    v = {a["k"]: a for a in m.collect()}
    assert v["x"]["variance"] == pytest.approx(0.628929, abs=1e-6) and v["y"]["variance"] == pytest.approx(2.515717, abs=1e-6) and v["one"]["variance"] is None


def test_dtw_by_table():
    rng = np.random.default_rng(0)
    for f, weighted in ((2.0, True), (1.0, False)):
        a, b = rng.random((9, 2)), rng.random((7, 2))
        d = np.full((9, 7), np.inf)
        for i in range(9):
            for j in range(7):
                w = np.linalg.norm(a[i] - b[j])
                d[i, j] = w if i == j == 0 else min([d[i - 1, j] + w] * (i > 0) + [d[i, j - 1] + w] * (j > 0) + [d[i - 1, j - 1] + f * w] * (i > 0 and j > 0))
        assert distance.dtw_value(a, b, weighted) == pytest.approx(d[-1, -1])


def test_digest(spark):
    s = spark.createDataFrame([("e", float(v)) for v in (1, 2, 3, 4)], "e string, x double").coalesce(1)
    d = sketch.digest(s, ["e"], "x")
    q = d.select(*[sketch.quantile(x).alias(str(i)) for i, x in enumerate((0, 0.1, 0.5, 0.6, 1))]).first()
    assert [round(v, 6) for v in q] == [1, 1, 2, 2.4, 4]


def graph_of(spark, pairs, n):
    e = graph.bidirectional(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double"))
    return e, spark.range(n)


def test_graph(spark):
    e, n = graph_of(spark, [(0, 1), (1, 2), (0, 2), (0, 3)], 5)  # a triangle, a pendant, a lone node
    assert {r["id"]: r["core"] for r in graph.core_numbers(e, n).collect()} == {0: 2, 1: 2, 2: 2, 3: 1}
    rest, gone = graph.k_core(e, n, 2)
    assert sorted(r["id"] for r in rest.collect()) == [0, 1, 2] and [r["id"] for r in gone.collect()] == [3]
    assert [r["id"] for r in graph.degree_extremes(e, n, "max").collect()] == [0]
    assert [r["id"] for r in graph.degree_extremes(e, n, "min").collect()] == [4]
    assert {r["id"]: r["component"] for r in graph.components(e, n).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert not graph.is_connected(e, n) and graph.is_connected(graph.connect(e, n), n)
    assert graph.bfs_path(e, spark, 2, 3) == [2, 0, 3] and graph.bfs_path(e, spark, 0, 4) == []
    assert [(r["id"], r["on_path"]) for r in graph.dfs(e, 0, 2).orderBy("place").collect()] == [(0, True), (1, False), (2, True), (3, False)]
    deep, _ = graph_of(spark, [(0, 1), (0, 2), (1, 3), (2, 4), (4, 5)], 6)
    assert [r["id"] for r in graph.dfs(deep, 0).orderBy("place").collect()] == [0, 1, 2, 4, 5, 3] and graph.dfs(e, 4).count() == 1
    chain, ids = graph_of(spark, [(i, i + 1) for i in range(40)], 42)
    for last in (1000, 3):
        assert {r["id"]: r["component"] for r in graph.components(chain, ids, last).collect()} == {i: 0 if i < 41 else 41 for i in range(42)}
    assert graph.hops(chain, spark.createDataFrame([(0,)], "id long")).agg(F.max("hop")).first()[0] == 40
    assert graph.erdos_renyi(spark, 5, 0.0).count() == 0
    assert sorted(map(tuple, graph.mesh(spark, [2, 1]).select("src", "dst").collect())) == [(0, 2), (1, 2), (2, 0), (2, 1)]
    with pytest.raises(Exception, match="without out-edges"):
        graph.random_walks(spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double"), spark.createDataFrame([(0, 0)], "walk long, id long"), 3).collect()


def test_components_by_contraction(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(50)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(200, 201 + i) for i in range(30)]
    root = list(range(300))
    for a, b in pairs * 60:
        root[a] = root[b] = min(root[a], root[b])
    for last in (1000, 5, 0):
        rows = components.components(spark.createDataFrame(pairs, "a long, b long"), last=last).collect()
        assert {x["node"]: x["component"] for x in rows} == {i: root[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
        assert len(rows) == len({x["node"] for x in rows})


def test_templates(spark):
    u = spark.createDataFrame([(f"www.test.com/samples/{i}",) for i in range(100)], "u string")
    assert {r["template"] for r in templates.prefix_templates(u, "u", "/", 0.01).collect()} == {"www.test.com/samples/*"}
    assert templates.prefix_templates(u, "u", "/", 1 / 101).select("template").distinct().count() == 100
    assert {r["template"] for r in templates.layer_templates(u, "u", "/", 100).collect()} == {"www.test.com/samples/*"}
    assert templates.layer_templates(u, "u", "/", 101).select("template").distinct().count() == 100
    made = templates.prefix_templates(u, "u", "/", 0.01)
    new = spark.createDataFrame([("www.test.com/samples/new",), ("other",)], "u string")
    assert {r["u"]: r["template"] for r in templates.apply_templates(new, "u", made, "/").collect()} == {"www.test.com/samples/new": "www.test.com/samples/*", "other": "invalid"}
    with pytest.raises(ValueError):
        text.tokens(F.col("u"), "")


def test_arrays(spark):
    d = spark.createDataFrame([([0, 1, 1],)], "x array<int>")
    assert d.select(arrays.replace_in_array("x", [0, 1], [1, 0]).alias("x")).first()["x"] == [1, 0, 0]
    votes = spark.createDataFrame([(0, 7, 0), (1, 7, 1)], "source int, sample int, label int")
    assert arrays.hard_vote(votes).first()["label"] == 0
    g = arrays.kwargs_grid(spark, {"a": [1, 2], "b": ["x", "y"]}).orderBy("combo").collect()
    assert [(r["a"], r["b"]) for r in g] == [(1, "x"), (1, "y"), (2, "x"), (2, "y")] == [tuple(k.values()) for k in arrays.kwargs_list({"a": [1, 2], "b": ["x", "y"]})]
    rng = np.random.default_rng(3)
    from itertools import permutations

    for _ in range(5):
        c = rng.random((5, 5))
        assert c[np.arange(5), arrays.assign(c)].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(5)) for p in permutations(range(5))))
    a = rng.random((8, 8))
    a = a + a.T
    t = rng.permutation(8)
    for method in ("unary", "yaaq", "pairwise"):
        found = arrays.match_graphs(a, a[t][:, t], method)
        assert sorted(found) == list(range(8))
        if method == "unary":
            assert list(found) == list(t)


def test_learning(spark):
    m = spark.createDataFrame([("r", i, v) for i, v in enumerate([3.0, 2.0, 5.0, 5.0, 5.0])], "k string, step long, m double")
    s = learn.early_stop(m, ["k"], "step", "m", "desc", 0, 1, 0.0).orderBy("step").collect()
    assert [r["lazy"] for r in s] == [-1, -1, 0, 1, 2] and [r["done"] for r in s] == [False, False, False, True, True]
    flat = spark.createDataFrame([("r", i, 1.0) for i in range(30)], "k string, step long, m double")  # within the tolerance: never done
    assert not learn.early_stop(flat, ["k"], "step", "m").filter("done").count()
    worse = spark.createDataFrame([("r", i, float(-i)) for i in range(30)], "k string, step long, m double")
    assert [r["step"] for r in learn.early_stop(worse, ["k"], "step", "m", "asc").filter("done").orderBy("step").collect()] == list(range(20, 30))
    f = learn.folds(spark.range(10), ["id"], 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [4, 3, 3]
    k = training.mask_rows(spark.range(5).withColumn("g", F.lit(1)).withColumn("x", F.lit(1.0)), ["g"], "id", ["x"], 0.0)
    assert k.filter("masked").count() == 1


def test_text_and_time(spark):
    d = spark.createDataFrame([("a[DATE+1]-[DATE]-[DATE-1]",)], "s string").withColumn("b", F.to_date(F.lit("2024-02-28")))
    assert d.select(time.real_date(F.col("s"), F.col("b")).alias("x")).first()["x"] == "a20240229-20240228-20240227"
    t = spark.createDataFrame([(1600000000, 1600000000000, 1600000000000000)], "s long, ms long, us long")
    assert [r for r in t.select(*[time.epoch_seconds(F.col(c), "auto") for c in t.columns]).first()] == [1.6e9] * 3
    assert text.resolve("Moving_average", {"movingAverage": 1}) == 1
    for bad in (lambda: text.resolve("x", {}), lambda: contracts.whole(1.5), lambda: contracts.number(2, upper=2, upper_inclusive=False), lambda: contracts.option("a", ["b"]), lambda: text.conditions({"x": {"type": "eq", "value": 1}})):
        with pytest.raises(ValueError):
            bad()


def test_plans_stay_in_the_jvm(spark):
    s = line(spark, [1.0, 2.0])
    for df in (series.moving_average(s, ["e"], ["t"], "x", 3), series.tumble(s, ["e"], "t", "x", 1), series.interpolate(s, ["e"], "t", "x"), series.ewma(s, ["e"], ["t"], "x", 0.5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_both_directions_by_one_exchange(spark):
    pairs = [(1, 2), (2, 1), (3, 3), (None, 4), (4, None), (None, None), (2, 9), (2, 9)]
    e = spark.createDataFrame(pairs, "src int, dst long")
    for parts in (None, 3):
        both = graph.bidirectional(e, parts)
        assert sorted(map(str, both.collect())) == sorted(f"Row(src={a}, dst={b}, weight=1.0)" for a, b in {*pairs, *((b, a) for a, b in pairs)})
        plan = both._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate") == 1 and "Union" not in plan


def test_tasks_by_rows(spark):
    from skerry.plans import graph_queries as plans

    assert plans._parts(spark, 4 * plans.TASK_ROWS) is None and plans._parts(spark, 360 * 600_000) == 432


def test_exact_quantiles(spark):
    """Spark's own, which holds all values of a group in one task, on repeated, null and lone values."""
    r = random.Random(1)
    rows = [(k, r.choice([None, r.randrange(5) / 2, r.random()])) for k in ("a", "b", None) for _ in range(100)] + [("z", None), ("one", 3.0)]
    d, at = spark.createDataFrame(rows, "k string, v double"), [0, 0.1, 0.25, 0.5, 0.77, 1]
    q = F.percentile("v", F.array(*[F.lit(float(x)) for x in at]))
    for keys in (["k"], []):
        mine = {tuple(x[k] for k in keys): (x["min"], x["max"], x["total"], x["q"]) for x in sketch.exact_quantiles(d, keys, "v", at).collect()}
        want = {tuple(x[k] for k in keys): (x["a"], x["z"], x["n"], x["q"] or [None] * len(at)) for x in d.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("v").alias("n"), q.alias("q")).collect()}
        assert mine == want
    plan = sketch.exact_quantiles(d, ["k"], "v", at)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def merged_in_order(edges, threshold, wild="*"):
    """The rule of merge_layers, start by start."""
    out, into = defaultdict(set), defaultdict(set)
    for layer, a, b in edges:
        out[layer, a].add(b)
        into[layer + 1, b].add(a)
    for layer in range(max((e[0] for e in edges), default=-1)):
        for start in sorted(a for k, a in list(out) if k == layer):
            ends = defaultdict(set)
            for mid in out[layer, start]:
                for end in out.get((layer + 1, mid), ()):
                    ends[end].add(mid)
            good = {e: m for e, m in ends.items() if len(m) >= threshold}
            if not good:
                continue
            mids = set().union(*good.values())
            for mid in mids - {wild}:
                alone = into[layer + 1, mid] == {start}
                if out[layer + 1, mid] <= set(good):
                    out[layer, start].discard(mid)
                    into[layer + 1, mid].discard(start)
                if alone:
                    for end in [e for e in good if mid in good[e]]:
                        out[layer + 1, mid].discard(end)
                        into[layer + 2, end].discard(mid)
            for end in good:
                out[layer, start].add(wild)
                into[layer + 1, wild].add(start)
                out[layer + 1, wild].add(end)
                into[layer + 2, end].add(wild)
    return {(layer, a, b) for (layer, a), bs in out.items() for b in bs}


def test_layers_merge_by_joins(spark):
    r = random.Random(5)
    for run, (threshold, n, tokens) in enumerate([(2, 30, "abcd*"), (2, 40, "abcdefgh"), (3, 60, "abcde*")]):
        texts = {"/".join(r.choice(tokens) if r.random() < 0.97 else "<END>" for _ in range(r.randint(1, 4))) for _ in range(n)}
        d = spark.createDataFrame([(x,) for x in texts], "u string")
        edges = templates.layer_edges(d, "u", "/")
        want = merged_in_order([tuple(x) for x in edges.collect()], threshold)
        merged = templates.merge_layers(edges, threshold)
        assert sorted(map(tuple, merged.collect())) == sorted(want), run


def test_layers_and_digests_have_no_large_task(spark):
    from skerry import catalog

    plan = catalog.QUERIES["tmpl_layer_templates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and not hasattr(templates, "defaultdict")
    assert "percentile" not in catalog.QUERIES["stat_tdigest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
