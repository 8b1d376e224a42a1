"""Fluent forms and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.frames import PrefixTemplates, SeriesFrame, Smoother, TDigest
from skerry.operators import learn, sketch, training
from skerry.sources import tables
from skerry.streaming import windows


def test_series_frame(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1.0, 5.0), ("a", 2, 3.0, 5.0), ("a", 4, 5.0, 6.0), ("b", 0, 2.0, 0.0)], "e string, t long, x double, y double")
    f = SeriesFrame.from_table(df, "e", "t")
    assert f.attrs == ["x", "y"] and [r["entity"] for r in f.entities().collect()] == ["a", "b"]
    assert [r["x"] for r in f.entity("a").rows(1, 3).df.orderBy("ts").collect()] == [3, 5]
    assert f.del_attr("y").attrs == ["x"] and f.add_attr("z", F.lit(1.0)).attrs == ["x", "y", "z"]
    assert f.attr(1).columns == f.attr("y").columns
    for bad in (lambda: f.attr(2), lambda: f.attr("q"), lambda: f.del_attr("q"), lambda: tables.one_entity(f.df)):
        with pytest.raises(ValueError):
            bad()
    got = f.entity("a").format_timestamp(1).interpolate("linear").df.orderBy("ts").collect()
    assert [r["x"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["x"] for r in f.entity("a").aggregate_timestamp(4, "sum").df.orderBy("ts").collect()] == [4, 5]
    assert f.standardize().df.count() == 4
    assert {r["x"] for r in f.preprocessing("minmax").entity("a").df.collect()} == {0, 0.5, 1}
    f.write(f"{tmp_path}/s")
    assert SeriesFrame.read(spark, f"{tmp_path}/s").df.count() == 4
    numbered = SeriesFrame.from_table(df.select("e", "x"), "e", None, ["x"]).df.filter("entity = 'a'").orderBy("x").collect()
    assert [r["ts"] for r in numbered] == [0, 1, 2]


def test_estimators(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "e string, t long, x double")
    s = Smoother("moving", size=3)
    s.save(spark, f"{tmp_path}/s")
    assert Smoother.load(spark, f"{tmp_path}/s").fit_transform(df, ["e"], ["t"], "x").filter("t = 9").first()["smoothed"] == 8
    assert Smoother("holt_winters", alpha=0.5, beta=0.5).transform(df, ["e"], ["t"], "x").count() == 10
    d = TDigest().fit(df, ["e"], "x").fit(df.withColumn("x", F.col("x") + 100), ["e"], "x")
    row = d.predict(0, 1).first()
    assert (row["q0"], row["q1"]) == (0, 109) and d.state.first()["total"] == 20
    u = spark.createDataFrame([(f"a/b/{i}",) for i in range(20)], "u string")
    p = PrefixTemplates("/", 0.05).fit(u, "u")
    assert p.transform(u, "u").select("template").distinct().first()[0] == "a/b/*"
    assert [(r["line"], r["n"]) for r in p.describe().collect()] == [("a", 20), ("  b", 20), ("    *", 20)]
    p.save(f"{tmp_path}/p")
    d.save(f"{tmp_path}/d")
    assert PrefixTemplates.load(spark, f"{tmp_path}/p").transform(u, "u").select("template").distinct().first()[0] == "a/b/*"
    assert TDigest.load(spark, f"{tmp_path}/d").predict(0, 0.5, 1).first() == d.predict(0, 0.5, 1).first()
    for bad in (TDigest(), PrefixTemplates("/")):
        with pytest.raises(ValueError):
            bad.save(f"{tmp_path}/none")


def test_frame_access(spark):
    df = spark.createDataFrame([("c", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0), ("d", 5, 6.0)], "e string, t long, x double")
    f = SeriesFrame.from_table(df, "e", "t")  # in the order c, a, b, d
    names = lambda x: sorted({r["entity"] for r in x.df.collect()})
    assert names(f[0]) == ["c"] and names(f["b"]) == ["b"] and names(f[1:3]) == ["a", "b"] and names(f[::2]) == ["b", "c"] and names(f[-1:]) == ["d"] and names(f[::-1]) == ["a", "b", "c", "d"]
    for bad in (4, "z", 1.5, True):
        with pytest.raises(ValueError):
            f[bad]
    one = f["a"].add_attr("y", [7.0, 8.0])
    assert [(r["x"], r["y"]) for r in one.df.orderBy("ts").collect()] == [(2, 7), (3, 8)]
    with pytest.raises(ValueError):
        f["a"].add_attr("y", [1.0])
    with pytest.raises(ValueError):
        f.add_attr("y", [1.0] * 5)
    table = df.select(F.col("e").alias("entity"), F.col("t").alias("ts"), (F.col("x") * 2).alias("value"))
    with pytest.warns(UserWarning):
        twice = f.add_attr("x", table)
    assert twice.df.agg(F.sum("x")).first()[0] == 32 and repr(twice) == "SeriesFrame(entity: string, ts: bigint, x: double)"
    with pytest.raises(ValueError):
        f.add_attr("y", table.limit(2))


def test_sources(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, p string"), spark.createDataFrame([(1, "u"), (2, "v")], "id int, q string")
    assert tables.zipped(a, b).count() == 2
    with pytest.raises(Exception, match="differ in size"):
        tables.zipped(a, b.limit(1)).collect()
    (tmp_path / "c.yaml").write_text("a: [1, 2]")
    assert tables.yaml_config(str(tmp_path / "c.yaml")) == {"a": [1, 2]}
    with pytest.raises(ValueError):
        tables.yaml_config("/nowhere")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "one.png").write_bytes(b"abc")
    (tmp_path / "notes.csv").write_text("one.png,cat\n")
    got = tables.images(spark, str(tmp_path / "img"), str(tmp_path / "notes.csv")).collect()
    assert [(r["label"], bytes(r["content"])) for r in got] == [("cat", b"abc")]
    m = spark.createDataFrame([(0, {"t": {"l": 1.0}}), (1, {"t": {"l": 2.0}})], "step long, metrics map<string,map<string,double>>")
    tables.log_metrics(m, f"{tmp_path}/log", "r", 2)
    assert [(r["name"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [("t/l", 1.0)]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([("a", f"2024-01-01 0{h}:10:00", float(h)) for h in range(6)], "k string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = windows.tumble(stream, ["k"], "ts", "value", "2 hours").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sum"] for r in spark.sql("select * from tumbled").collect()) == [1, 5, 9]
    d = windows.digest_sink(stream, ["k"], "value", f"{tmp_path}/dig", f"{tmp_path}/c2")
    d.processAllAvailable()
    d.stop()
    row = windows.merged_digests(spark.read.parquet(f"{tmp_path}/dig"), ["k"]).first()
    assert (row["min"], row["max"], row["total"]) == (0, 5, 6)


def test_keyed_state(spark, tmp_path):
    """State outlives micro-batches: one file a batch, the same rows as in one go."""
    rows = [("a", h, float((h * 7) % 5), float(h)) for h in range(8)] + [("b", h, 1.0, 1.0) for h in range(3)]
    e = spark.createDataFrame(rows, "k string, t long, x double, y double")
    for part in (e.filter("t < 4"), e.filter("t >= 4")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return sorted(tuple(r) for r in spark.sql(f"select * from {name}").collect())

    got = run(windows.ewma(stream(), ["k"], "t", "x", 0.5), "averaged")
    now, want = {}, []
    for k, t, x, _ in sorted(rows):
        now[k] = x if k not in now else 0.5 * x + 0.5 * now[k]
        want.append((k, t, now[k]))
    assert got == want
    flat = learn.early_stop(e, ["k"], "t", "x", "desc", 2, 1, 0.1).select("k", "t", "lazy", "done").collect()
    assert run(windows.early_stop(stream(), ["k"], "t", "x", "desc", 2, 1, 0.1), "stopped") == sorted(tuple(r) for r in flat)
    sums = training.accumulate(e, ["k"], ["t"], ["x", "y"]).collect()
    assert run(windows.accumulate(stream(), ["k"], "t", ["x", "y"]), "summed") == sorted(tuple(r) for r in sums)


def test_accumulator():
    a = training.Accumulator(["loss", "n"]).add([1.5, 2]).add({"n": 3})
    assert (a.get("loss"), a.get("n")) == (1.5, 5)
    for bad in (lambda: a.add([1]), lambda: a.add({"z": 1}), lambda: a.get("z")):
        with pytest.raises(ValueError):
            bad()


def test_recurrent_layers(spark):
    """Layers, directions and cells against equations written out step by step."""
    rng = np.random.default_rng(4)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def gru(x, h, w):
        n = len(h)
        r = sig(w[0][:n] @ x + w[2][:n] + w[1][:n] @ h + w[3][:n])
        z = sig(w[0][n : 2 * n] @ x + w[2][n : 2 * n] + w[1][n : 2 * n] @ h + w[3][n : 2 * n])
        return (1 - z) * np.tanh(w[0][2 * n :] @ x + w[2][2 * n :] + r * (w[1][2 * n :] @ h + w[3][2 * n :])) + z * h

    weights = lambda i, n, g: [rng.normal(size=(g * n, i)), rng.normal(size=(g * n, n)), rng.normal(size=g * n), rng.normal(size=g * n)]
    xs, layers = rng.normal(size=(5, 3)), [[weights(3, 2, 3), weights(3, 2, 3)], [weights(4, 2, 3)]]
    f, b = [np.zeros(2)], [np.zeros(2)]
    for x in xs:
        f.append(gru(x, f[-1], layers[0][0]))
    for x in xs[::-1]:
        b.append(gru(x, b[-1], layers[0][1]))
    h = np.zeros(2)
    for x, y in zip(f[1:], b[:0:-1], strict=True):
        h = gru(np.concatenate([x, y]), h, layers[1][0])
    d = spark.createDataFrame([(1, xs.tolist())], "id int, x array<array<double>>")
    plain = [[[v.tolist() for v in w] for w in layer] for layer in layers]
    assert np.allclose(training.encode_layers(d, "id", "x", "gru", plain).first()["latent"], h)
    w, x = weights(3, 1, 4), xs[0]
    g = w[0] @ x + w[2] + w[3]
    assert np.allclose(training.run_layers("lstm", xs[:1], [[w]])[1], sig(g[3]) * np.tanh(sig(g[0]) * np.tanh(g[2])))


def test_teacher_forcing(spark):
    d = spark.createDataFrame([(1, [0.1, 0.2], [1, 0, 1])], "id int, z array<double>, y array<int>")
    cell = [[[0.1], [0.2]] * 3, [[0.1, 0.0], [0.0, 0.1]] * 3, [0.0] * 6, [0.0] * 6]
    embed, ow, ob = [[0.5], [1.0]], [[1.0, -1.0], [0.0, 0.5]], [0.0, 0.1]
    got = training.teacher_forced(d, "id", "z", "y", embed, cell, ow, ob).first()
    h, loss, best = np.array([0.1, 0.2]), [], []
    for fed, goal in ((0, 1), (1, 0), (0, 1)):
        h = training.run_layers.__globals__["_cell"]("gru", np.array(embed[fed]), h, h, [np.array(c) for c in cell])[0]
        o = h @ np.array(ow) + np.array(ob)
        loss.append(-np.log(np.exp(o[goal]) / np.exp(o).sum()))
        best.append(int(o.argmax()))
    assert got["loss"] == pytest.approx(np.mean(loss)) and list(got["tokens"]) == best


def test_scale_functions(spark):
    """Every scale keeps the extremes and the count; sharper tails have smaller outer clusters."""
    s = spark.range(20_000).select(F.lit("e").alias("e"), F.col("id").cast("double").alias("x"))
    for name in sketch.SCALES:
        d = sketch.digest(s, ["e"], "x", 1000, 400, name)
        row = d.select("min", "max", "total", sketch.quantile(0.5).alias("q"), F.element_at("clusters", 1)["cnt"].alias("first")).first()
        assert (row["min"], row["max"], row["total"]) == (0, 19_999, 20_000) and abs(row["q"] - 10_000) < 500
        assert row["first"] < (120 if name == "k0" else 20)
    with pytest.raises(ValueError):
        sketch.merge(np.array([1.0, 2.0]), np.array([1, 1]), 57, "none")


def test_decoder(spark):
    d = spark.createDataFrame([(1, [0.1, 0.2])], "id int, z array<double>")
    cell = ([[0.1], [0.2]] * 3, [[0.1, 0.0], [0.0, 0.1]] * 3, [0.0] * 6, [0.0] * 6)
    got = learn.greedy_decode(d, "id", "z", [[0.5], [1.0]], cell, [[1.0, -1.0], [0.0, 0.5]], [0.0, 0.0], 4).first()
    assert len(got["tokens"]) == 4 and set(got["tokens"]) <= {0, 1}
    x = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0], [0.5, -0.5])], "m array<double>, s array<double>, e array<double>")
    assert x.select(learn.reparametrize(F.col("m"), F.col("s"), F.col("e")).alias("z")).first()["z"] == [1.5, 1.5]
