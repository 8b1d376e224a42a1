"""Queries over arrays, matrices, votes, grids, learning data and time, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import text as text_fns
from skerry.functions import time as time_fns
from skerry.operators import arrays, learn, training
from skerry.sources.tables import flatten_metrics, sequences, table
from skerry.streaming import windows


def vec_replace(spark, d):
    return table(spark, d, "lineitem").groupBy(arrays.replace_values("l_returnflag", ["A", "N", "R"], ["N", "A", "X"]).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def _counts(spark, d):
    """Priority (0 to 4) by status (0 to 2) counts as a matrix."""
    o = table(spark, d, "orders")
    i, j = F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.groupBy(i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


_COUNTS = "m as (select cast(substr(o_orderpriority, 1, 1) as integer) - 1 as i, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as j, count(*)::double as v from orders group by 1, 2)"


def vec_permute(spark, d):
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 4), (4, 3)], "new int, old int")
    return arrays.permute(_counts(spark, d), order)


def vec_padding(spark, d):
    s = sequences(table(spark, d, "conversations").withColumn("n", F.length("text").cast("long")), "conv_id", ["turn"], "n").withColumn("batch", F.floor(F.col("conv_id") / 10))
    return arrays.pad(s, "x", ["batch"]).select("conv_id", F.col("length").cast("long").alias("length"), F.size("padded").cast("long").alias("padded_length"), F.aggregate("padded", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def vec_cost_matrix(spark, d):
    m = _counts(spark, d)
    return arrays.cost_matrix(m, m)


def vec_assign(spark, d):
    """A matrix against its own permutation: row sums find it again where they differ."""
    m = _counts(spark, d)
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 4), (4, 3)], "new int, old int")
    n = spark.range(5).select(F.explode(F.array(F.col("id").cast("int"))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    square = n.join(m, ["i", "j"], "left").select("i", "j", (F.coalesce("v", F.lit(0.0)) * (F.col("i") + 1)).alias("v"))  # rows of different sums
    b = arrays.permute(square, order).withColumnRenamed("v", "b")
    t = arrays.match_pairs(square.withColumnRenamed("v", "a").join(b, ["i", "j"]).withColumn("g", F.lit(0)), ["g"], "unary")
    return t.select("i", "t")


def vec_match(spark, d):
    """A symmetric matrix of draws against itself in another order, which has to be found."""
    n = spark.range(8).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    a = n.withColumn("a", F.pmod(F.least("i", "j") * 37 + F.greatest("i", "j") * 101 + F.col("i") * F.col("j") * 13, F.lit(97)) / 97.0)
    order = spark.createDataFrame([(k, (k * 3 + 2) % 8) for k in range(8)], "new int, old int")
    b = arrays.permute(a.withColumnRenamed("a", "v"), order).withColumnRenamed("v", "b")
    return arrays.match_pairs(a.join(b, ["i", "j"]).withColumn("g", F.lit(0)), ["g"], "unary").select("i", "t")


def _scores(spark, d):
    """Three rules' probabilities of two classes for each order."""
    o = table(spark, d, "orders")
    p = [F.pmod("o_orderkey", F.lit(7)) / 7.0, F.pmod("o_custkey", F.lit(5)) / 5.0, F.when(F.col("o_totalprice") > 1000, 0.75).otherwise(0.25)]
    return o.select(F.col("o_orderkey").alias("sample"), F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(c).alias("class"), (x if c else 1 - x).alias("prob")) for s, x in enumerate(p) for c in (0, 1)])).alias("q")).select("sample", "q.*")


_SCORES = "p as (select o_orderkey as sample, s as source, case s when 0 then o_orderkey % 7 / 7.0::double when 1 then o_custkey % 5 / 5.0::double else case when o_totalprice > 1000 then 0.75::double else 0.25::double end end as p from orders, range(3) t(s))"


def ens_soft_vote(spark, d):
    return arrays.soft_vote(_scores(spark, d)).select("sample", F.col("label").cast("int").alias("label"), F.round("prob", 6).alias("prob"))


def ens_hard_vote(spark, d):
    return arrays.hard_vote(arrays.argmax_labels(_scores(spark, d))).select("sample", F.col("label").cast("int").alias("label"), "votes")


def tune_kwargs_grid(spark, d):
    return arrays.kwargs_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]})


def _runs(spark, d):
    """k and a cost that falls fast, then slowly: squared distance of prices to k equal steps."""
    p = table(spark, d, "part")
    return p.select(F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"), "p_retailprice").groupBy("k").agg(F.sum(F.pow(F.pmod("p_retailprice", F.lit(1200.0) / F.col("k")), F.lit(2.0))).alias("cost"))


_RUNS = "r as (select k, sum(pow(fmod(p_retailprice, 1200.0::double / k), 2)) as cost from part, range(1, 11) t(k) group by 1)"


def tune_global_min(spark, d):
    return arrays.choose(_runs(spark, d), "k", "cost", "global_min").select(F.col("k").cast("long").alias("k"))


def tune_local_extrema(spark, d):
    return arrays.choose(_runs(spark, d), "k", "cost", "local_min").select(F.col("k").cast("long").alias("k"))


def tune_elbow(spark, d):
    return arrays.elbow(_runs(spark, d), "k", "cost").select(F.col("k").cast("long").alias("k"))


def tune_run(spark, d):
    data = [r[0] for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    grid = arrays.kwargs_grid(spark, {"power": [1, 2], "scale": [1, 10]})
    return arrays.run_algorithm(grid, data, lambda x, power, scale: [float(sum(v**power for v in x) * scale)], "score double")


def learn_kl_std_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda m, s: learn.kl_std_norm(m.cast("double"), s.cast("double")))).alias("kl"))
    return e.agg(F.round(F.sum("kl") / F.countDistinct("vec_id"), 6).alias("loss"))


def learn_inner_product(spark, d):
    e = table(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(learn.inner_product(F.col("embedding"), F.col("other")), 6).alias("prob"))


def learn_graph_recon(spark, d):
    p = learn_inner_product(spark, d)
    return learn.graph_recon(p.filter("vec_id % 2 = 0"), p.filter("vec_id % 2 = 1")).select(F.round("loss", 4).alias("loss"))


def learn_seq_nll(spark, d):
    o = table(spark, d, "orders").select(F.array(*[F.log((1.0 + F.pmod("o_orderkey", F.lit(k + 2))) / 10) for k in range(3)]).alias("logp"), F.pmod("o_custkey", F.lit(3)).cast("int").alias("y"))
    return learn.sequence_nll(o, "logp", "y").select(F.round("loss", 6).alias("loss"))


def learn_weighted_loss(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n"))
    return learn.weighted_loss(li, ["l_returnflag"]).select("l_returnflag", F.round("loss", 6).alias("loss"))


def learn_reduction(spark, d):
    return learn.reduced(table(spark, d, "part").select(F.col("p_retailprice").alias("loss")), "loss", "mean").select(F.round("loss", 4).alias("loss"))


def learn_kfold(spark, d):
    return learn.folds(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


def learn_early_stop(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.floor(time_fns.micros("ts") / 86_400_000_000).alias("day")).agg(F.avg("value").alias("m"))
    return learn.early_stop(e, ["event_type"], "day", "m", "desc", 5, 1, 0.5).select("event_type", "day", F.col("lazy").cast("long").alias("lazy"), "done")


def learn_gnn_mean(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_regionkey").cast("double"), F.lit(1.0)).alias("x"))
    e = spark.range(25).select(F.col("id").alias("src"), F.pmod(F.col("id") * 3 + 1, F.lit(25)).alias("dst"))
    return learn.message_mean(e, n, "mean").select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


def learn_gcn(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_regionkey").cast("double"), F.lit(1.0)).alias("x"))
    e = spark.range(25).select(F.col("id").alias("src"), F.pmod(F.col("id") * 3 + 1, F.lit(25)).alias("dst"))
    return learn.message_mean(e, n, "gcn").select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


def learn_gin(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_regionkey").cast("double"), F.lit(1.0)).alias("x"))
    e = spark.range(50).select(F.pmod(F.col("id"), F.lit(25)).alias("src"), F.pmod(F.col("id") * 7 + 2, F.lit(25)).alias("dst"))
    return learn.gin(e, n, 0.5).select("id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"))


def learn_gat(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_regionkey").cast("double"), F.lit(1.0)).alias("x"))
    e = spark.range(50).select(F.pmod(F.col("id"), F.lit(25)).alias("src"), F.pmod(F.col("id") * 7 + F.col("id") % 3, F.lit(25)).alias("dst"))
    return learn.gat(e, n, [[1.0], [0.5]], [0.3], [-0.2]).select("id", F.round(F.col("x")[0], 6).alias("x0"))


def learn_autoencoder(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("x"))
    z, y = learn.autoencode(F.col("x"), [([[0.5], [1.5]], [0.1])], [([[1.0, -0.5]], [0.2, 0.3])])
    return p.select("p_partkey", F.round(z[0], 6).alias("z"), F.round(learn.squared_error(F.col("x"), y), 12).alias("loss"))


def learn_mlp(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("x"))
    w = [([[0.5, -1.0], [1.5, 0.25]], [0.1, 0.2]), ([[1.0], [-2.0]], [0.5])]
    return p.select("p_partkey", F.round(learn.mlp(F.col("x"), w)[0], 6).alias("y"))


def learn_encode(spark, d):
    """A long short-term memory of one state over the lengths of each conversation's turns."""
    s = sequences(table(spark, d, "conversations").withColumn("n", F.array(F.length("text") / 100.0)), "conv_id", ["turn"], "n")
    w = [[[0.1], [0.2], [0.3], [-0.1]], [[0.1], [0.2], [0.3], [0.4]], [0.0, 0.1, 0.2, 0.05], [0.0, 0.0, 0.0, 0.1]]
    return training.encode_layers(s, "conv_id", "x", "lstm", [[w]]).select("conv_id", F.round(F.col("latent")[0], 6).alias("h"))


def learn_mask(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.lit(1.0).alias("x"))
    return training.mask_rows(n, ["n_regionkey"], "n_nationkey", ["x"], 0.0).groupBy("n_regionkey").agg(F.count_if("masked").alias("masked"), F.sum("x").alias("x"))


def time_convert(spark, d):
    s = table(spark, d, "events").select("event_id", F.floor(time_fns.micros("ts") / 1000).alias("ms"))
    z = time_fns.to_zone(F.col("ms"), unit="ms")
    return s.select("event_id", z.alias("wall"), time_fns.from_zone(z).alias("epoch"))


def time_auto_unit(spark, d):
    s = table(spark, d, "events").select("event_id", F.floor(time_fns.micros("ts") / F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 1000).otherwise(1_000_000)).alias("t"))
    return s.select("event_id", F.round(time_fns.epoch_seconds(F.col("t"), "auto"), 6).alias("epoch"))


def time_date_template(spark, d):
    t = table(spark, d, "events").select("event_id", F.concat(F.lit("a[DATE]b[DATE+"), F.col("event_id") % 9, F.lit("]c[DATE-3]")).alias("s"), F.to_date("ts").alias("base"))
    return t.select("event_id", time_fns.real_date(F.col("s"), F.col("base")).alias("s"))


def time_conditions(spark, d):
    return table(spark, d, "events").filter(text_fns.all_of({"value": {"type": "gte", "value": 20.0}, "user_id": {"type": "lt", "value": 100}})).select("event_id")


def text_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text_fns.normalized(F.concat("p_brand", F.lit(" _-"), "p_type")).alias("name"))


def viz_first_appearance_palette(spark, d):
    e = table(spark, d, "events").withColumn("pos", time_fns.micros("ts"))
    return learn.palette(e, "event_type", "pos", ["#ff0000", "#00ff00", "#0000ff"]).select("event_type", F.col("rank").cast("long").alias("rank"), "color")


def viz_rgb(spark, d):
    c = spark.createDataFrame([(1, "#ff8000"), (2, "#00ff40")], "id int, c string")
    x = text_fns.rgb(F.col("c"))
    return c.select("id", F.round(x[0], 6).alias("r"), F.round(x[1], 6).alias("g"), F.round(x[2], 6).alias("b"))


def metrics_flatten(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 1000).alias("step")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    m = e.select("step", F.create_map(F.col("event_type"), F.create_map(F.lit("sum"), F.col("s"), F.lit("n"), F.col("n"))).alias("metrics"))
    return flatten_metrics(m).select("step", "name", F.round("value", 6).alias("value"))


def stream_tumble(spark, d):
    """The streaming operator on a bounded input: hourly windows by type."""
    e = table(spark, d, "events")
    return windows.tumble(e, ["event_type"], "ts", "value", "1 hour").select("event_type", "start", F.round("sum", 6).alias("sum"), F.round("mean", 6).alias("mean"), "n")


def stream_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), ["user_id"], "ts", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


_FNS = [vec_replace, vec_permute, vec_padding, vec_cost_matrix, vec_assign, vec_match, ens_soft_vote, ens_hard_vote, tune_kwargs_grid, tune_global_min, tune_local_extrema, tune_elbow, tune_run, learn_kl_std_norm, learn_inner_product, learn_graph_recon, learn_seq_nll, learn_weighted_loss, learn_reduction, learn_kfold, learn_early_stop, learn_gnn_mean, learn_gcn, learn_gin, learn_gat, learn_autoencoder, learn_mlp, learn_encode, learn_mask, time_convert, time_auto_unit, time_date_template, time_conditions, text_normalize, viz_first_appearance_palette, viz_rgb, metrics_flatten, stream_tumble, stream_sessions]
QUERIES = {f.__name__: f for f in _FNS}

_ORDER = "o(new, old) as (values (0, 2), (1, 0), (2, 1), (3, 4), (4, 3))"
_IP = "ip as (select a.vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)))), 6) as prob from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
_X = "ext as (select *, coalesce(lag(v) over (order by k), v) as a, coalesce(lead(v) over (order by k), v) as b from q)"
ORACLE = {
    "vec_replace": "select case l_returnflag when 'A' then 'N' when 'N' then 'A' when 'R' then 'X' else l_returnflag end as flag, count(*) as n from lineitem group by 1",
    "vec_permute": f"with {_COUNTS}, {_ORDER} select a.new as i, b.new as j, v from m join o a on a.old = m.i join o b on b.old = m.j",
    "vec_padding": "with s as (select conv_id, count(*) as n, sum(length(text)) as t from conversations group by 1) select conv_id, n as length, max(n) over (partition by conv_id // 10) as padded_length, cast(t as bigint) as total from s",
    "vec_cost_matrix": f"with {_COUNTS}, r as (select i, sum(v) as x from m group by 1) select a.i, b.i as j, abs(a.x - b.x) as cost from r a, r b",
    "vec_match": "select cast(i as bigint) as i, cast((i * 3 + 2) % 8 as bigint) as t from range(8) t(i)",
    "vec_assign": f"with {_ORDER} select cast(new as bigint) as i, cast(old as bigint) as t from o",
    "ens_soft_vote": f"with {_SCORES}, m as (select sample, avg(p) as one, avg(1 - p) as nil from p group by 1) select sample, cast(case when one > nil then 1 else 0 end as integer) as label, round(greatest(one, nil), 6) as prob from m",
    "ens_hard_vote": f"with {_SCORES}, l as (select sample, case when p > 1 - p then 1 else 0 end as l from p), v as (select sample, l, count(*)::double as n from l group by 1, 2) select sample, cast(arg_max(l, struct_pack(n := n, l := -l)) as integer) as label, max(n) as votes from v group by 1",
    "tune_kwargs_grid": "select cast((a - 1) * 3 + p as bigint) as combo, cast(a as integer) as a, b from range(1, 3) t(a), (values (0, 'x'), (1, 'y'), (2, 'z')) u(p, b)",
    "tune_global_min": f"with {_RUNS} select k from r order by cost, k limit 1",
    "tune_local_extrema": f"with {_RUNS}, q as (select k, cost as v from r), {_X} select k from ext where v <= a and v <= b",
    "tune_elbow": f"with {_RUNS}, q as (select k, (cost - min(cost) over ()) / (max(cost) over () - min(cost) over ()) - (1 - (row_number() over (order by k) - 1) / 9.0::double) as v from r), {_X} select k from ext where v <= a and v <= b",
    "tune_run": "select cast((p - 1) * 2 + s as bigint) as combo, sum(pow(n_nationkey, p)) * case s when 0 then 1 else 10 end as score from nation, range(1, 3) t(p), range(2) u(s) group by p, s",
    "learn_kl_std_norm": "with e as (select vec_id, unnest(list_transform(range(1, 33), lambda i: -0.5::double * (1 + 2 * embedding[i + 32]::double - embedding[i]::double * embedding[i]::double - exp(2 * embedding[i + 32]::double)))) as kl from embeddings) select round(sum(kl) / count(distinct vec_id), 6) as loss from e",
    "learn_inner_product": f"with {_IP} select vec_id, prob from ip",
    "learn_graph_recon": f"with {_IP} select round((select avg(-ln(prob + 1e-16::double)) from ip where vec_id % 2 = 0) + (select avg(-ln(1 - prob + 1e-16::double)) from ip where vec_id % 2 = 1), 4) as loss",
    "learn_seq_nll": "select round(avg(-ln((1.0::double + o_orderkey % (o_custkey % 3 + 2)) / 10)), 6) as loss from orders",
    "learn_weighted_loss": "select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as loss from lineitem group by 1",
    "learn_reduction": "select round(avg(p_retailprice), 4) as loss from part",
    "learn_kfold": "select o_orderkey, cast(ntile(7) over (order by o_orderkey) - 1 as bigint) as fold from orders",
    "learn_early_stop": """with recursive m as (select event_type, cast(floor(epoch_us(ts) / 86400000000) as bigint) as day, avg(value) as m from events group by 1, 2), o as (select *, row_number() over (partition by event_type order by day) as n from m),
r(event_type, n, day, best, lazy) as (select event_type, n, day, m, -1 from o where n = 1 union all select o.event_type, o.n, o.day, least(r.best, o.m), case when o.m < r.best + 0.5::double then -1 else r.lazy + 1 end from r join o on o.event_type = r.event_type and o.n = r.n + 1)
select event_type, day, cast(lazy as bigint) as lazy, lazy >= 1 and n > 5 as done from r""",
    "learn_gnn_mean": "with e as (select i as src, (i * 3 + 1) % 25 as dst from range(25) t(i)) select n.n_nationkey::bigint as id, coalesce(avg(s.n_regionkey::double), 0) as x0, coalesce(avg(case when s.n_nationkey is not null then 1.0::double end), 0) as x1 from nation n left join e on e.dst = n.n_nationkey left join nation s on s.n_nationkey = e.src group by 1",
    "learn_gcn": "with e as (select i as src, (i * 3 + 1) % 25 as dst from range(25) t(i)) select n.n_nationkey::bigint as id, s.n_regionkey::double as x0, 1.0::double as x1 from nation n join e on e.dst = n.n_nationkey join nation s on s.n_nationkey = e.src",
    "learn_gin": "with e as (select i % 25 as src, (i * 7 + 2) % 25 as dst from range(50) t(i)) select n.n_nationkey::bigint as id, round(1.5::double * n.n_regionkey + coalesce(sum(s.n_regionkey::double), 0), 6) as x0, round(1.5::double + count(s.n_nationkey), 6) as x1 from nation n left join e on e.dst = n.n_nationkey left join nation s on s.n_nationkey = e.src group by n.n_nationkey, n.n_regionkey",
    "learn_gat": "with e as (select i % 25 as src, (i * 7 + i % 3) % 25 as dst from range(50) t(i)), h as (select n_nationkey as id, n_regionkey + 0.5::double as h from nation), r as (select e.dst, u.h, 0.3::double * u.h - 0.2::double * v.h as s from e join h u on u.id = e.src join h v on v.id = e.dst), p as (select dst, h, exp(case when s > 0 then s else 0.2::double * s end) as p from r) select dst as id, round(sum(p * h) / sum(p), 6) as x0 from p group by 1",
    "learn_autoencoder": "with p as (select p_partkey, p_size / 50.0::double as a, p_retailprice / 1000.0::double as b from part), z as (select *, 0.5::double * a + 1.5::double * b + 0.1::double as z from p) select p_partkey, round(z, 6) as z, round(((a - z - 0.2::double) * (a - z - 0.2::double) + (b + 0.5::double * z - 0.3::double) * (b + 0.5::double * z - 0.3::double)) / 2, 12) as loss from z",
    "learn_mlp": "with p as (select p_partkey, p_size / 50.0::double as a, p_retailprice / 1000.0::double as b from part) select p_partkey, round(greatest(0.5::double * a + 1.5::double * b + 0.1::double, 0) - 2 * greatest(-a + 0.25::double * b + 0.2::double, 0) + 0.5::double, 6) as y from p",
    "learn_encode": """with recursive s as (select conv_id, row_number() over (partition by conv_id order by turn) as k, length(text) / 100.0::double as x from conversations),
 g(conv_id, k, h, c) as (select distinct conv_id, 0::bigint, 0.0::double, 0.0::double from s union all select conv_id, k, o * tanh(f * c + i * n), f * c + i * n from
 (select s.conv_id, s.k, c, 1 / (1 + exp(-(0.1::double * x + 0.1::double * h))) as i, 1 / (1 + exp(-(0.2::double * x + 0.1::double + 0.2::double * h))) as f, tanh(0.3::double * x + 0.2::double + 0.3::double * h) as n,
  1 / (1 + exp(-(-0.1::double * x + 0.05::double + 0.4::double * h + 0.1::double))) as o from g join s on s.conv_id = g.conv_id and s.k = g.k + 1))
 select conv_id, round(arg_max(h, k), 6) as h from g group by 1""",
    "learn_mask": "select n_regionkey, cast(1 as bigint) as masked, count(*)::double - 1 as x from nation group by 1",
    "time_convert": "select event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) + interval 8 hour as wall, (epoch_us(ts) // 1000) / 1000.0::double as epoch from events",
    "time_auto_unit": "select event_id, round(case event_id % 3 when 0 then epoch_us(ts) / 1e6::double when 1 then (epoch_us(ts) // 1000) / 1e3::double else (epoch_us(ts) // 1000000)::double end, 6) as epoch from events",
    "time_date_template": "select event_id, 'a' || strftime(ts, '%Y%m%d') || 'b' || strftime(ts + to_days(cast(event_id % 9 as integer)), '%Y%m%d') || 'c' || strftime(ts - to_days(3), '%Y%m%d') as s from events",
    "time_conditions": "select event_id from events where value >= 20 and user_id < 100",
    "text_normalize": "select p_partkey, lower(regexp_replace(p_brand || ' _-' || p_type, '[-_ ]', '', 'g')) as name from part",
    "viz_first_appearance_palette": "with f as (select event_type, row_number() over (order by min(ts)) - 1 as rank from events group by 1) select event_type, rank, case rank % 3 when 0 then '#ff0000' when 1 then '#00ff00' else '#0000ff' end as color from f",
    "viz_rgb": "select cast(id as integer) as id, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from (values (1, 1.0::double, 128 / 255.0::double, 0.0::double), (2, 0, 1, 64 / 255.0::double)) t(id, r, g, b)",
    "metrics_flatten": "with e as (select event_type, event_id // 1000 as step, sum(value) as s, count(*)::double as n from events group by 1, 2) select step, event_type || '/sum' as name, round(s, 6) as value from e union all select step, event_type || '/n', round(n, 6) from e",
    "stream_tumble": "select event_type, date_trunc('hour', ts) as start, round(sum(value), 6) as sum, round(avg(value), 6) as mean, count(*) as n from events group by 1, 2",
    "stream_sessions": "with g as (select user_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as n from events) select user_id, cast(sum(n) as bigint) as sessions, count(*) as n from g group by 1",
}
