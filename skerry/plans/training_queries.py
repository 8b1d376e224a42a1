"""Queries around training, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.operators import learn, training
from skerry.plans.graph_queries import _RING, _drawn, _ring, _unit
from skerry.sources.tables import sequences, table


def train_accumulate(spark, d):
    e = table(spark, d, "events").withColumn("n", F.lit(1))
    return training.accumulate(e, ["event_type"], ["event_id"], ["value", "n"]).select("event_type", "event_id", F.round("value", 4).alias("value"), "n")


def _households(spark, d):
    """Customers of a nation as a graph of their own: ids from 0, each leads to the next."""
    c = table(spark, d, "customer")
    n = c.select(F.col("c_nationkey").alias("g"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long").alias("id"), "c_custkey")
    e = n.select("g", F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(n.select("g", F.col("id").alias("dst")), ["g", "dst"])
    return n, e


def train_batch_nodes(spark, d):
    return training.batch_graphs(*_households(spark, d))[0]


def train_batch_edges(spark, d):
    return training.batch_graphs(*_households(spark, d))[1]


def train_negative_edges(spark, d):
    e = _ring(spark, d)[0].filter("src < 100 and dst < 100")
    return training.negative_edges(e, 25, 9)


def train_mask_uniform(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return training.mask_rows(c, ["g"], "id", ["x"], 0.3, 2, "uniform").select("id", F.round("x", 6).alias("x"), "masked")


def _features(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("x"))


def train_classify(spark, d):
    z, p = training.classify(F.col("x"), [([[0.5, -1.0], [1.5, 0.25]], [0.1, 0.2])], ([[1.0, -0.5, 0.2], [0.3, 0.8, -1.0]], [0.0, 0.1, -0.1]))
    return _features(spark, d).select("p_partkey", p.alias("p")).select("p_partkey", *[F.round(F.col("p")[k], 9).alias(f"p{k}") for k in range(3)])


def train_variational_loss(spark, d):
    e = table(spark, d, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    return e.select("vec_id", F.round(training.variational_loss(part(1, 8), part(9, 8), part(17, 16), part(33, 16)), 6).alias("loss"))


def train_variational_graph_loss(spark, d):
    k = F.col("n_nationkey").cast("long")
    latent = table(spark, d, "nation").select(k.alias("id"), F.array((k % 3) / 3.0, (k % 5) / 5.0).alias("mu"), F.array((k % 4) / 8.0, (k % 7) / -14.0).alias("logstd"))
    e = _ring(spark, d)[0].filter("src < 100 and dst < 100")
    return training.variational_graph_loss(latent, e, training.negative_edges(e, 25, 9)).select(F.round("loss", 6).alias("loss"))


def train_encode(spark, d):
    """A gated recurrent unit of one state over the lengths of each conversation's turns."""
    s = sequences(table(spark, d, "conversations").withColumn("v", F.array(F.length("text") / 100.0)), "conv_id", ["turn"], "v")
    w = [[[0.3], [-0.2], [0.5]], [[0.1], [0.4], [-0.6]], [0.05, -0.1, 0.2], [0.0, 0.1, -0.05]]
    return training.encode_layers(s, "conv_id", "x", "gru", [[w]]).select("conv_id", F.round(F.col("latent")[0], 6).alias("h"))


def train_fold_metrics(spark, d):
    """Mean square error of the training folds' mean price on the held-out fold."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    fit = lambda t: t.agg(F.avg("p_retailprice").alias("m")).first()["m"]
    out = training.k_fold_metrics(p, ["p_partkey"], 4, fit, lambda t, m: t.withColumn("m", F.lit(m)), F.pow(F.col("p_retailprice") - F.col("m"), F.lit(2.0)))
    return out.select("fold", F.round("metric", 4).alias("metric"))


def _places(spark, d):
    e = _ring(spark, d)[0].filter("src < 100 and dst < 100")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    return training.graph_plot(n, e, "n_regionkey", ["#ff0000", "#00ff00", "#0000ff"])


def viz_graph_nodes(spark, d):
    return _places(spark, d)[0].select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n_regionkey", "color")


def viz_graph_edges(spark, d):
    return _places(spark, d)[1].select("src", "dst", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_FNS = [train_accumulate, train_batch_nodes, train_batch_edges, train_negative_edges, train_mask_uniform, train_classify, train_variational_loss, train_variational_graph_loss, train_encode, train_fold_metrics, viz_graph_nodes, viz_graph_edges]
QUERIES = {f.__name__: f for f in _FNS}

_HOUSES = "n as (select c_nationkey as g, row_number() over (partition by c_nationkey order by c_custkey) - 1 as id, c_custkey from customer), o as (select g, coalesce(sum(k) over (order by g rows between unbounded preceding and 1 preceding), 0)::bigint as o from (select g, count(*) as k from n group by 1))"
_NEAR = "f as (select src, dst from e where src < 100 and dst < 100)"
_NEGATIVE = f"""k as (select row_number() over (order by src, dst) - 1 as k from f), q as (select distinct {_drawn(9, 'k', '0')} % 25 as src, {_drawn(9, 'k', '1')} % 25 as dst from k),
neg as (select src, dst from q where src <> dst and (src, dst) not in (select (src, dst) from f))"""
_CIRCLE = "c as (select n_nationkey::bigint as id, n_regionkey, cos(2 * pi() * (row_number() over (order by n_nationkey) - 1) / 25) as x, sin(2 * pi() * (row_number() over (order by n_nationkey) - 1) / 25) as y from nation), r as (select n_regionkey, row_number() over (order by min(n_nationkey)) - 1 as k from nation group by 1)"
_SIG = lambda v: f"1 / (1 + exp(-({v})))"
ORACLE = {
    "train_accumulate": "select event_type, event_id, round(sum(value) over w, 4) as value, count(*) over w::double as n from events window w as (partition by event_type order by event_id rows unbounded preceding)".replace("count(*) over w::double", "(count(*) over w)::double"),
    "train_batch_nodes": f"with {_HOUSES} select id + o as id, g as batch, c_custkey from n join o using (g)",
    "train_batch_edges": f"with {_HOUSES} select a.id + o as src, b.id + o as dst from n a join n b on a.g = b.g and b.id = a.id + 1 join o on o.g = a.g",
    "train_negative_edges": f"with {_RING}, {_NEAR}, {_NEGATIVE} select src, dst from neg",
    "train_mask_uniform": f"""with c as (select c_nationkey as g, c_custkey as id, c_acctbal as x, {_unit(2, 'c_custkey')} as r, {_unit(3, 'c_custkey')} as u from customer),
 s as (select *, min(r) over w as m, min(x) over w as l, max(x) over w as h from c window w as (partition by g)) select id, round(case when r <= greatest(m, 0.3::double) then l + (h - l) * u else x end, 6) as x, r <= greatest(m, 0.3::double) as masked from s""",
    "train_classify": """with p as (select p_partkey, p_size / 50.0::double as a, p_retailprice / 1000.0::double as b from part), z as (select p_partkey, 0.5::double * a + 1.5::double * b + 0.1::double as u, -a + 0.25::double * b + 0.2::double as v from p),
 o as (select p_partkey, exp(u + 0.3::double * v) as a, exp(-0.5::double * u + 0.8::double * v + 0.1::double) as b, exp(0.2::double * u - v - 0.1::double) as c from z)
 select p_partkey, round(a / (a + b + c), 9) as p0, round(b / (a + b + c), 9) as p1, round(c / (a + b + c), 9) as p2 from o""",
    "train_variational_loss": "select vec_id, round(list_sum(list_transform(range(1, 17), lambda i: (embedding[16 + i]::double - embedding[32 + i]::double) * (embedding[16 + i]::double - embedding[32 + i]::double))) / 16 + list_sum(list_transform(range(1, 9), lambda i: -0.5::double * (1 + 2 * embedding[8 + i]::double - embedding[i]::double * embedding[i]::double - exp(2 * embedding[8 + i]::double)))) / 8, 6) as loss from embeddings",
    "train_variational_graph_loss": f"""with {_RING}, {_NEAR}, {_NEGATIVE}, l as (select n_nationkey as id, n_nationkey % 3 / 3.0::double as a, n_nationkey % 5 / 5.0::double as b, n_nationkey % 4 / 8.0::double as s, n_nationkey % 7 / -14.0::double as t from nation),
 p as (select 1 / (1 + exp(-(u.a * v.a + u.b * v.b))) as p from f join l u on u.id = src join l v on v.id = dst), m as (select 1 / (1 + exp(-(u.a * v.a + u.b * v.b))) as p from neg join l u on u.id = src join l v on v.id = dst)
 select round((select avg(-ln(p + 1e-16::double)) from p) + (select avg(-ln(1 - p + 1e-16::double)) from m) + (select avg(-0.5::double * (2 + 2 * s + 2 * t - a * a - b * b - exp(2 * s) - exp(2 * t))) / count(*) from l), 6) as loss""",
    "train_encode": f"""with recursive s as (select conv_id, row_number() over (partition by conv_id order by turn) as k, length(text) / 100.0::double as x from conversations),
 g(conv_id, k, h) as (select distinct conv_id, 0::bigint, 0.0::double from s union all select conv_id, k, (1 - z) * tanh(n0 + r * n1) + z * h from
 (select s.conv_id, s.k, h, {_SIG('0.3::double * x + 0.05::double + 0.1::double * h')} as r, {_SIG('-0.2::double * x - 0.1::double + 0.4::double * h + 0.1::double')} as z, 0.5::double * x + 0.2::double as n0, -0.6::double * h - 0.05::double as n1 from g join s on s.conv_id = g.conv_id and s.k = g.k + 1))
 select conv_id, round(arg_max(h, k), 6) as h from g group by 1""",
    "train_fold_metrics": "with f as (select p_retailprice as p, cast(ntile(4) over (order by p_partkey) - 1 as integer) as fold from part), m as (select a.fold, avg(b.p) as m from (select distinct fold from f) a join f b on a.fold <> b.fold group by 1) select f.fold, round(avg((p - m) * (p - m)), 4) as metric from f join m using (fold) group by 1",
    "viz_graph_nodes": f"with {_CIRCLE} select id, round(x, 6) + 0 as x, round(y, 6) + 0 as y, c.n_regionkey, case k % 3 when 0 then '#ff0000' when 1 then '#00ff00' else '#0000ff' end as color from c join r on r.n_regionkey = c.n_regionkey",
    "viz_graph_edges": f"with {_RING}, {_NEAR}, {_CIRCLE} select src, dst, round(a.x, 6) + 0 as x0, round(a.y, 6) + 0 as y0, round(b.x, 6) + 0 as x1, round(b.y, 6) + 0 as y1 from f join c a on a.id = src join c b on b.id = dst",
}
