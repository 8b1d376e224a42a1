"""Queries over graphs and token templates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.operators import graph, templates
from skerry.sources.tables import table

SUPPLIERS = 1_000_000
#: Rows that a task joins or makes distinct, about (some 200 bytes each while it works on them).
TASK_ROWS = 500_000


def _parts(spark, rows: int) -> int | None:
    """Tasks for so many rows, TASK_ROWS in each; none while all cores together take them. Spark draws partitions together by compressed bytes, of which narrow rows have few, and a task's sorts and tables grow with its rows."""
    parts = -(-rows // TASK_ROWS)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def _sales(spark, d):
    """Customer to supplier edges (suppliers' ids raised by SUPPLIERS), one for each line that was sold, and tasks for as many rows."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    parts = _parts(spark, li.count())  # from the files' footers
    if parts:
        o, li = o.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey"), li.select("l_orderkey", "l_suppkey").repartition(parts, "l_orderkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst")), parts


def _trade(spark, d):
    """Customer to supplier edges, each once, weight 1, and all nodes."""
    e, parts = _sales(spark, d)
    e = (e.repartition(parts, "src", "dst") if parts else e).distinct().withColumn("weight", F.lit(1.0))
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").select(F.col("s_suppkey") + SUPPLIERS))
    return e, n


def _tree(spark, d):
    """Suppliers to their nation to its region, both ways: regions are components. Nations from 10 million on, regions from 20 million on."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    a = s.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 10_000_000).cast("long").alias("dst"))
    b = n.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("src"), (F.col("n_regionkey") + 20_000_000).cast("long").alias("dst"))
    e = graph.bidirectional(a.union(b))
    nodes = e.select(F.col("src").alias("id")).distinct()
    return e, nodes


def _ring(spark, d):
    """Nations linked by three rules on their keys, with their suppliers (ids from 100 on) hanging on them, both ways: a graph of several cores."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    k = F.col("n_nationkey").cast("long")
    rules = n.select(k.alias("src"), F.explode(F.array(*[(k * a + b) % 25 for a, b in ((3, 1), (7, 2), (11, 3))])).alias("dst"))
    e = rules.filter("src < 20").union(s.select((F.col("s_suppkey") + 100).alias("src"), F.col("s_nationkey").cast("long").alias("dst")))
    e = graph.remove_loops(graph.bidirectional(e))
    return e, e.select(F.col("src").alias("id")).distinct()


_TRADE = f"e as (select distinct o_custkey as src, l_suppkey + {SUPPLIERS} as dst from orders join lineitem on o_orderkey = l_orderkey), n as (select c_custkey as id from customer union all select s_suppkey + {SUPPLIERS} from supplier)"
_TREE = "t as (select s_suppkey as src, cast(s_nationkey + 10000000 as bigint) as dst from supplier union select cast(n_nationkey + 10000000 as bigint), cast(n_regionkey + 20000000 as bigint) from nation), e as (select src, dst from t union select dst, src from t), n as (select distinct src as id from e)"
_HOPS = "r(id, hop) as (select (select min(id) from n), 0 union select e.dst, r.hop + 1 from r join e on e.src = r.id where r.hop < 6), h as (select id, min(hop) as hop from r group by 1)"
_RING = """t as (select n_nationkey::bigint as src, ((n_nationkey * a + b) % 25)::bigint as dst from nation, (values (3, 1), (7, 2), (11, 3)) u(a, b) where n_nationkey < 20 union select s_suppkey + 100, s_nationkey::bigint from supplier),
e as (select src, dst from t where src <> dst union select dst, src from t where src <> dst)"""


def _peel(most: int, rounds: int) -> str:
    """Rounds of peeling as tables: e{k}_{r} are the edges left after r rounds for k, g{k}_{r} the nodes that go in one."""
    out, last = [], "e"
    for k in range(1, most + 1):
        for r in range(rounds):
            out.append(f"g{k}_{r} as materialized (select dst as id from {last} group by 1 having count(*) < {k})")
            out.append(f"e{k}_{r} as materialized (select src, dst from {last} where src not in (select id from g{k}_{r}) and dst not in (select id from g{k}_{r}))")
            last = f"e{k}_{r}"
    return ", ".join(out)


def _dfs(start: str) -> str:
    """A search from start, with a stack and what was visited as lists; the last row has all."""
    return f"""near as (select src, list_sort(list(dst)) as ns from e group by 1),
 w(k, stack, seen) as (select 0, [s.id], [s.id] from ({start}) s union all
  select k + 1, list_concat(stack[1 : len(stack) - 1], list_filter(coalesce(ns, []), lambda x: not list_contains(seen, x))), list_concat(seen, list_filter(coalesce(ns, []), lambda x: not list_contains(seen, x)))
  from w left join near on src = stack[len(stack)] where len(stack) > 0),
 v as (select seen from w order by k desc limit 1)"""


def _drawn(seed: int, *columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(',', '{seed}', {', '.join(columns)})), 1, 8))::bigint)"


def _unit(seed: int, *columns: str) -> str:
    return f"({_drawn(seed, *columns)} / 4294967296.0::double)"


def graph_bidirectional(spark, d):
    return graph.bidirectional(*_sales(spark, d))


def graph_add_loops(spark, d):
    return graph.add_loops(*_trade(spark, d))


def graph_remove_loops(spark, d):
    e, n = _trade(spark, d)
    return graph.remove_loops(graph.add_loops(e, n))


def _volume(spark, d):
    """Nation to segment-like weights: share of a customer nation's orders by priority, as a weighted graph of small ids."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    e = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("src"), (F.substring("o_orderpriority", 1, 1).cast("long") + 100).alias("dst")).agg(F.count(F.lit(1)).alias("k"))
    top = e.groupBy("src").agg(F.sum("k").alias("t"))
    return e.join(top, "src").select("src", "dst", (F.col("k") / F.col("t")).alias("weight"))


_VOLUME = "v0 as (select cast(c_nationkey as bigint) as src, cast(substr(o_orderpriority, 1, 1) as bigint) + 100 as dst, count(*) as k from orders join customer on o_custkey = c_custkey group by 1, 2), v as (select src, dst, k / sum(k) over (partition by src) as weight from v0)"


def graph_threshold(spark, d):
    e = _volume(spark, d)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.deterministic(e, nodes, 0.2, keep_weight=True, connect=False, both=False).select("src", "dst", F.round("weight", 6).alias("weight"))


def graph_deterministic(spark, d):
    e = _volume(spark, d)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.deterministic(e, nodes, 0.2)


def graph_degree(spark, d):
    return graph.degrees(*_trade(spark, d))


def graph_degree_max(spark, d):
    return graph.degree_extremes(*_trade(spark, d), "max")


def graph_degree_min(spark, d):
    return graph.degree_extremes(*_trade(spark, d), "min")


def graph_components(spark, d):
    return graph.components(*_tree(spark, d))


def graph_is_connected(spark, d):
    e, n = _tree(spark, d)
    return spark.createDataFrame([(graph.is_connected(e, n),)], "connected boolean")


def graph_make_connected(spark, d):
    return graph.connect(*_tree(spark, d))


def graph_bfs_hops(spark, d):
    e, n = _tree(spark, d)
    return graph.hops(e, n.agg(F.min("id").alias("id"))).select("id", "hop")


def graph_bfs_path(spark, d):
    """To the farthest node from the least one, the greatest of several."""
    e, n = _tree(spark, d)
    a = n.agg(F.min("id")).first()[0]
    b = graph.hops(e, n.agg(F.min("id").alias("id"))).agg(F.max(F.struct("hop", "id")).alias("x")).first()["x"]["id"]
    return spark.createDataFrame(list(enumerate(graph.bfs_path(e, spark, a, b))), "place int, id long")


def graph_dfs(spark, d):
    e, n = _tree(spark, d)
    return graph.dfs(e, n.agg(F.min("id")).first()[0]).select("id", "place")


def graph_k_core(spark, d):
    return graph.k_core(*_ring(spark, d), 3)[0]


def graph_core_numbers(spark, d):
    return graph.core_numbers(*_ring(spark, d))


def graph_core_numbers_tree(spark, d):
    e, n = _tree(spark, d)
    return graph.core_numbers(e, n)


def graph_ordering_bfs(spark, d):
    e, n = _tree(spark, d)
    return graph.ordering(e, n, "bfs").select("id", F.col("place").cast("long").alias("place"))


def graph_ordering_core(spark, d):
    e, n = _tree(spark, d)
    return graph.ordering(e, n, "k-core").select("id", F.col("place").cast("long").alias("place"))


def graph_ordering_dfs(spark, d):
    return graph.ordering(*_ring(spark, d), "dfs")


def graph_random_walk(spark, d):
    e, n = _ring(spark, d)
    return graph.random_walks(e, n.select(F.col("id").alias("walk"), "id"), 6, 3)


def graph_mesh(spark, d):
    return graph.mesh(spark, [3, 4, 2])


def graph_erdos_renyi(spark, d):
    e = graph.erdos_renyi(spark, 60, 0.3, seed=5)
    return e


def graph_stochastic_blocks(spark, d):
    return graph.stochastic_blocks(spark, 100, 3)


def graph_preferential(spark, d):
    return graph.preferential(spark, 100, 10)


def graph_random(spark, d):
    return graph.random_graph(spark, 100)


def data_linear(spark, d):
    x = graph.linear_data(spark, 1000, [1.0, -2.0, 0.5], 3.0, eps=0.1, seed=4)
    return x.select("id", *[F.round(F.col("x")[k], 6).alias(f"x{k}") for k in range(3)], F.round("y", 6).alias("y"))


def tmpl_prefix_counts(spark, d):
    p = templates.prefix_counts(table(spark, d, "pages"), "url", "/")
    return p.select(F.array_join("prefix", "/").alias("prefix"), F.col("depth").cast("long").alias("depth"), "n", F.round("share", 6).alias("share"))


def tmpl_url_template(spark, d):
    """One level merges: sites' pages under the language."""
    e = table(spark, d, "events").select(F.concat(F.lit("www.test.com/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("url"))
    return templates.prefix_templates(e, "url", "/", 0.01)


def tmpl_page_templates(spark, d):
    return templates.prefix_templates(table(spark, d, "pages"), "url", "/", 0.1)


def tmpl_unseen(spark, d):
    made = templates.prefix_templates(table(spark, d, "events").select(F.concat(F.lit("www.test.com/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("url")), "url", "/", 0.01)
    new = table(spark, d, "events").select((F.col("event_id") + 10_000_000).alias("id"), F.concat(F.lit("www.test.com/"), F.when(F.col("event_id") % 2 == 0, F.lit("view/")).otherwise(F.lit("none/")), F.lit("x"), F.col("event_id").cast("string")).alias("url"))
    return templates.apply_templates(new, "url", made, "/").select("id", "template")


def tmpl_layer_candidates(spark, d):
    c = templates.layer_candidates(table(spark, d, "pages"), "url", "/", 5)
    return c.select(F.col("layer").cast("long").alias("layer"), "start", "end", "n")


def tmpl_layer_templates(spark, d):
    e = table(spark, d, "customer").select(F.concat(F.lit("www.test.com/samples/"), F.col("c_custkey").cast("string")).alias("url"))
    return templates.layer_templates(e, "url", "/", 100)


_FNS = [graph_bidirectional, graph_add_loops, graph_remove_loops, graph_threshold, graph_deterministic, graph_degree, graph_degree_max, graph_degree_min, graph_components, graph_is_connected, graph_make_connected, graph_bfs_hops, graph_bfs_path, graph_dfs, graph_k_core, graph_core_numbers, graph_core_numbers_tree, graph_ordering_bfs, graph_ordering_core, graph_ordering_dfs, graph_random_walk, graph_mesh, graph_erdos_renyi, graph_stochastic_blocks, graph_preferential, graph_random, data_linear, tmpl_prefix_counts, tmpl_url_template, tmpl_page_templates, tmpl_unseen, tmpl_layer_candidates, tmpl_layer_templates]
QUERIES = {f.__name__: f for f in _FNS}

# peeling leaves a region without edges, and so without a core, unless exactly one of its nations outlasts the first round
_CORED = "(id < 20000000 or id in (select cast(n_regionkey + 20000000 as bigint) from nation where n_nationkey in (select s_nationkey from supplier) group by 1 having count(*) = 1))"
_DEG = "dg as (select n.id, coalesce(count(e.src), 0)::double as degree from n left join e on e.dst = n.id group by 1)"
ORACLE = {
    "graph_bidirectional": f"with {_TRADE} select src, dst, 1.0::double as weight from (select src, dst from e union select dst, src from e)",
    "graph_add_loops": f"with {_TRADE} select src, dst, 1.0::double as weight from e where src <> dst union all select id, id, 1.0::double from n",
    "graph_remove_loops": f"with {_TRADE} select src, dst, 1.0::double as weight from e where src <> dst",
    "graph_threshold": f"with {_VOLUME} select src, dst, round(weight, 6) as weight from v where weight >= 0.2::double union all select id, id, 1.0::double from (select src as id from v union select dst from v)",
    "graph_deterministic": f"""with {_VOLUME}, ids as (select src as id from v union select dst from v), top as (select src, arg_max(dst, struct_pack(w := weight, d := -dst)) as dst from v group by 1),
 kept as (select src, dst from v where weight >= 0.2::double union select src, dst from top union select id, 0 from ids where id not in (select src from v) union select id, id from ids)
 select src, dst, 1.0::double as weight from (select src, dst from kept union select dst, src from kept)""",
    "graph_degree": f"with {_TRADE}, {_DEG} select id, degree from dg",
    "graph_degree_max": f"with {_TRADE}, {_DEG} select id, degree from dg where degree = (select max(degree) from dg)",
    "graph_degree_min": f"with {_TRADE}, {_DEG} select id, degree from dg where degree = (select min(degree) from dg)",
    "graph_components": f"with recursive {_TREE}, r(id, x) as (select id, id from n union select e.dst, r.x from r join e on e.src = r.id) select id, min(x) as component from r group by 1",
    "graph_is_connected": f"with recursive {_TREE}, {_HOPS} select (select count(*) from h) = (select count(*) from n) as connected",
    "graph_make_connected": f"""with recursive {_TREE}, r(id, x) as (select id, id from n union select e.dst, r.x from r join e on e.src = r.id), c as (select distinct min(x) as c from r group by id),
 f as (select c, lead(c) over (order by c) as f from c) select src, dst, 1.0::double as weight from e union all select c, f, 1.0::double from f where f is not null union all select f, c, 1.0::double from f where f is not null""",
    "graph_bfs_hops": f"with recursive {_TREE}, {_HOPS} select id, cast(hop as integer) as hop from h",
    "graph_bfs_path": f"""with recursive {_TREE}, {_HOPS}, p(id, hop) as (select max(id), max(hop) from h where hop = (select max(hop) from h)
 union all select (select min(e.src) from e join h on h.id = e.src where e.dst = p.id and h.hop = p.hop - 1), p.hop - 1 from p where p.hop > 0) select cast(hop as integer) as place, id from p""",
    "graph_dfs": f"with recursive {_TREE}, {_dfs('select min(id) as id from n')} select unnest(seen) as id, unnest(range(len(seen))) as place from v",
    "graph_k_core": f"with {_RING}, {_peel(3, 12)} select distinct dst as id from e3_11",
    "graph_core_numbers": f"with {_RING}, {_peel(7, 10)} select id, cast(core as integer) as core from (" + " union all ".join(f"select id, {k - 1} as core from g{k}_{r}" for k in range(1, 8) for r in range(10)) + ")",
    "graph_core_numbers_tree": f"with {_TREE} select id, 1 as core from n where {_CORED}",
    "graph_ordering_bfs": f"with recursive {_TREE}, {_DEG}, s as (select min(id) as id from dg where degree = (select max(degree) from dg)), q(id, hop) as (select id, 0 from s union select e.dst, q.hop + 1 from q join e on e.src = q.id where q.hop < 6), m as (select id, min(hop) as hop from q group by 1) select id, row_number() over (order by hop, id) - 1 as place from m",
    "graph_ordering_core": f"with {_TREE}, {_DEG} select id, row_number() over (order by degree desc, id desc) - 1 as place from dg where {_CORED}",
    "graph_ordering_dfs": f"""with recursive {_RING}, dg as (select dst as id, count(*) as degree from e group by 1), {_dfs('select min(id) as id from dg where degree = (select max(degree) from dg)')}
 select unnest(seen) as id, unnest(range(len(seen))) as place from v""",
    "graph_random_walk": f"""with recursive {_RING}, near as (select src, list_sort(list(dst)) as ns from e group by 1),
 w(walk, step, id) as (select src, 0, src from near union all select walk, step + 1, ns[{_drawn(3, 'walk', 'step + 1')} % len(ns) + 1] from w join near on src = id where step < 5) select walk, cast(step as integer) as step, id from w""",
    "graph_mesh": "with p as (select a as x, b as y from range(0, 3) t(a), range(3, 7) u(b) union all select a, b from range(3, 7) t(a), range(7, 9) u(b)) select x as src, y as dst, 1.0::double as weight from p union all select y, x, 1.0::double from p",
    "graph_erdos_renyi": f"with p as (select a as src, b as dst from range(60) t(a), range(60) u(b) where a < b and {_unit(5, 'a', 'b')} < 0.3::double) select src, dst, 1.0::double as weight from p union all select dst, src, 1.0::double from p",
    "graph_stochastic_blocks": f"""with q as (select a as src, b as dst, {_drawn(0, 'a')} % 3 as x, {_drawn(0, 'b')} % 3 as y from range(100) t(a), range(100) u(b) where a < b), o as (select src, dst, least(x, y) as x, greatest(x, y) as y from q),
 p as (select src, dst from o where {_unit(2, 'src', 'dst')} < case when x = y then 0.4::double + (1.0::double - 0.4::double) * {_unit(1, 'x', 'y')} else 0.5::double * {_unit(1, 'x', 'y')} end)
 select src, dst, 1.0::double as weight from p union all select dst, src, 1.0::double from p""",
    "graph_random": f"with p as (select a as src, b as dst from range(100) t(a), range(100) u(b) where a < b and {_unit(0, 'a', 'b')} < 0.5::double) select src, dst, 1.0::double as weight from p union all select dst, src, 1.0::double from p union all select a, a, 1.0::double from range(100) t(a)",
    "data_linear": "with z as (select id, " + ", ".join(f"sqrt(-2 * ln(1 - {_unit(4, 'id', str(2 * k))})) * cos(2 * pi() * {_unit(4, 'id', str(2 * k + 1))}) as x{k}" for k in range(4)) + " from range(1000) t(id)) select id, round(x0, 6) as x0, round(x1, 6) as x1, round(x2, 6) as x2, round(x0 - 2 * x1 + 0.5::double * x2 + 3 + 0.1::double * x3, 6) as y from z",
    "tmpl_prefix_counts": "with t as (select string_split(trim(url), '/') as t from pages), p as (select array_to_string(t[1 : k], '/') as prefix, k as depth, t[1] as f, count(*) as n from (select t, unnest(range(1, len(t) + 1)) as k from t) group by 1, 2, 3) select p.prefix, p.depth, p.n, round(p.n / q.n, 6) as share from p join p q on q.depth = 1 and q.f = p.f",
    "tmpl_url_template": "select 'www.test.com/' || event_type || '/' || event_id as text, count(*) as n, 'www.test.com/' || event_type || '/*' as template from events group by 1, 3",
    "tmpl_unseen": "select event_id + 10000000 as id, case when event_id % 2 = 0 then 'www.test.com/view/*' else 'invalid' end as template from events",
    "tmpl_layer_candidates": "with t as (select distinct list_append(string_split(trim(url), '/'), '<END>') as t from pages), e as (select distinct k - 1 as layer, t[k] as src, t[k + 1] as dst from (select t, unnest(range(1, len(t))) as k from t)) select a.layer, a.src as start, b.dst as end, count(distinct a.dst) as n from e a join e b on a.dst = b.src and a.layer + 1 = b.layer group by 1, 2, 3 having count(distinct a.dst) >= 5",
    "tmpl_layer_templates": "select 'www.test.com/samples/' || c_custkey as text, 'www.test.com/samples/*' as template from customer",
}
