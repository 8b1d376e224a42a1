"""Queries over series, distances and sketches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions.time import micros
from skerry.operators import distance, series, sketch
from skerry.sources.tables import sequences, table

HOUR, DAY = 3_600_000_000, 86_400_000_000
R = lambda c, n=6: F.round(c, n)


def _events(spark, d):
    return table(spark, d, "events")


def _hours(spark, d):
    """event_type, tick (microseconds) and value."""
    return _events(spark, d).select("event_type", micros("ts").alias("tick"), "value")


def _daily(spark, d):
    """event_type, day (number) and the day's sum, gaps as null."""
    e = _events(spark, d).groupBy("event_type", F.floor(micros("ts") / DAY).alias("day")).agg(F.sum("value").alias("value"))
    return e


def _pair(spark, d, a="view", b="click"):
    """day, x and y: the daily sums of two event types on days that both have, numbered."""
    e = _daily(spark, d)
    x, y = e.filter(F.col("event_type") == a).select("day", F.col("value").alias("x")), e.filter(F.col("event_type") == b).select("day", F.col("value").alias("y"))
    return x.join(y, "day").withColumn("g", F.lit(1))


_DAILY = "select event_type, cast(floor(epoch_us(ts) / 86400000000) as bigint) as day, sum(value) as value from events group by 1, 2"
_PAIR = f"daily as ({_DAILY}), pair as (select x.day, x.value as x, y.value as y from daily x join daily y on x.day = y.day and x.event_type = 'view' and y.event_type = 'click')"


def _warped(group: str) -> str:
    """Warping of each group's pair of series by anti-diagonals: a has the last one's distances by the place in x, b the one before."""
    return f"""{_PAIR}, l as (select {group} as g, list(x order by day) as x, list(y order by day) as y from pair group by 1),
 r(g, k, a, b) as (select g, 0, list_transform(range(1, len(x) + 1), lambda i: case when i = 1 then abs(x[1] - y[1]) end), list_transform(x, lambda v: null::double) from l
 union all select r.g, k + 1, list_transform(range(1, len(x) + 1), lambda i: case when k + 3 - i between 1 and len(x) then least(a[i - 1] + abs(x[i] - y[k + 3 - i]), a[i] + abs(x[i] - y[k + 3 - i]), b[i - 1] + 2 * abs(x[i] - y[k + 3 - i])) end), a
 from r join l on l.g = r.g where k < 2 * len(x) - 2),
 w as (select r.g, a[len(x)] as distance from r join l on l.g = r.g where k = 2 * len(x) - 2)"""


_HOURLY = """h as (select event_type, epoch_us(ts) as t, value from events), f as (select event_type, min(t) as a, max(t) as z from h group by 1),
g as (select event_type, unnest(range(a, z + 1, 3600000000)) as tick from f),
b as (select h.event_type, a + cast(floor((t - a) / 3600000000) as bigint) * 3600000000 as tick, sum(value) as s, avg(value) as m from h join f using (event_type) group by 1, 2)"""


def series_moving_average(spark, d):
    return series.moving_average(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", R("smoothed").alias("smoothed"))


def series_weighted_moving_average(spark, d):
    return series.weighted_moving_average(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", R("smoothed").alias("smoothed"))


def series_ewma_final(spark, d):
    return series.ewma_last(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 0.3).select("user_id", R("smoothed").alias("smoothed"))


def series_ewma_full(spark, d):
    return series.ewma(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 0.3).select("event_id", R("smoothed").alias("smoothed"))


def series_extend(spark, d):
    e = _daily(spark, d)
    xs = e.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "value"))), lambda s: s["value"]).alias("x"))
    return series.extend(xs, "x", 1, 5).select("event_type", R(F.element_at("x", -1)).alias("next"))


def series_gap_sessions(spark, d):
    s = series.gap_sessions(_events(spark, d), ["user_id"], ["ts", "event_id"], micros("ts"), 6 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).select("user_id", F.col("session").cast("long").alias("session"), "n", "first_id")


def series_hourly_sum(spark, d):
    return series.tumble(_hours(spark, d), ["event_type"], "tick", "value", HOUR, "sum").select("event_type", "tick", R("value").alias("value"))


def series_hourly_mean(spark, d):
    return series.tumble(_hours(spark, d), ["event_type"], "tick", "value", HOUR, "mean").select("event_type", "tick", R("value").alias("value"))


def series_hourly_flagship(spark, d):
    """Hourly mean by type, gaps filled along lines, then a trailing mean of three."""
    t = series.tumble(_hours(spark, d), ["event_type"], "tick", "value", HOUR, "mean")
    f = series.interpolate(t, ["event_type"], "tick", "value", "linear")
    return series.moving_average(f, ["event_type"], ["tick"], "filled", 3).select("event_type", "tick", R("smoothed").alias("smoothed"))


def series_auto_step(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus"), F.floor(micros("o_orderdate") / DAY).alias("day"))
    return series.auto_step(o, ["o_orderstatus"], F.col("day")).select("o_orderstatus", "step")


def _revenue(spark, d):
    """l_returnflag, day (in half days) and revenue: a series whose grid of half days has gaps."""
    li = table(spark, d, "lineitem").select("l_returnflag", (F.floor(micros("l_shipdate") / DAY) * 2).alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return li.groupBy("l_returnflag", "day").agg(R(F.sum("r"), 4).alias("revenue"))


_REV = "rev as (select l_returnflag, day, round(sum(r), 4) as revenue from (select l_returnflag, 2 * cast(floor(epoch_us(l_shipdate) / 86400000000) as bigint) as day, l_extendedprice * (1 - l_discount) as r from lineitem) group by 1, 2)"
_GRID = f"{_REV}, e as (select l_returnflag, min(day) as a, max(day) as z from rev group by 1), grid as (select l_returnflag, unnest(range(a, z + 1)) as day from e), reg as (select g.l_returnflag, g.day, revenue from grid g left join rev using (l_returnflag, day))"


def _regridded(spark, d):
    return series.regrid(_revenue(spark, d), ["l_returnflag"], "day", ["revenue"], 1)


def series_regrid(spark, d):
    return _regridded(spark, d).select("l_returnflag", "day", R("revenue", 4).alias("revenue"))


def _interpolated(kind):
    def run(spark, d):
        return series.interpolate(_regridded(spark, d), ["l_returnflag"], "day", "revenue", kind).select("l_returnflag", "day", "filled")

    run.__name__ = f"series_interpolate_{kind.replace('-', '_')}"
    return run


_KNOWN = f"""{_GRID}, k as (select *, last_value(case when revenue is not null then struct_pack(t := day, v := revenue) end ignore nulls) over (partition by l_returnflag order by day rows between unbounded preceding and current row) as p,
 first_value(case when revenue is not null then struct_pack(t := day, v := revenue) end ignore nulls) over (partition by l_returnflag order by day rows between current row and unbounded following) as q from reg)"""


def _spline(kind):
    def run(spark, d):
        # the samples themselves must come back, and no point may be left empty
        t = series.interpolate(_regridded(spark, d), ["l_returnflag"], "day", "revenue", kind)
        near = F.abs(F.col("filled") - F.col("revenue")) <= 1e-6 * F.abs(F.col("revenue"))
        return t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("filled").isNull() | F.isnan("filled")).alias("empty"), F.bool_and(F.coalesce(near, F.lit(True))).alias("through_samples"))

    run.__name__ = f"series_interpolate_{kind}"
    return run


def _monthly(spark, d):
    """l_returnflag, tick (half months) and revenue: knots for splines, every other place of the grid between them."""
    li = table(spark, d, "lineitem").select("l_returnflag", ((F.year("l_shipdate") * 12 + F.month("l_shipdate")) * 2).cast("long").alias("tick"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return li.groupBy("l_returnflag", "tick").agg(R(F.sum("r"), 2).alias("revenue"))


def series_interpolate_cubic(spark, d):
    t = series.interpolate(series.regrid(_monthly(spark, d), ["l_returnflag"], "tick", ["revenue"], 1), ["l_returnflag"], "tick", "revenue", "cubic")
    return t.select("l_returnflag", "tick", R("filled", 2).alias("filled"))


#: The cubic spline through the monthly revenue: second derivatives m from a tridiagonal system, swept forth (c, d) and back, the ends by the third derivative's staying the same over the first and last two pieces.
_CUBIC = """with recursive k0 as (select l_returnflag as f, ((year(l_shipdate) * 12 + month(l_shipdate)) * 2)::bigint as t, round(sum(l_extendedprice * (1 - l_discount)), 2) as y from lineitem group by 1, 2),
 k as (select f, row_number() over w - 1 as i, count(*) over (partition by f) as n, t, y, t - lag(t) over w as a, lead(t) over w - t as b, (y - lag(y) over w) / (t - lag(t) over w) as p, (lead(y) over w - y) / (lead(t) over w - t) as q from k0 window w as (partition by f order by t)),
 e as (select f, i, n, a - case when i = n - 2 then b * b / a::double else 0 end as l, 2 * (a + b) + case when i = 1 then a + a * a / b::double else 0 end + case when i = n - 2 then b + b * b / a::double else 0 end as g,
  b - case when i = 1 then a * a / b::double else 0 end as u, 6 * (q - p) as r from k where i between 1 and n - 2),
 s(f, i, c, d) as (select f, i, u / g, r / g from e where i = 1 union all select e.f, e.i, u / (g - l * c), (r - l * d) / (g - l * c) from s join e on e.f = s.f and e.i = s.i + 1),
 m(f, i, m) as (select s.f, s.i, d from s join e on e.f = s.f and e.i = s.i where e.i = e.n - 2 union all select s.f, s.i, s.d - s.c * m.m from m join s on s.f = m.f and s.i = m.i - 1),
 z as (select f, i, m from m union all select k.f, k.i, x.m - k.b::double / o.b * (y.m - x.m) from k join k o on o.f = k.f and o.i = 1 join m x on x.f = k.f and x.i = 1 join m y on y.f = k.f and y.i = 2 where k.i = 0
  union all select k.f, k.i, x.m + k.a::double / o.a * (x.m - y.m) from k join k o on o.f = k.f and o.i = k.n - 2 join m x on x.f = k.f and x.i = k.n - 2 join m y on y.f = k.f and y.i = k.n - 3 where k.i = k.n - 1),
 v as (select k.f, k.t, k.y, k.b, z.m, lead(k.y) over (partition by k.f order by k.t) as y1, lead(z.m) over (partition by k.f order by k.t) as m1 from k join z on z.f = k.f and z.i = k.i),
 g as (select *, unnest(range(coalesce(b, 1))) as o from v)
 select f as l_returnflag, t + o as tick, round(case when b is null then y else (m * pow(b - o, 3) + m1 * pow(o, 3)) / (6 * b) + (y / b - m * b / 6) * (b - o) + (y1 / b - m1 * b / 6) * o end, 2) as filled from g"""


def series_minmax(spark, d):
    t = series.tumble(_hours(spark, d), ["event_type"], "tick", "value", HOUR, "sum")
    return series.minmax(t, ["event_type"], ["value"]).select("event_type", "tick", R("value").alias("value"))


def series_row_normalize(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return series.normalize_rows(c, ["size", "price"]).select("p_partkey", R("size").alias("size"), R("price").alias("price"))


def series_local_extrema(spark, d):
    return series.local_extrema(_daily(spark, d), ["event_type"], ["day"], "value", "max").filter("extreme").select("event_type", "day", R("value").alias("value"))


def series_holt_winters(spark, d):
    k = lambda x: series.holt_winters(x, 0.4, 0.2)
    return series.per_entity(_daily(spark, d), ["event_type"], ["day"], "value", k, "forecast").select("event_type", "day", R("forecast").alias("forecast"))


def series_holt_winters_fitted(spark, d):
    return series.per_entity(_daily(spark, d), ["event_type"], ["day"], "value", lambda x: series.fit_holt_winters(x, True, 7), "forecast")


def series_arima(spark, d):
    return series.per_entity(_daily(spark, d), ["event_type"], ["day"], "value", series.arima, "forecast")


def series_autocorrelation(spark, d):
    return series.autocorrelations(_daily(spark, d), ["event_type"], ["day"], "value", (1, 2, 3)).select("event_type", *[R(f"acf{k}").alias(f"acf{k}") for k in (1, 2, 3)])


def series_spectral_residual(spark, d):
    return series.per_entity(_daily(spark, d), ["event_type"], ["day"], "value", lambda x: series.spectral_residual(x, 3, 5), "saliency").select("event_type", "day", R("saliency", 5).alias("saliency"))


def series_standardize(spark, d):
    return series.standardize(_monthly(spark, d), ["l_returnflag"], "tick", "revenue", 1).select("l_returnflag", "tick", R("filled", 2).alias("filled"))


def series_from_table(spark, d):
    from skerry.sources.tables import series as build

    e = _events(spark, d).select("event_type", "event_id", "value")
    return build(e, "event_type", None, ["event_id"]).select("entity", F.col("ts").cast("long").alias("ts"), "event_id")


def series_slice(spark, d):
    return series.rows_between(_events(spark, d), ["event_type"], ["ts", "event_id"], 2, 50, 3).select("event_type", "event_id")


def dist_lp_norm(spark, d):
    e = table(spark, d, "embeddings")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return distance.lp_norm(e.join(o, "vec_id"), ["label"], "embedding", "other", 2).select("label", R("distance").alias("distance"))


def dist_sbd(spark, d):
    return distance.sbd(_pair(spark, d), ["g"], "day", "x", "y").select(R("distance").alias("distance"))


def dist_lb_kim(spark, d):
    return distance.lb_kim(_pair(spark, d), ["g"], "day", "x", "y").select(R("bound").alias("bound"))


def dist_lb_keogh(spark, d):
    return distance.lb_keogh(_pair(spark, d), ["g"], "day", "x", "y", 2).select(R("bound").alias("bound"))


def dist_lb_keogh_reversed(spark, d):
    return distance.lb_keogh(_pair(spark, d), ["g"], "day", "y", "x", 2).select(R("bound").alias("bound"))


def dist_dtw(spark, d):
    return distance.dtw(_pair(spark, d), ["g"], "day", ["x"], ["y"]).select(R("distance").alias("distance"))


def dist_dtw_pruned(spark, d):
    p = _pair(spark, d).withColumn("g", F.floor(F.col("day") / 7))
    return distance.dtw_within(p, ["g"], "day", "x", "y", 3200.0).select(F.col("g").alias("week"), R("distance").alias("distance"))


def stat_kl_div(spark, d):
    m = distance.moments(_events(spark, d), ["event_type"], "value")
    o = m.select(F.col("event_type").alias("other"), F.col("mean").alias("m2"), F.col("variance").alias("v2"))
    j = m.join(o, F.col("event_type") < F.col("other"))  # a row a type: few
    return j.select("event_type", "other", R(distance.kl_of_moments(F.col("mean"), F.col("variance"), F.col("m2"), F.col("v2"))).alias("divergence"))


def stat_quantile_exact(spark, d):
    x = sketch.exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    return x.select("l_returnflag", *[R(F.col("q")[i], 4).alias(f"q{k}") for i, k in enumerate((25, 50, 75))], F.col("min").alias("low"), F.col("max").alias("high"), F.col("total").alias("n"))


def stat_tdigest(spark, d):
    """Digest quantiles beside the exact ones: min, max and total exact, the rest within half a hundredth of the range."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    dg = sketch.digest(li, ["l_returnflag"], "l_extendedprice")
    exact = sketch.exact_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75]).select("l_returnflag", *[F.col("q")[i].alias(f"e{k}") for i, k in enumerate((25, 50, 75))])
    j = dg.select("l_returnflag", "min", "max", "total", *[sketch.quantile(q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]).join(exact, "l_returnflag")
    close = [F.abs(F.col(f"q{k}") - F.col(f"e{k}")) <= 0.03 * (F.col("max") - F.col("min")) for k in (25, 50, 75)]
    return j.select("l_returnflag", F.col("min").alias("low"), F.col("max").alias("high"), F.col("total").alias("n"), (close[0] & close[1] & close[2]).alias("close"))


def stat_tdigest_divergence(spark, d):
    e = _events(spark, d).withColumn("g", F.lit(1))
    a, b = (sketch.digest(e.filter(F.col("event_type") == t), ["g"], "value", 100) for t in ("view", "click"))
    return sketch.divergence(a, b, ["g"]).select("divergence")


def vec_sequences(spark, d):
    c = table(spark, d, "conversations")
    return sequences(c.withColumn("n", F.length("text")), "conv_id", ["turn"], "n").select("conv_id", F.size("x").cast("long").alias("turns"), F.element_at("x", 1).cast("long").alias("first_len"))


_FNS = [series_moving_average, series_weighted_moving_average, series_ewma_final, series_ewma_full, series_extend, series_gap_sessions, series_hourly_sum, series_hourly_mean, series_hourly_flagship, series_auto_step, series_regrid, *[_interpolated(k) for k in ("linear", "previous", "zero", "next", "nearest", "nearest-up")], _spline("quadratic"), series_interpolate_cubic, series_minmax, series_row_normalize, series_local_extrema, series_holt_winters, series_holt_winters_fitted, series_arima, series_autocorrelation, series_spectral_residual, series_standardize, series_from_table, series_slice, dist_lp_norm, dist_sbd, dist_lb_kim, dist_lb_keogh, dist_lb_keogh_reversed, dist_dtw, dist_dtw_pruned, stat_kl_div, stat_quantile_exact, stat_tdigest, stat_tdigest_divergence, vec_sequences]
QUERIES = {f.__name__: f for f in _FNS}

_W = "over (partition by user_id order by ts, event_id"
_LINE = "{a}.v + ({b}.v - {a}.v) * ((day - {a}.t)::double / ({b}.t - {a}.t))"
_SPLINE = f"with {_GRID} select l_returnflag, count(*) as n, cast(0 as bigint) as empty, true as through_samples from reg group by 1"
_EXACT = "quantile_cont(l_extendedprice, {q})"
ORACLE = {
    "series_moving_average": f"select event_id, round(avg(value) {_W} rows between 2 preceding and current row), 6) as smoothed from events",
    "series_weighted_moving_average": f"""with w as (select event_id, value, lag(value, 1) {_W}) as a, lag(value, 2) {_W}) as b, row_number() {_W}) as n from events)
select event_id, round((value * 3 + coalesce(a, 0) * 2 + coalesce(b, 0)) / case n when 1 then 3 when 2 then 5 else 6 end, 6) as smoothed from w""",
    "series_ewma_final": "select user_id, round(list_reduce(list(value order by ts, event_id), lambda s, x: s * 0.3::double + x * (1 - 0.3::double)), 6) as smoothed from events group by 1",
    "series_ewma_full": """with recursive o as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events),
r(user_id, n, event_id, s) as (select user_id, n, event_id, value from o where n = 1 union all select o.user_id, o.n, o.event_id, r.s * 0.3::double + o.value * (1 - 0.3::double) from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select event_id, round(s, 6) as smoothed from r""",
    "series_extend": f"""with d as ({_DAILY}), l as (select event_type, list(value order by day)[-5:] as x from d group by 1)
select event_type, round(x[2] + list_sum(list_transform(range(1, len(x)), lambda i: (x[len(x)] - x[i]) / (len(x) - i))), 6) as next from l""",
    "series_gap_sessions": f"""with g as (select user_id, event_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) {_W})) > 21600000000 then 1 else 0 end as n from events),
s as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, cast(session as bigint) as session, count(*) as n, min(event_id) as first_id from s group by 1, 2""",
    "series_hourly_sum": f"with {_HOURLY} select g.event_type, g.tick, round(coalesce(s, 0), 6) as value from g left join b using (event_type, tick)",
    "series_hourly_mean": f"with {_HOURLY} select g.event_type, g.tick, round(m, 6) as value from g left join b using (event_type, tick)",
    "series_hourly_flagship": f"""with {_HOURLY}, r as (select g.event_type, g.tick, m from g left join b using (event_type, tick)),
k as (select *, last_value(case when m is not null then struct_pack(t := tick, v := m) end ignore nulls) over (partition by event_type order by tick rows unbounded preceding) as p,
 first_value(case when m is not null then struct_pack(t := tick, v := m) end ignore nulls) over (partition by event_type order by tick rows between current row and unbounded following) as q from r),
l as (select event_type, tick, case when m is not null then m else p.v + (q.v - p.v) * ((tick - p.t)::double / (q.t - p.t)) end as f from k)
select event_type, tick, round(avg(f) over (partition by event_type order by tick rows between 2 preceding and current row), 6) as smoothed from l""",
    "series_auto_step": """with t as (select distinct o_orderstatus, cast(floor(epoch_us(o_orderdate) / 86400000000) as bigint) as day from orders),
s as (select o_orderstatus, day - min(day) over (partition by o_orderstatus) as x from t)
select o_orderstatus, cast(list_reduce(list(x), lambda a, b: gcd(a, b)) as double) as step from s group by 1""",
    "series_regrid": f"with {_GRID} select l_returnflag, day, round(revenue, 4) as revenue from reg",
    "series_interpolate_linear": f"with {_KNOWN} select l_returnflag, day, case when revenue is not null then revenue else {_LINE.format(a='p', b='q')} end as filled from k where q is not null union all "
    f"select l_returnflag, day, v1 + (v2 - v1) * ((day - t1)::double / (t2 - t1)) as filled from (select k.l_returnflag, k.day, x.t1, x.v1, x.t2, x.v2 from k join (select l_returnflag, l[-2].t as t1, l[-2].v as v1, l[-1].t as t2, l[-1].v as v2 from (select l_returnflag, list(struct_pack(t := day, v := revenue) order by day) as l from k where revenue is not null group by 1)) x using (l_returnflag) where k.q is null)",
    "series_interpolate_previous": f"with {_KNOWN} select l_returnflag, day, p.v as filled from k",
    "series_interpolate_zero": f"with {_KNOWN} select l_returnflag, day, coalesce(p.v, q.v) as filled from k",
    "series_interpolate_next": f"with {_KNOWN} select l_returnflag, day, q.v as filled from k",
    "series_interpolate_nearest": f"with {_KNOWN} select l_returnflag, day, case when q is null or day - p.t <= q.t - day then p.v else q.v end as filled from k",
    "series_interpolate_nearest_up": f"with {_KNOWN} select l_returnflag, day, case when q is null or day - p.t < q.t - day then p.v else q.v end as filled from k",
    "series_interpolate_quadratic": _SPLINE,
    "series_interpolate_cubic": _CUBIC,
    "series_standardize": _CUBIC,
    "series_minmax": f"with {_HOURLY}, v as (select g.event_type, g.tick, coalesce(s, 0) as value from g left join b using (event_type, tick)) select event_type, tick, round((value - min(value) over (partition by event_type)) / (max(value) over (partition by event_type) - min(value) over (partition by event_type)), 6) as value from v",
    "series_row_normalize": "select p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) as size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) as price from part",
    "series_local_extrema": f"with d as ({_DAILY}), n as (select *, coalesce(lag(value) over (partition by event_type order by day), value) as a, coalesce(lead(value) over (partition by event_type order by day), value) as b from d) select event_type, day, round(value, 6) as value from n where value >= a and value >= b",
    "series_holt_winters": f"""with recursive d as ({_DAILY}), o as (select *, row_number() over (partition by event_type order by day) as n, first_value(value) over (partition by event_type order by day) as x0, nth_value(value, 2) over (partition by event_type order by day rows between unbounded preceding and unbounded following) as x1 from d),
r(event_type, n, day, l, b) as (select event_type, n, day, 0.4::double * value + 0.6::double * (x0 + (x1 - x0)), 0.2::double * ((0.4::double * value + 0.6::double * (x0 + (x1 - x0))) - x0) + 0.8::double * (x1 - x0) from o where n = 1
 union all select o.event_type, o.n, o.day, 0.4::double * o.value + 0.6::double * (r.l + r.b), 0.2::double * ((0.4::double * o.value + 0.6::double * (r.l + r.b)) - r.l) + 0.8::double * r.b from r join o on o.event_type = r.event_type and o.n = r.n + 1)
select event_type, day, round(l + b, 6) as forecast from r""",
    "series_autocorrelation": f"""with d as ({_DAILY}), c as (select event_type, day, value - avg(value) over (partition by event_type) as m from d), l as (select *, lag(m, 1) over w as a, lag(m, 2) over w as b, lag(m, 3) over w as c from c window w as (partition by event_type order by day))
select event_type, round(sum(m * coalesce(a, 0)) / sum(m * m), 6) as acf1, round(sum(m * coalesce(b, 0)) / sum(m * m), 6) as acf2, round(sum(m * coalesce(c, 0)) / sum(m * m), 6) as acf3 from l group by 1""",
    "series_from_table": "select event_type as entity, row_number() over (partition by event_type order by event_id) - 1 as ts, event_id from events",
    "series_slice": "with n as (select *, row_number() over (partition by event_type order by ts, event_id) - 1 as n from events) select event_type, event_id from n where n >= 2 and n < 50 and (n - 2) % 3 = 0",
    "dist_lp_norm": "select a.label, round(avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double))))), 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by 1",
    "dist_sbd": f"with {_PAIR}, s as (select a.day - b.day as k, sum(a.x * b.y) as c from pair a, pair b group by 1) select round(1 - greatest(least(max(c) / (select sqrt(sum(x * x)) * sqrt(sum(y * y)) from pair), 1), -1), 6) as distance from s",
    "series_spectral_residual": f"""with recursive d as ({_DAILY}), l as (select event_type, list(value order by day) as x, list(day order by day) as days from d group by 1),
 r(event_type, k, x) as (select event_type, 0, x from l union all select event_type, k + 1, list_append(x, x[len(x) - 3] + (x[len(x)] - x[len(x) - 4]) / 4 + (x[len(x)] - x[len(x) - 3]) / 3 + (x[len(x)] - x[len(x) - 2]) / 2 + x[len(x)] - x[len(x) - 1]) from r where k < 5),
 e as (select event_type, x, len(x) as m from r where k = 5), p as (select event_type, m, unnest(range(m)) as j, unnest(x) as v from e),
 f as (select a.event_type, a.m, k.j as k, sum(a.v * cos(2 * pi() * a.j * k.j / a.m)) as re, -sum(a.v * sin(2 * pi() * a.j * k.j / a.m)) as im from p a join p k on a.event_type = k.event_type group by 1, 2, 3),
 g as (select *, sqrt(re * re + im * im) as amp from f), h as (select *, exp(ln(amp) - avg(ln(amp)) over (partition by event_type order by k rows between 2 preceding and current row)) / amp as s from g),
 y as (select p.event_type, p.j, sqrt(pow(sum(s * (re * cos(2 * pi() * p.j * k / h.m) - im * sin(2 * pi() * p.j * k / h.m))), 2) + pow(sum(s * (re * sin(2 * pi() * p.j * k / h.m) + im * cos(2 * pi() * p.j * k / h.m))), 2)) / max(h.m) as v from p join h on h.event_type = p.event_type group by 1, 2)
 select event_type, days[j + 1] as day, round(v, 5) as saliency from y join l using (event_type) where j < len(days)""",
    "dist_dtw": f"with recursive {_warped('1')} select round(distance, 6) as distance from w",
    "dist_dtw_pruned": f"with recursive {_warped('day // 7')} select g as week, round(distance, 6) as distance from w where distance <= 3200",
    "dist_lb_kim": f"with {_PAIR} select round(greatest(abs(arg_min(x, day) - arg_min(y, day)), abs(arg_max(x, day) - arg_max(y, day)), abs(max(x) - max(y)), abs(min(x) - min(y))), 6) as bound from pair",
    "dist_lb_keogh": f"with {_PAIR}, e as (select greatest(y - max(x) over w, min(x) over w - y, 0) as e from pair window w as (order by day rows between 2 preceding and 2 following)) select round(sum(e), 6) as bound from e",
    "dist_lb_keogh_reversed": f"with {_PAIR}, e as (select greatest(x - max(y) over w, min(y) over w - x, 0) as e from pair window w as (order by day rows between 2 preceding and 2 following)) select round(sum(e), 6) as bound from e",
    "stat_kl_div": """with m as (select event_type, avg(value) as mean, var_pop(value) * (1 + pow(1.0::double / count(*), 0.4::double) / (1 - 1.0::double / count(*))) as v from events group by 1)
select a.event_type, b.event_type as other, round(0.5::double * (a.v / b.v + (a.mean - b.mean) * (a.mean - b.mean) / b.v - 1 - ln(a.v / b.v)), 6) as divergence from m a join m b on a.event_type < b.event_type""",
    "stat_quantile_exact": "select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, min(l_extendedprice) as low, max(l_extendedprice) as high, count(l_extendedprice) as n from lineitem group by 1",
    "stat_tdigest": "select l_returnflag, min(l_extendedprice) as low, max(l_extendedprice) as high, count(*) as n, true as close from lineitem group by 1",
    "vec_sequences": "select conv_id, count(*) as turns, cast(arg_min(length(text), turn) as bigint) as first_len from conversations group by 1",
}
