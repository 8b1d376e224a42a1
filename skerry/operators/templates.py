"""Templates of token sequences: by counts in a prefix tree, and by degrees in a layered graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import tokens
from skerry.storage import cut

END = "<END>"
INVALID = "invalid"
#: Up to so many edges are broadcast to texts or paths; beyond, these are joined by shuffling.
BROADCAST_ROWS = 250_000


def prefix_counts(df: DataFrame, text: str, mark: str) -> DataFrame:
    """prefix, depth, n and the share of n in the count of its first token. Equal texts are counted before prefixes are made."""
    t = df.filter(F.col(text).isNotNull()).groupBy(tokens(F.col(text), mark).alias("toks")).agg(F.count(F.lit(1)).alias("c"))
    p = t.select("c", "toks", F.explode(F.sequence(F.lit(1), F.size("toks"))).alias("depth")).groupBy(F.slice("toks", F.lit(1), F.col("depth")).alias("prefix"), "depth").agg(F.sum("c").alias("n"))
    first = p.filter("depth = 1").select(F.col("prefix")[0].alias("_f"), F.col("n").alias("_n"))
    return p.withColumn("_f", F.col("prefix")[0]).join(first, "_f").select("prefix", "depth", "n", (F.col("n") / F.col("_n")).alias("share"))


def prefix_templates(df: DataFrame, text: str, mark: str, threshold: float = 0.1, wild: str = "*") -> DataFrame:
    """Each different text with its template. Level by level: children of a node with at most `threshold` of its count are low; if more than one is, those
    that share a grandchild with another low one become the wild token, with a wild child if there is one. Tokens already changed name the node of the next level."""
    t = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("c"))
    t = cut(t.withColumn("path", F.concat(tokens(F.col("text"), mark), F.array(F.lit(END)))))
    depth = t.agg(F.max(F.size("path"))).first()[0] or 0
    for d in range(2, depth):  # first tokens hang from the root, which merges nothing
        at = t.filter(F.size("path") > d)
        key = at.select(F.slice("path", 1, d - 1).alias("node"), F.col("path")[d - 1].alias("child"), F.col("path")[d].alias("grand"), "c")
        grand = key.groupBy("node", "child", "grand").agg(F.sum("c").alias("c"))
        kids = grand.groupBy("node", "child").agg(F.sum("c").alias("c"))
        total = t.filter(F.size("path") >= d).groupBy(F.slice("path", 1, d - 1).alias("node")).agg(F.sum("c").alias("total"))
        low = kids.filter(F.col("child") != END).join(total, "node").filter(F.col("c") / F.col("total") <= threshold)
        several = low.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("node")
        low = low.select("node", "child").join(several, "node")
        shared = grand.join(low, ["node", "child"], "left_semi").groupBy("node", "grand").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("node", "grand")
        go = grand.join(low, ["node", "child"], "left_semi").join(shared, ["node", "grand"], "left_semi").select("node", "child").distinct()
        kinds = go.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("node")
        go = go.join(kinds, "node", "left_semi").withColumn("_go", F.lit(True)).withColumnsRenamed({"node": "_node", "child": "_child"})
        t = t.join(go, (F.slice("path", 1, d - 1) == F.col("_node")) & (F.get("path", F.lit(d - 1)) == F.col("_child")), "left")
        changed = F.transform("path", lambda x, i: F.when((i == d - 1), F.lit(wild)).otherwise(x))
        t = cut(t.withColumn("path", F.when(F.col("_go"), changed).otherwise(F.col("path"))).select("text", "c", "path"))
    return t.select("text", F.col("c").alias("n"), F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), mark).alias("template"))


def apply_templates(df: DataFrame, text: str, templates: DataFrame, mark: str, wild: str = "*") -> DataFrame:
    """Template of new texts: from the tree's root the same token if there is one, else the wild one, never back; `invalid` where neither is or the end isn't one."""
    nodes = templates.select(F.concat(F.split("template", "\\Q" + mark + "\\E", -1), F.array(F.lit(END))).alias("p")).distinct()
    nodes = cut(nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i))).alias("pre")).distinct())
    t = df.select(F.col(text).alias("text")).distinct().withColumn("_t", F.concat(tokens(F.col("text"), mark), F.array(F.lit(END)))).withColumn("_p", F.array().cast("array<string>"))
    depth = nodes.agg(F.max(F.size("pre"))).first()[0] or 0
    for d in range(depth):
        same, other = F.concat("_p", F.array(F.get("_t", F.lit(d)))), F.concat("_p", F.array(F.lit(wild)))
        a, b = nodes.select(F.col("pre").alias("_a")), nodes.select(F.col("pre").alias("_b"))
        on = (F.size("_t") > d) & (F.size("_p") == d)
        t = t.withColumn("_s", F.when(on, same)).withColumn("_w", F.when(on & (F.get("_t", F.lit(d)) != END), other)).join(a, F.col("_s") == F.col("_a"), "left").join(b, F.col("_w") == F.col("_b"), "left")
        t = t.withColumn("_p", F.coalesce("_a", "_b", "_p")).drop("_a", "_b", "_s", "_w")
    ok = (F.size("_p") == F.size("_t")) & (F.element_at("_p", -1) == END)
    done = t.select("text", F.when(ok, F.array_join(F.slice("_p", F.lit(1), F.size("_p") - 1), mark)).otherwise(INVALID).alias("template"))
    return df.join(done.withColumnRenamed("text", text), text, "left")


def layer_edges(df: DataFrame, text: str, mark: str) -> DataFrame:
    """layer, src and dst of all different consecutive tokens, with <END> behind the last."""
    p = df.select(F.concat(tokens(F.col(text), mark), F.array(F.lit(END))).alias("p")).distinct()
    return p.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(i.alias("layer"), F.get("p", i).alias("src"), F.get("p", i + 1).alias("dst")))).alias("e")).select("e.*").distinct()


def layer_candidates(df: DataFrame, text: str, mark: str, threshold: int = 10) -> DataFrame:
    """Pairs of tokens two layers apart that at least `threshold` different tokens lie between."""
    e = layer_edges(df, text, mark)
    two = e.alias("a").join(e.alias("b"), (F.col("a.dst") == F.col("b.src")) & (F.col("a.layer") + 1 == F.col("b.layer")))
    return two.groupBy(F.col("a.layer").alias("layer"), F.col("a.src").alias("start"), F.col("b.dst").alias("end")).agg(F.countDistinct("a.dst").alias("n")).filter(F.col("n") >= threshold)


def _sent(df: DataFrame) -> DataFrame:
    """A table that many rows of few keys are joined to: broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def merge_layers(edges: DataFrame, threshold: int, wild: str = "*") -> DataFrame:
    """The layered graph (layer, src, dst) with a wild token wherever `threshold` tokens lie between two; start tokens in order. A token between keeps its edge to the start
    if it leads elsewhere too, and its edge to the end if another start leads to it.

    Layer by layer, by joins. The order of a layer's starts matters in two places only: a token between loses its edges to ends if the last start is the only one left that leads to it, all before having given it up;
    and where a start leads to the wild token already, that counts as one between for an end that the wild token leads to, by itself or since an earlier start."""
    edges = cut(edges.select("layer", "src", "dst").distinct())
    last, least = edges.agg(F.max("layer")).first()[0], max(threshold, 1)
    if last is None:
        return edges
    here, done = edges.filter("layer = 0").select(F.col("src").alias("start"), F.col("dst").alias("mid")), []
    for layer in range(last):
        below = edges.filter(F.col("layer") == layer + 1).select(F.col("src").alias("mid"), F.col("dst").alias("end"))
        into = here.filter(F.col("mid") != wild)
        leads = into.filter(F.col("mid") != END) if below.filter(F.col("mid") == END).isEmpty() else into  # else all ends of one layer meet nothing in one task
        paths = leads.join(below, "mid")
        near = cut(paths.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least - 1))
        good = near.filter(F.col("n") >= least).select("start", "end")
        through = here.filter(F.col("mid") == wild).select("start")
        if not through.isEmpty():
            first = good.groupBy("end").agg(F.min("start").alias("first"))
            known = below.filter(F.col("mid") == wild).select("end", F.lit(True).alias("known"))
            more = near.filter(F.col("n") == least - 1).join(through, "start", "left_semi").join(first, "end", "left").join(known, "end", "left")
            good = good.unionByName(more.filter(F.col("known") | (F.col("first") < F.col("start"))).select("start", "end"))
        good = cut(good)
        if not good.isEmpty():
            hit = paths.join(_sent(good), ["start", "end"]).select("start", "mid", "end")
            met = hit.groupBy("start", "mid").agg(F.count(F.lit(1)).alias("k")).join(below.groupBy("mid").agg(F.count(F.lit(1)).alias("ends")), "mid")
            met = cut(met.select("start", "mid", (F.col("k") == F.col("ends")).alias("gone")))
            who = into.groupBy("mid").agg(F.count(F.lit(1)).alias("starts"), F.max("start").alias("last"))
            late = F.col("start") == F.col("last")
            alone = met.join(who, "mid").groupBy("mid", "last", "starts").agg(F.max(late).alias("met"), F.sum((~late & F.col("gone")).cast("long")).alias("before"))
            alone = alone.filter(F.col("met") & (F.col("before") == F.col("starts") - 1)).select(F.col("last").alias("start"), "mid")
            lost = hit.join(alone, ["start", "mid"], "left_semi").select("mid", "end")
            here = here.join(met.filter("gone").select("start", "mid"), ["start", "mid"], "left_anti").unionByName(good.select("start", F.lit(wild).alias("mid"))).distinct()
            below = cut(below.join(lost, ["mid", "end"], "left_anti").unionByName(good.select(F.lit(wild).alias("mid"), "end")).distinct())
        done.append(here.select(F.lit(layer).alias("layer"), F.col("start").alias("src"), F.col("mid").alias("dst")))
        here = below.withColumnsRenamed({"mid": "start", "end": "mid"})
    done.append(here.select(F.lit(last).alias("layer"), F.col("start").alias("src"), F.col("mid").alias("dst")))
    return cut(reduce(DataFrame.unionByName, done))


def layer_templates(df: DataFrame, text: str, mark: str, threshold: int = 10, wild: str = "*") -> DataFrame:
    """Each different text with its template, by the merged layered graph; texts are encoded by joins."""
    merged = merge_layers(layer_edges(df, text, mark), threshold, wild)
    return encode_layers(df.select(F.col(text).alias("text")), merged, mark, wild)


def encode_layers(texts: DataFrame, edges: DataFrame, mark: str, wild: str = "*") -> DataFrame:
    """text and template of different texts: all ways that the graph has for a text's tokens, each the same or the wild one, grow layer by layer; of those that reach <END> the one stands that keeps the
    first token that another gives up. `invalid` where none does."""
    t = cut(texts.filter("text is not null").distinct().withColumn("t", tokens(F.col("text"), mark)))
    depth = t.agg(F.max(F.size("t"))).first()[0] or 0
    starts = _sent(edges.filter("layer = 0").select(F.col("src").alias("at")).distinct())
    own = F.array_distinct(F.array(F.get("t", F.lit(0)), F.lit(wild)))
    ways = t.select("text", "t", F.explode(own).alias("at")).join(starts, "at", "left_semi")
    ways = ways.select("text", "t", F.array("at").alias("p"), F.when(F.col("at") == F.get("t", F.lit(0)), "1").otherwise("0").alias("kept"))
    done = None
    for d in range(depth):
        last = F.element_at("p", -1)
        step = edges.filter(F.col("layer") == d).select("src", "dst")
        stop = _sent(step.filter(F.col("dst") == END).select(F.col("src").alias("_s")))
        ends = ways.filter(F.size("t") == d + 1).join(stop, last == F.col("_s"), "left_semi").select("text", "p", "kept")
        done = ends if done is None else done.unionByName(ends)
        on = ways.filter(F.size("t") > d + 1).withColumn("_last", last).withColumn("_next", F.get("t", F.lit(d + 1)))
        same = on.join(_sent(step), (F.col("_last") == F.col("src")) & (F.col("_next") == F.col("dst")), "left_semi")  # a token is never held against all that follow another
        other = on.filter(F.col("_next") != wild).join(_sent(step.filter(F.col("dst") == wild).select("src")), F.col("_last") == F.col("src"), "left_semi")
        ways = cut(same.select("text", "t", F.concat("p", F.array("_next")).alias("p"), F.concat("kept", F.lit("1")).alias("kept")).unionByName(other.select("text", "t", F.concat("p", F.array(F.lit(wild))).alias("p"), F.concat("kept", F.lit("0")).alias("kept"))))
    if done is None:
        return t.select("text", F.lit(INVALID).alias("template"))
    best = done.groupBy("text").agg(F.max(F.struct("kept", "p"))["p"].alias("p"))
    return t.select("text").join(best, "text", "left").select("text", F.coalesce(F.array_join("p", mark), F.lit(INVALID)).alias("template"))
