"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Each rule has a condition that rejects. On a sample, every rule's cost (seconds for the sample's rows beyond a bare scan) and selectivity (share of
rows it rejects) are measured, rules are ordered by rejection per cost, and the cascade is one CASE expression in that order: Spark evaluates a branch only where
all earlier ones let the row pass. The order changes what is computed, never the verdict; as costs are seconds, rejected_by can differ from run to run, unless the order of an earlier run is given.

Defined results: a null text has no words, fails the base and is not kept, as an empty one; repeated rows each get their own result; an
empty table gives an empty result; other columns stay unless they bear the names added here, which are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
NGRAM = 8
#: Rows of the sample that rules are measured on, about.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition under which a text goes."""

    name: str
    rejects: str


def flat(text: Column) -> Column:
    """The text with each ASCII white space as a space; a null as an empty text. Byte-wise replacement is several times faster than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE[:-1]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(flat_text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.array_remove(F.split(flat_text, " ", -1), "")


def without(text: Column, characters: str) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in characters:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also where use has it in the function of an array operation (Spark would write it out there and compute it for each element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(w: Column, n: int = NGRAM) -> Column:
    """Words in windows of n words that occur at least twice in w. Windows are told apart by 64-bit hashes; only texts with an equal pair are sorted."""

    def covered(starts: Column) -> Column:  # in order: each covers n words or up to the next start
        width = F.transform(starts, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - x, F.lit(n))))
        return F.aggregate(width, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def starts_of(pairs: Column) -> Column:  # sorted by hash: equal ones are neighbours
        same = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), let(pairs, lambda p: let(starts_of(p), covered))).otherwise(F.lit(0).cast("long"))

    def pair(step: int):  # hashes of windows of 2 * step words from those of step words
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def windows(ids: Column) -> Column:
        out, step = ids, 1
        while step < n:
            out, step = let(out, pair(step)), 2 * step
        return F.slice(out, F.lit(1), F.size(ids) - (n - 1))

    if n & (n - 1):
        raise ValueError("n must be a power of two")
    return F.when(F.size(w) > n, let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), count)).otherwise(F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _w, the words."""
    t = F.col(text)
    bare = F.char_length(F.replace("_flat", F.lit(" "), F.lit(""))).cast("long")
    symbols = (F.octet_length(F.coalesce(t, F.lit(""))) - F.octet_length(without(t, SYMBOLS))).cast("long")
    df = docs.withColumn("_flat", flat(t))
    df = df.withColumn("_w", words(F.col("_flat")))
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "word_chars": bare, "n_symbols": symbols, "n_dup_lines": dup_lines(t), "n_repeat_words": repeat_words(F.col("_w"))}).drop("_flat")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


#: Rules beyond the base. `_w` are a text's words, `_t` is the text; each condition is SQL, so that a set of rules can be stored with its order.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * size(split(_t, '\\n'))"),
    Rule("stutter", "3 * size(filter(_w, (x, i) -> x = get(_w, i + 1))) > n_words"),
    Rule("shouting", "_t rlike '[A-Z]' and not _t rlike '[a-z]'"),
    Rule("digits", "2 * (octet_length(_t) - octet_length(" + "replace(" * 10 + "_t" + "".join(f", '{d}', '')" for d in range(10)) + ")) > word_chars"),
    Rule("bullets", "10 * size(filter(split(_t, '\\n'), x -> x rlike '^[ \\t]*[-*\\u2022]')) > 9 * size(split(_t, '\\n'))"),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, runs: int = 2) -> list[tuple[Rule, float, float]]:
    """Cost in seconds and rejected share of each rule on a sample of about sample_rows rows, each row drawn on its own, copies and nulls too."""
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    drawn = docs.select("text") if n <= sample_rows else docs.select("text").sample(False, sample_rows / n, 5)
    sample = measures(drawn).withColumn("_t", F.coalesce("text", F.lit(""))).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_w", "_t", F.lit(0).alias("_none")).cache()
    try:
        rows = sample.count()

        def timed(condition: str) -> tuple[float, int]:
            best, hits = float("inf"), 0
            for _ in range(runs):
                at = time.perf_counter()
                hits = sample.agg(F.count_if(F.expr(condition)).alias("n")).first()[0]
                best = min(best, time.perf_counter() - at)
            return best, hits

        timed("_none = 1")
        bare = timed("_none = 1")[0]
        out = []
        for r in rules:
            cost, hits = timed(r.rejects)
            out.append((r, max(cost - bare, 1e-3), hits / rows if rows else 0.0))
        return out
    finally:
        sample.unpersist()


def order(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejected share per second, the best first; ties by name."""
    return [r for r, cost, share in sorted(estimates, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name))]


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rejected_by (base, the first rule in the order given that rejects, or null) and kept."""
    df = measured.withColumn("_t", F.coalesce("text", F.lit("")))
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        verdict = verdict.when(F.expr(r.rejects), F.lit(r.name))
    return df.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("_t")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ordered: list[Rule] | None = None) -> DataFrame:
    """docs with their measures, rejected_by and kept; rules in the order given, else in that of estimates on docs."""
    out = cascade(measures(docs), order(estimate(docs, rules)) if ordered is None else ordered)
    return out.drop("_w")
