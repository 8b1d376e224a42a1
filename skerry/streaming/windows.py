"""Structured Streaming forms: tumbling sums, gap sessions, mergeable digests, and keyed state: exponential averages, early stopping, accumulated metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumble(stream: DataFrame, keys: list[str], at: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    """Sum, mean and count by window, with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "sum", "mean", "n")


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions parted by a gap, with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def digest_sink(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str):
    """Starts a query that adds each micro-batch's digests to a Parquet table, a folder a batch, so that a repeated batch replaces its own; `merged_digests` reads it."""
    from skerry.operators.sketch import digest

    def add(batch: DataFrame, n: int) -> None:
        digest(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def merged_digests(df: DataFrame, keys: list[str]) -> DataFrame:
    """One digest a key from many."""
    import numpy as np
    import pandas as pd

    from skerry.operators.sketch import STATE, merge

    head = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def run(key, pdf):
        m, c = merge(np.array([x["mean"] for r in pdf["clusters"] for x in r]), np.array([x["cnt"] for r in pdf["clusters"] for x in r], np.int64))
        return pd.DataFrame([[*key, pdf["min"].min(), pdf["max"].max(), int(c.sum()), [{"mean": float(a), "cnt": int(b)} for a, b in zip(m, c, strict=True)]]], columns=[*keys, "min", "max", "total", "clusters"])

    return df.select(*keys, "min", "max", "total", "clusters").groupBy(*keys).applyInPandas(run, f"{head}, {STATE}")


def _stateful(stream: DataFrame, keys: list[str], at: str, values: list[str], schema: str, state: str, step):
    """Rows of a key in the order of `at` within a micro-batch, through step(state, row values) -> (state, output row); the state outlives batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(stream.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    names = [*keys, at, *[c.split()[0] for c in schema.split(", ")]]

    def run(key, pdfs, held):
        now, rows = held.get if held.exists else None, pd.concat(list(pdfs)).sort_values([at, *values], kind="stable")
        out = []
        for t, *v in rows[[at, *values]].itertuples(index=False):
            now, row = step(now, v)
            out.append([*key, t, *row])
        held.update(now)
        yield pd.DataFrame(out, columns=names)

    return stream.select(*keys, at, *values).groupBy(*keys).applyInPandasWithState(run, f"{head}, `{at}` {kinds[at]}, {schema}", state, "append", GroupStateTimeout.NoTimeout)


def ewma(stream: DataFrame, keys: list[str], at: str, value: str, alpha: float) -> DataFrame:
    """keys, at and the exponential average so far of each row; rows that come late are averaged when they come."""

    def step(now, v):
        out = float(v[0]) if now is None else alpha * float(v[0]) + (1 - alpha) * now[0]
        return (out,), (out,)

    return _stateful(stream, keys, at, [value], "smoothed double", "smoothed double", step)


def early_stop(stream: DataFrame, keys: list[str], at: str, metric: str, how: str = "desc", warmup: int = 20, laziness: int = 4, tolerance: float = 1e-3) -> DataFrame:
    """keys, at, lazy and done of each step of running trainings, by the rule of `learn.early_stop`."""
    sign = 1.0 if how == "desc" else -1.0

    def step(now, v):
        best, lazy, n = now or (float("inf"), -1, 0)
        m = sign * float(v[0])
        lazy = -1 if m < best + tolerance else lazy + 1
        return (min(best, m), lazy, n + 1), (lazy, n >= warmup and lazy >= laziness)

    return _stateful(stream, keys, at, [metric], "lazy int, done boolean", "best double, lazy int, n int", step)


def accumulate(stream: DataFrame, keys: list[str], at: str, attrs: list[str]) -> DataFrame:
    """keys, at and the sum so far of each attribute."""
    schema = ", ".join(f"{a} double" for a in attrs)

    def step(now, v):
        out = tuple((now[i] if now else 0.0) + float(x) for i, x in enumerate(v))
        return out, out

    return _stateful(stream, keys, at, attrs, schema, schema, step)
