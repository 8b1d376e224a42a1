"""Fluent forms: a frame of series by entity, and estimators with fit, transform and predict."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import contracts
from skerry.operators import series, sketch, templates
from skerry.operators.ranks import numbered
from skerry.sources import tables


class SeriesFrame:
    """entity, ts (a whole number) and attributes. Every method returns a new frame; nothing runs until rows are asked for."""

    def __init__(self, df: DataFrame):
        contracts.columns(df, ["entity", "ts"])
        self.df = df

    @classmethod
    def from_table(cls, df: DataFrame, entity: str | None = None, timestamp: str | None = None, order: list[str] | None = None) -> SeriesFrame:
        return cls(tables.series(df, entity, timestamp, order))

    @property
    def attrs(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("entity", "ts")]

    def entities(self) -> DataFrame:
        """Entities in order of their first time."""
        return self.df.groupBy("entity").agg(F.min("ts").alias("first")).orderBy("first", "entity")

    def __getitem__(self, key: int | str | slice) -> SeriesFrame:
        """By place in the order of entities, by name, or a range of places."""
        if isinstance(key, str):
            if self.df.filter(F.col("entity") == key).isEmpty():
                raise ValueError(f"no entity {key!r}")
            return self.entity(key)
        places = numbered(self.df.groupBy("entity").agg(F.min("ts").alias("_first")), ["_first", "entity"], "_k")
        if isinstance(key, slice):
            start, stop, step = key.indices(places.count())
            n = len(range(start, stop, step))
            at = (F.col("_k") - start) / step
            chosen = places.filter((at >= 0) & (at < n) & ((F.col("_k") - start) % abs(step) == 0))
        elif isinstance(key, int) and not isinstance(key, bool):
            chosen = places.filter(F.col("_k") == contracts.whole(key, 0, places.count() - 1, name="entity"))
        else:
            raise ValueError(f"{key!r} is no place, name or range of entities")
        return SeriesFrame(self.df.join(chosen.select("entity"), "entity", "left_semi"))

    def __repr__(self) -> str:
        return f"SeriesFrame({', '.join(f'{c}: {t}' for c, t in self.df.dtypes)})"

    def show(self, rows: int = 20) -> None:
        self.df.orderBy("entity", "ts").show(rows)

    def entity(self, name: str) -> SeriesFrame:
        return SeriesFrame(self.df.filter(F.col("entity") == name))

    def rows(self, start: int, stop: int, step: int = 1) -> SeriesFrame:
        return SeriesFrame(series.rows_between(self.df, ["entity"], ["ts"], start, stop, step))

    def attr(self, which: int | str) -> DataFrame:
        name = self.attrs[contracts.whole(which, 0, len(self.attrs) - 1)] if isinstance(which, int) else contracts.option(which, self.attrs, "attribute")
        return self.df.select("entity", "ts", name)

    def add_attr(self, name: str, value: Column | DataFrame | list[float]) -> SeriesFrame:
        """An expression over the frame; a table of entity, ts and value with a row for each; or a list, for a frame of one entity, in the order of time. One that is there is replaced, with a warning."""
        if name in self.attrs:
            warnings.warn(f"attribute {name} is replaced", stacklevel=2)
        if isinstance(value, Column):
            return SeriesFrame(self.df.withColumn(name, value))
        rest = self.df.drop(name) if name in self.attrs else self.df
        if isinstance(value, list):
            tables.one_entity(self.df)
            if len(value) != self.df.count():
                raise ValueError(f"{len(value)} values for {self.df.count()} rows")
            spark = self.df.sparkSession
            new = spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], f"_k long, `{name}` double")
            return SeriesFrame(numbered(rest, ["ts"], "_k").join(new, "_k").drop("_k"))
        new = value.select("entity", "ts", F.col("value").alias(name))
        if new.join(rest, ["entity", "ts"], "left_anti").limit(1).count() or rest.join(new, ["entity", "ts"], "left_anti").limit(1).count():
            raise ValueError(f"{name} has not a row for each of the frame")
        return SeriesFrame(rest.join(new, ["entity", "ts"]))

    def del_attr(self, name: str) -> SeriesFrame:
        return SeriesFrame(self.df.drop(contracts.option(name, self.attrs, "attribute")))

    def format_timestamp(self, step: int, start: int | None = None) -> SeriesFrame:
        return SeriesFrame(series.regrid(self.df, ["entity"], "ts", self.attrs, step, start))

    def aggregate_timestamp(self, step: int, how: str = "sum", start: int | None = None) -> SeriesFrame:
        out = None
        for a in self.attrs:
            one = series.tumble(self.df, ["entity"], "ts", a, step, how, start, a)
            out = one if out is None else out.join(one, ["entity", "ts"])
        return SeriesFrame(out)

    def interpolate(self, kind: str = "linear") -> SeriesFrame:
        df = self.df
        for a in self.attrs:
            df = series.interpolate(df, ["entity"], "ts", a, kind, "_f").drop(a).withColumnRenamed("_f", a)
        return SeriesFrame(df.select("entity", "ts", *self.attrs))

    def standardize(self) -> SeriesFrame:
        """Each frame's own greatest common step, then cubic interpolation; one step for all entities."""
        step = int(series.auto_step(self.df.select("ts", F.lit(0).alias("g")), ["g"], F.col("ts")).first()["step"]) or 1
        return self.format_timestamp(step).interpolate("cubic")

    def preprocessing(self, method: str = "minmax") -> SeriesFrame:
        contracts.option(method, ("minmax", "normalize"), "method")
        return SeriesFrame(series.minmax(self.df, ["entity"], self.attrs) if method == "minmax" else series.normalize_rows(self.df, self.attrs))

    def write(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SeriesFrame:
        return cls(spark.read.parquet(path))


class Smoother:
    """fit keeps nothing but its parameters, which save and load store as JSON; transform smooths one value column by entity and order."""

    KINDS = {"moving": series.moving_average, "weighted": series.weighted_moving_average, "exponential": series.ewma}
    KERNELS = {"spectral_residual": series.spectral_residual, "holt_winters": series.holt_winters, "holt_winters_fitted": series.fit_holt_winters, "arima": series.arima}

    def __init__(self, kind: str, **params):
        contracts.option(kind, [*self.KINDS, *self.KERNELS], "kind")
        self.kind, self.params = kind, params

    def fit(self, df: DataFrame) -> Smoother:
        return self

    def transform(self, df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "smoothed") -> DataFrame:
        if self.kind in self.KINDS:
            return self.KINDS[self.kind](df, keys, order, value, **self.params, out=out)
        kernel, params = self.KERNELS[self.kind], self.params
        return series.per_entity(df, keys, order, value, lambda x: kernel(x, **params), out)

    def fit_transform(self, df: DataFrame, *args, **kw) -> DataFrame:
        return self.fit(df).transform(df, *args, **kw)

    def save(self, spark: SparkSession, path: str) -> None:
        save_settings(spark, path, {"kind": self.kind, "params": self.params})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Smoother:
        d = load_settings(spark, path)
        return cls(d["kind"], **d["params"])


def save_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Settings (or weights) as one row of JSON, by Spark's own writers, so that the folder may be in any store."""
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])


class TDigest:
    """fit makes one digest a key; predict gives quantiles; more fits add to it."""

    def __init__(self, buffer: int = 10_000, delta: float = 57):
        self.buffer, self.delta, self.state, self.keys = buffer, delta, None, []

    def fit(self, df: DataFrame, keys: list[str], value: str) -> TDigest:
        from skerry.streaming.windows import merged_digests

        new = sketch.digest(df, keys, value, self.buffer, self.delta)
        self.state = new if self.state is None else merged_digests(self.state.unionByName(new), keys)
        self.keys = keys
        return self

    def predict(self, *quantiles: float) -> DataFrame:
        return self.state.select(*self.keys, *[sketch.quantile(q).alias(f"q{q:g}") for q in quantiles])

    def save(self, path: str) -> None:
        if self.state is None:
            raise ValueError("nothing is fitted yet")
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        save_settings(self.state.sparkSession, path, {"buffer": self.buffer, "delta": self.delta, "keys": self.keys})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TDigest:
        d = load_settings(spark, path)
        out = cls(d["buffer"], d["delta"])
        out.state, out.keys = spark.read.parquet(f"{path}/state"), d["keys"]
        return out

    def divergence(self, other: TDigest) -> DataFrame:
        return sketch.divergence(self.state, other.state, self.keys)


class PrefixTemplates:
    """Token templates by counts: fit on texts, transform others."""

    def __init__(self, mark: str, threshold: float = 0.1, wild: str = "*"):
        self.mark, self.threshold, self.wild, self.table = mark, threshold, wild, None

    def fit(self, df: DataFrame, text: str) -> PrefixTemplates:
        self.table = templates.prefix_templates(df, text, self.mark, self.threshold, self.wild)
        return self

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        return templates.apply_templates(df, text, self.table, self.mark, self.wild)

    def describe(self) -> DataFrame:
        """The fitted tree as lines: each part of the templates, indented by its depth, and how many texts lie below, in the order of the tree."""
        parts = F.split("template", "\\Q" + self.mark + "\\E", -1)
        each = self.table.select(F.col("n"), parts.alias("p")).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.slice("p", 1, k))).alias("path"))
        rows = each.groupBy("path").agg(F.sum("n").alias("n"))
        return rows.select("path", F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.element_at("path", -1)).alias("line"), "n").orderBy("path")

    def save(self, path: str) -> None:
        if self.table is None:
            raise ValueError("nothing is fitted yet")
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        save_settings(self.table.sparkSession, path, {"mark": self.mark, "threshold": self.threshold, "wild": self.wild})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrefixTemplates:
        d = load_settings(spark, path)
        out = cls(d["mark"], d["threshold"], d["wild"])
        out.table = spark.read.parquet(f"{path}/table")
        return out
