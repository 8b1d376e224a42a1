"""Scans and sinks: Parquet tables, series, labelled images, paired columns, sequences, YAML settings, metric logs."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(df: DataFrame, entity: str | None = None, timestamp: str | None = None, order: list[str] | None = None) -> DataFrame:
    """entity, ts and the attributes. entity: a column, or a literal name, or None (a random name); without timestamp rows are numbered from 0 within their entity by `order`."""
    name = F.col(entity).cast("string") if entity in df.columns else F.lit(entity or str(uuid.uuid4()))
    attrs = [c for c in df.columns if c not in (entity, timestamp)]
    out = df.select(name.alias("entity"), *( [F.col(timestamp).alias("ts")] if timestamp else []), *attrs)
    if timestamp:
        return out
    w = Window.partitionBy("entity").orderBy(*(order or attrs))
    return out.withColumn("ts", F.row_number().over(w) - 1).select("entity", "ts", *attrs)


def one_entity(df: DataFrame) -> DataFrame:
    """df if it has one entity; ValueError otherwise."""
    if df.select("entity").distinct().limit(2).count() != 1:
        raise ValueError("a single series has exactly one entity")
    return df


def images(spark: SparkSession, root: str, annotation: str) -> DataFrame:
    """path, label and content from a CSV of relative paths and labels; contents are read by Spark's binaryFile source."""
    notes = spark.read.csv(annotation, schema="file string, label string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/")
    return notes.join(files.withColumn("file", F.regexp_replace("path", f"^.*{prefix.rsplit('/', 1)[-1]}/", "")), "file").select("path", "label", "content")


def zipped(*frames: DataFrame, on: str = "id") -> DataFrame:
    """Columns of several frames side by side; a row that one of them lacks raises when it is read."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.withColumn("_there", F.lit(True)), on, "full")
        out = out.withColumn(on, F.when(F.col("_there").isNull(), F.raise_error(F.lit("frames differ in size"))).otherwise(F.col(on))).drop("_there")
    return out


def sequences(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One ragged array of values a key."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias("x"))


def yaml_config(path: str) -> dict:
    """Settings from a YAML file, by the safe loader; ValueError if there is none."""
    import yaml

    if not Path(path).is_file():
        raise ValueError(f"no such file: {path}")
    return yaml.safe_load(Path(path).read_text())


def flatten_metrics(df: DataFrame) -> DataFrame:
    """step and metrics (tag -> key -> value) to step, name `tag/key`, value."""
    tags = df.select("step", F.explode("metrics").alias("tag", "inner"))
    return tags.select("step", "tag", F.explode("inner").alias("key", "value")).select("step", F.concat_ws("/", "tag", "key").alias("name"), "value")


def log_metrics(df: DataFrame, path: str, run: str, every: int = 1) -> None:
    """Appends flattened metrics of every n-th step to a Parquet log, partitioned by run."""
    flatten_metrics(df.filter(F.col("step") % every == 0)).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
