"""Shared helpers: storage that every executor can reach, Arrow batches, text basics."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch to Python; with texts of some thousand characters a batch stays at a few MB.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only where that is unset and Spark runs in one process (tests), an own one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = path or f"file://{tempfile.mkdtemp(prefix='skerry-')}"
        spark.sparkContext.setCheckpointDir(path)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return path or held.get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there; Spark's cleaner removes the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that one operator writes and drops again before it returns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Texts and blocks can be long: lowers Spark's default numbers of rows and bytes in an Arrow batch; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, f"{64 << 20}b"))  # other units are a setting of the session's own
    if now and int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | list[dict] | None], schema: str) -> DataFrame:
    """mapInArrow by a function from a batch to columns (a dict of arrays or lists in the schema's order)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = fn(batch)
            if cols:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, type=f.type) for f, x in zip(arrow, cols.values(), strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads the bits of each 64-bit value, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept while there are few enough of them."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value
