"""Lineage cuts in storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's spark.checkpoint.dir; only where that is unset and Spark runs in one process, a temporary folder serves."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = path or f"file://{tempfile.mkdtemp(prefix='skerry-')}"
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)
