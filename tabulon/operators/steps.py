"""Steps of iterations: kept tables, so plans stay short."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir; only a local master may do without (a temporary folder is set then)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("a cluster must name a folder that all executors see in spark.checkpoint.dir")
            folder = "file://" + tempfile.mkdtemp(prefix="tabulon-steps-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
