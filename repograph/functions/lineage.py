"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder (spark.checkpoint.dir). Only in local mode, as in tests, may that be unset."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.gettempdir() + "/checkpoints")
    return df.checkpoint()
