"""Cutting the lineage of iterative plans so that lost executors cost nothing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where none is named (local tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark, "_flamewright_checkpoint_dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "flamewright-" + uuid.uuid4().hex)
            spark._flamewright_checkpoint_dir = named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
