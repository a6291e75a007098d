"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named a temporary one is made and set if the master is local;
    on a cluster executors could not read it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="portloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; what follows survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
