"""Cutting the lineage of iterative jobs in the shared checkpoint folder; dealing rows out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; make one only where there is but one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lost executors don't lose it and it is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows out over the session's shuffle partitions, for work that costs much a row: a small file is one task else."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
