"""Cutting lineage through reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a scratch one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tocsin-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Materialise a stage that several branches read, so that it is computed
    once, its lineage is cut and a lost executor does not recompute it.

    It is written as Parquet to the shared folder: an eager ``checkpoint()``
    runs its last stage twice, once to count and once to write, and its rows are
    read whole again by every branch, whatever columns that needs."""
    folder = checkpoint_dir(df.sparkSession)
    if "void" in df.schema.simpleString():  # a type that Parquet does not hold
        return df.checkpoint(eager=True)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
