"""A session with the settings that the library is written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "touchline", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, ANSI errors, partition columns kept as strings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.ansi.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir that driver and executors share; where that is unset, an own one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="touchline-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over spark.sql.shuffle.partitions tasks, before work that makes many rows of each or takes long: a file's few row groups would be as few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
