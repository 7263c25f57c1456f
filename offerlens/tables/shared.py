"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as the session or its context has it. Where it is unset: a temporary one with a local master, an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it names the folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="offerlens-"))
    return _local[0]


def folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one."""
    return f"{root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once into the shared folder and read again."""
    at = folder(df.sparkSession, "stored")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: it meets the other side by a shuffle, and is not sent through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns over as many tasks as shuffles have, for steps that are dear for a row: a small file of many rows is read by few tasks."""
    return df.repartition(partitions(df.sparkSession), *columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
