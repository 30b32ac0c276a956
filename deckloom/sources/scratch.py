"""A folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, its lineage cut, its size known to the planner."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` as a written table in as many buckets of ``key`` as shuffles have partitions, so that joins and groups by it
    move none of its rows again."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
