"""Index tables on disk: one Parquet folder for each table, partitioned by repository and commit.

The folder's name holds a hash of the configuration, so an index is never read with another
stemming than it was built with.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.config import IndexConfig

VERSION = 3


def config_key(config: IndexConfig) -> str:
    """10 hex digits of the SHA-1 of the configuration as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:10]


def write(df: DataFrame, root: str, name: str, config: IndexConfig) -> None:
    d = df.withColumn("schema_version", F.lit(VERSION))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("repo", "sha").parquet(f"{root}/{config_key(config)}/{name}")


def read(spark: SparkSession, root: str, name: str, config: IndexConfig) -> DataFrame:
    """The table as written with this configuration; rows of another schema version are a miss."""
    d = spark.read.parquet(f"{root}/{config_key(config)}/{name}")
    return d.where(F.col("schema_version") == VERSION).drop("schema_version")


def write_table(df: DataFrame, root: str, name: str, config: IndexConfig) -> None:
    """A table of an index of many repositories, in ranges of them and sorted, so that row groups can be passed over."""
    d = df.withColumn("schema_version", F.lit(VERSION))
    if "repo" in df.columns:
        d = d.repartitionByRange("repo").sortWithinPartitions("repo")
    d.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{config_key(config)}/{name}")


def read_table(spark: SparkSession, root: str, name: str, config: IndexConfig) -> DataFrame:
    return read(spark, root, name, config)


def locked(spark: SparkSession, folder: str, lock: DataFrame) -> DataFrame:
    """Files of a folder whose SHA-256 differs from the lock table (name, sha256), or that only one side has."""
    have = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    j = have.join(lock.select("name", "sha256"), "name", "full_outer")
    return j.where(~F.col("found").eqNullSafe(F.col("sha256")))


def dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON dataset of one array, read with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
