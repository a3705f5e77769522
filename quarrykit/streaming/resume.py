"""Runs that can be taken up again: what is left to do, what counts as done, and a sink that appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_records(spark: SparkSession, path: str, schema: str, key: str, order: str, unfinished: str = "provider_error") -> DataFrame:
    """Records of a JSON-lines log: torn or malformed lines and unfinished ones do not count, the last of a key wins."""
    r = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull() & (F.col("status") != unfinished))
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return r.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def remaining(specs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return specs.join(done.select(key).distinct(), key, "left_anti")


def append_both(private: str, public: str, public_columns: list[str]):
    """A foreachBatch writer: full rows go to the private log first, then the public columns to the checkpoint log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("batch_id", F.lit(batch_id))
        b.write.mode("append").json(private)
        b.select(*public_columns, "batch_id").write.mode("append").json(public)

    return write
