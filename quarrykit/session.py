"""Session, table access and the few execution helpers that every operator shares."""

from __future__ import annotations

import atexit
import io
import math
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quarrykit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; ``conf`` keys use __ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once for each application.

    It is zipped into the driver's folder of Spark files, which Spark serves to its executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # the package runs from an archive that was shipped already
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.writestr(zipfile.ZipInfo(os.path.join(os.path.basename(here), os.path.relpath(full, here))), open(full, "rb").read())
    home = os.path.join(SparkFiles.getRootDirectory(), "shipped")
    os.makedirs(home, exist_ok=True)
    path = os.path.join(home, f"{os.path.basename(here)}.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 0) -> int:
    """How many partitions a CPU-bound step should have: the shuffle setting, at least four for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, least)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows spread evenly by a hash of the keys for a step that costs far more CPU than its shuffle.

    Without keys each row is spread by its place in the scan, which is the same when a task is run
    again: copies of one row, however many, do not meet in one task.  The step's narrow results are made
    distinct after it, so no text is sorted.
    """
    ship(df.sparkSession)
    return df.repartition(partitions(df.sparkSession), *(keys or [F.xxhash64(F.monotonically_increasing_id())]))


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints that the cluster names in spark.checkpoint.dir.

    A private one is set only where that is unset and all executors are threads of this process, as in tests.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            d = tempfile.mkdtemp(prefix="quarrykit-checkpoints-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by compressed Parquet beside the checkpoints, for what is large or read often.

    Shuffle files are removed when the driver collects its garbage, so that is asked for once they are not needed.
    """
    path = f"{_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(rows / per_bucket))
