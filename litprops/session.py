"""Session helpers.

On a cluster the session comes from ``spark-submit``; nothing here overrides what the cluster names. ``local_session`` is what the
tests and ``bench.py`` use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "litprops", memory: str = "16g") -> SparkSession:
    """A ``local[n]`` session with as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")  # small tables still use every core
        .config("spark.sql.files.maxPartitionBytes", "4MB")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, a laptop) is a fresh temporary folder made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jvm_dir.get() if jvm_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for this cluster")
        named = tempfile.mkdtemp(prefix="litprops-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table that several later steps read into the shared folder, and read it back.

    It is worked out once, survives the loss of any executor, and stays columnar so that later reads are pruned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/litprops-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
