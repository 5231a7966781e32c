"""SparkSession helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session with the settings the plans are written for.

    On a cluster the caller's session already exists and ``getOrCreate`` returns it;
    the options below only take effect for a fresh local session (tests, bench).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("shroud")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.shroud.corpus.partitions", str(2 * int(cpus)))  # local tables have one row group
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only for a local master with none set."""
    conf = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
    path = tempfile.mkdtemp(prefix="shroud-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path
