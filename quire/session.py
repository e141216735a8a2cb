"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every quire job relies on. AQE re-plans joins from real shuffle
# sizes (a size-checked broadcast), coalesces small partitions and splits
# skewed join partitions; the UI is off because no port may be opened.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # AQE coalesces small shuffle partitions up to this size and splits larger ones
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "quire",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a SparkSession with quire's base settings.

    ``shuffle_partitions`` should be sized so that one shuffle partition
    holds roughly 128-256 MB at the target scale; AQE coalesces downwards.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def partitions_for(size_bytes: int | None, minimum: int = 1, target: int = TARGET_PARTITION_BYTES) -> int:
    """Number of partitions so that each holds about ``target`` bytes (``minimum`` if unknown)."""
    if size_bytes is None:
        return minimum
    return int(max(minimum, -(-int(size_bytes) // target)))


def scale_conf(input_bytes: int, cores: int) -> dict:
    """Settings for a job reading ``input_bytes`` on ``cores`` cores: enough shuffle
    partitions for ~256 MB each (at least 2 per core; AQE coalesces down), and
    128 MB scan splits."""
    return {
        "spark.sql.shuffle.partitions": str(partitions_for(input_bytes, minimum=2 * cores)),
        "spark.sql.files.maxPartitionBytes": "128m",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables and checkpoints.

    Reads ``spark.checkpoint.dir`` from the session (on a cluster it names a
    shared file system). Only when it is unset *and* the master is local
    (tests, laptops) is a scratch folder created and registered; a cluster
    session without the setting is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before materialising tables")
    path = tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path
