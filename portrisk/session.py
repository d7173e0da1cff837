"""Spark session settings and the shared scratch location.

Timestamps are UTC end to end (the reference stamps every row in UTC), ANSI
mode stays on (bad text is handled with ``try_*`` functions, never by turning
ANSI off), and AQE is on so joins and shuffles are re-planned from runtime
sizes.  On a cluster, ``spark.checkpoint.dir`` names a shared folder; all
intermediate tables and stream checkpoints go below it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the size check behind every join not hinted by construction: a side is
    # broadcast only when its measured (runtime) size is below 10 MB
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # target reducer size; AQE coalesces small partitions and splits skewed ones
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # folders of a landing are listed in this many tasks at most (10,000 by default, a task a folder):
    # each task's result goes to the driver
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "portrisk", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench; cluster jobs pass their own master/conf."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PORTRISK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def apply_session_conf(spark: SparkSession) -> None:
    """Runtime settings this library relies on (safe on a running session).

    Python workers look for this package where the driver found it, wherever the driver was
    started; on a cluster the package is installed or sent with ``--py-files`` as usual.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled",
                "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                "spark.sql.adaptive.autoBroadcastJoinThreshold",
                "spark.sql.sources.parallelPartitionDiscovery.parallelism"):
        spark.conf.set(key, BASE_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.  Only a
    local session (tests, bench) gets a fresh temporary folder; a cluster without the
    setting is an error, as every executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="portrisk-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint dir for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/portrisk-scratch/{name}-{uuid.uuid4().hex[:12]}"

