"""Spark session settings used by tests and the benchmark.

On a cluster the session comes from the platform; operators never build one.
``ensure_checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session and only
sets a directory of its own when none is configured (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size-checked broadcast: Catalyst and AQE only broadcast a side whose
    # measured / estimated size is under this, otherwise they sort-merge.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture for every column expression: it takes longer than building the plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "wirework",
                  extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, local_default: str | None = None) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``).

    Only a local-mode session (tests, the benchmark) without one gets a folder
    of its own; on a cluster a machine-local folder would not survive the loss
    of the machine, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) "
                           "for checkpoints, stream state and intermediate tables")
    path = local_default or tempfile.mkdtemp(prefix="wirework-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path
