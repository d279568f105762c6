"""Session settings the library relies on.

Partition counts and memory are the cluster's business and are left alone. Only settings that
change results (time zone) or that guard against skew are set here.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the grouping after it then needs a shuffle of its own: that
    # shuffle carries partial aggregates only.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession, *, large_state: bool = False) -> SparkSession:
    """Apply the settings above; with ``large_state`` keep stream state in RocksDB."""
    for key, value in {**RESULT_CONF, **SCALE_CONF}.items():
        spark.conf.set(key, value)
    if large_state:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stream state: the one the cluster names.

    Only a local session without one gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="motorpool-"))
    return context.getCheckpointDir().rstrip("/")
