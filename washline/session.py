"""SparkSession construction and cluster-facing settings.

Library code never builds its own session; it takes the caller's. ``get_session``
exists for tests, the bench and the command-line tools.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes (that is
# our size check before a broadcast of a data-dependent side), coalesces small
# shuffle partitions and splits skewed ones.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # delete a reliable checkpoint's files once no DataFrame refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call-site capture for error messages costs several JVM round trips per
    # DataFrame API call while a plan is being built; off for batch jobs.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster reading ~100 TB (merged over _BASE_CONF by
# ``get_session(cluster=True)`` or copied into spark-defaults). Sizes are starting
# points, not measurements: aim at ~256 MB per scan split and per reduce partition.
CLUSTER_CONF = {
    # ~400k scan tasks per 100 TB instead of ~800k at the 128 MB default
    "spark.sql.files.maxPartitionBytes": "256m",
    # upper bound of reduce partitions; AQE coalesces down to ~advisory size
    "spark.sql.shuffle.partitions": "40000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    # split a reduce partition 5x the median and over 1 GB (a hot order or user)
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    # runtime size check before broadcasting a data-dependent dimension
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # large per-order state of the streaming fold lives in RocksDB, not the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "washline", cluster: bool = False) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    conf = {**_BASE_CONF, **(CLUSTER_CONF if cluster else {})}
    if not cluster:
        builder = builder.master(master or f"local[{cpus}]")
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
        conf["spark.driver.memory"] = os.environ.get("WASHLINE_DRIVER_MEM", "16g")
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _configured(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder; only a local master without one (tests) gets its own.

    On a cluster a machine-local folder would be another one on each executor: that is an error."""
    d = _configured(spark)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; the cluster must name a shared folder")
        d = tempfile.mkdtemp(prefix="washline-ckpt-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
