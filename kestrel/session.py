"""SparkSession construction and cluster-level settings."""

from __future__ import annotations

import os
import re
import tempfile
import time

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

# Settings every job relies on. Zone-less maths (delivery days, month
# truncation) assume UTC; AQE handles skew splitting, partition coalescing
# and runtime broadcast conversion from measured sizes.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Static plans broadcast only below 10 MB of estimated (file-size based)
    # input; AQE may convert a join to broadcast when the side it actually
    # measured after a shuffle is below 32 MB.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "kestrel", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults.

    On a cluster, pass no master and let spark-submit decide; size
    ``shuffle_partitions`` so one partition holds ~128-256 MB of shuffle data.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only for a local master.

    On a cluster ``spark.checkpoint.dir`` names a shared filesystem folder and
    is used as-is; without it this raises, since other machines would not see
    a local folder. Only a session on a ``local`` master (a test run) gets a
    fresh folder under the system temp dir. Works without a SparkContext handle
    (Spark Connect) by falling back to the session conf.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master or ""):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    if sc is None:
        return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "kestrel-tables", name)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that its job no longer reads; only below the shared checkpoint folder."""
    base = scratch_path(spark, "")
    if not path.startswith(base) or path.strip("/") == base.strip("/") or ".." in path[len(base):].split("/"):
        raise ValueError(f"{path} is no intermediate table")
    jvm = spark._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that ended.

    They stay on the executors' disks until the driver collects garbage, which a driver with memory to spare
    does late."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    try:  # events that wait for their listeners still hold the plans
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(10_000)
    except Py4JError:
        pass
    for _ in range(2):  # the first collection frees what holds the last plan
        jvm.System.gc()
        time.sleep(0.5)


def scale_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 256,
               shuffle_fraction: float = 0.25) -> dict:
    """Partition sizing for a cluster run over ``input_bytes`` of Parquet.

    Scan splits of ``target_partition_mb`` keep a task's input well inside
    executor memory. The shuffles here carry narrow projections (keys and a
    few measures, partially aggregated), estimated at ``shuffle_fraction`` of
    the input; the initial shuffle partition count targets the same size and
    AQE coalesces small ones at runtime. A skewed partition is split once it
    exceeds 5x the median and 1 GB. Example: 100 TB on 1000 executors x 8
    cores -> 256 MB splits (~400K scan tasks), ~100K shuffle partitions."""
    mb = 1024 * 1024
    split = target_partition_mb * mb
    shuffle_parts = max(total_cores * 3, int(input_bytes * shuffle_fraction) // split + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * mb),
    }


def resilience_conf() -> dict:
    """Settings that let jobs ride out executor loss on a cluster.

    Lost tasks are retried and lost shuffle output is recomputed from lineage
    by default; these additions migrate shuffle and cached blocks off
    executors that are being decommissioned (spot/preemptible nodes), retry
    fetches from a lost executor before failing a stage, and keep stage
    retries bounded. Lineage stays short in these jobs: loads read back what
    they wrote, and long chains can be cut with :func:`cut_lineage`."""
    return {
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.storage.decommission.rddBlocks.enabled": "true",
        "spark.shuffle.io.maxRetries": "10",
        "spark.shuffle.io.retryWait": "10s",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
    }
