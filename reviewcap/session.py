"""SparkSession settings for this workload, and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins from measured sizes
# (runtime broadcast only under the threshold, sort-merge beyond it), merges
# small shuffle partitions, and splits skewed join partitions even when that
# costs one more (post-partial-aggregation) shuffle.  Timestamps are naive,
# compared in UTC.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Without a call site for each Column, plans are built in half the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "reviewcap", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench (a cluster passes its own conf)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("REVIEWCAP_DRIVER_MEMORY", "8g")
    # Local catalog tables (sources.layout) go to a scratch warehouse, not the working directory.
    conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="reviewcap-warehouse-")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_CHECKPOINT_ROOT: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    Read from the session; only when it is unset on a local master (tests)
    is a scratch folder made (once per application).  It is registered with
    ``setCheckpointDir`` so ``DataFrame.checkpoint()`` writes there; the
    setting itself is a startup config and is never changed at run time.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: point it at a folder every executor shares")
        d = _LOCAL_CHECKPOINT_ROOT.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="reviewcap-ckpt-"))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def cluster_conf(total_cores: int, largest_shuffle_tb: float = 100.0) -> dict[str, str]:
    """Settings to pass at submit time on a cluster (the library sets none itself).

    Shuffle partitions are sized so the largest shuffle's partitions are about
    256 MB before AQE coalesces small ones (and never fewer than 3 waves of
    tasks); skew splitting starts at 4x the median and 512 MB.
    """
    target = int(largest_shuffle_tb * 1024 * 1024 / 256)  # 256 MB partitions
    parts = max(3 * total_cores, target)
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64MB",
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",  # broadcast only after measuring (AQE)
    }
