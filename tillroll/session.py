"""Session helpers: local test sessions and the shared scratch folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it. Tests and ``bench.py`` build a local session
here and set their own checkpoint folder only when none is configured.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tillroll") -> SparkSession:
    """Local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only if unset.

    A cluster names a shared folder (HDFS/S3/...) in ``spark.checkpoint.dir``;
    that is always used as is. Only an unconfigured (local/test) session gets a
    fresh folder under the temp directory.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder shared by the cluster (HDFS, S3, ...); "
                "published tables and checkpoints must survive lost executors"
            )
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    # Keep the RDD checkpoint directory in step so df.checkpoint() works too.
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder."""
    return "/".join([ensure_checkpoint_dir(spark), *parts])


