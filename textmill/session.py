"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 << 20
SHARED_DIR_CONF = "spark.checkpoint.dir"
DEAL_CONF = "spark.textmill.dealPartitions"
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app_name: str = "textmill", master: str | None = None, shuffled_bytes: int | None = None,
                  **conf) -> SparkSession:
    """Session with the settings the operators are tuned for; every one can be overridden by `conf`.

    `shuffled_bytes` is the most that one shuffle is expected to move. Shuffles start with one partition per 128 MB of
    it, AQE coalesces what turns out smaller, and skewed join partitions are split.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Joins of text with narrow keys then hash the keys instead of sorting the text.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SPLIT_BYTES),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    if shuffled_bytes:
        settings.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                            str(max(200, shuffled_bytes // SPLIT_BYTES)))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. A local temporary folder is used only by a local master."""
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever reused or removed."""
    return f"{shared_dir(spark)}/textmill/{uuid.uuid4().hex}/{name}"


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out to as many partitions as the setting `spark.textmill.dealPartitions` says; unset, as they were scanned.

    For tables that are one file with one row group, which a scan can't split. It is a choice of the session, not of
    the code: at scale it stays unset, and no row is shuffled for it.
    """
    partitions = df.sparkSession.conf.get(DEAL_CONF, None)
    return df.repartition(int(partitions)) if partitions else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that lost executors do not trigger long recomputation."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_dir(spark)}/textmill/checkpoints")
    return df.checkpoint(eager=True)
