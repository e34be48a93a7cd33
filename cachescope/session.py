"""Session helpers: building a local session for tests/bench and resolving the
checkpoint directory for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cachescope", cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """A local session configured like the cluster one (UTC, AQE, Arrow, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only what was measured: no broadcast from static size
        # estimates; AQE may still broadcast a side whose shuffle output it has
        # measured below 64 MB. Explicit hints are used only on results bounded
        # by a parameter.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        # Replay rounds checkpoint every step; drop the files once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def parallelism(spark: SparkSession) -> int:
    """Cores available to the session (shuffle partitions where the context is
    not reachable, e.g. a Spark Connect client)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the reliable checkpoint directory, setting it from the session.

    On a cluster the shared folder comes from ``spark.checkpoint.dir``. Only a
    local-mode session without that setting (tests, bench) gets a fresh scratch
    folder; a cluster session without it is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's own setting applies
        return None
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cachescope-ckpt-"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running iterative jobs")
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back, so
    that plans stay small and the rows survive the executors that computed them."""
    return written_to(df, new_folder(df.sparkSession, name))
