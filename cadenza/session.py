"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next step then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Merge sessions in every task first, so a busy key sends few rows.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Set only where the user left them alone. Shuffled rows are compressed: tasks of
# this much hold some ten times as much while they sort and group.
UNLESS_SET = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB"}

# Settings an isolated query session takes over from the session it came from.
INHERITED = (
    "spark.sql.session.timeZone",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.forceOptimizeSkewedJoin",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.ansi.enabled",
)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session that already runs."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in UNLESS_SET.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def isolated(spark: SparkSession) -> SparkSession:
    """A session with its own temp views and functions on the same cluster."""
    child = spark.newSession()
    for key in INHERITED:
        value = spark.conf.get(key, None)
        if value is not None:
            child.conf.set(key, value)
    return child


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only a local master may do without: it gets a temporary folder. Elsewhere
    each executor would write to its own disk, so a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cadenza-checkpoint-"))
    return sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_dir(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have what was written to `path` deleted when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def staged(frame: DataFrame) -> DataFrame:
    """The frame written once as a table in the shared checkpoint folder.

    Later steps read it instead of working it out again, also after executors
    are lost, and the planner knows its size.
    """
    spark = frame.sparkSession
    path = shared_path(spark, "staged")
    frame.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """How many slices an ordered pass is cut into: follows the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
