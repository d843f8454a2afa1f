"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# runtime SQL settings every job here relies on: joins on hot keys are split by AQE, also
# where the split costs one more shuffle after the join
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Tasks after a shuffle hold their part in sorts and hash maps of some thirty times its compressed size, so
# the parts that AQE merges stay small; there must be enough of them to merge
PART_SIZE, LEAST_PARTS = "16m", 200


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Shuffled parts of bounded size, so that the memory of a task does not follow the size of a table."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_SIZE)
    if int(spark.conf.get("spark.sql.shuffle.partitions", "200")) < LEAST_PARTS:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(LEAST_PARTS))
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session made elsewhere, and let Python workers find this package
    where the driver found it (on a cluster it is installed or shipped with --py-files)."""
    for k, v in SQL_SETTINGS.items():
        spark.conf.set(k, v)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def build_session(app: str = "lumirank", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings are left to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (builder.master(master)
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediates, named by spark.checkpoint.dir.

    Only a local-mode session may fall back to a temporary folder: on a cluster a
    machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(path)
    return path


def stable(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Used where two branches of a plan must see the very same rows (a range
    partitioning is sampled, so running it twice may cut at other keys), and to
    cut lineage. The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"stable-{uuid.uuid4().hex}")
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)
