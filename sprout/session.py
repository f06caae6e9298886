"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "sprout", extra: dict | None = None) -> SparkSession:
    """Session for this engine: AQE on, UTC, Arrow, FAIR scheduling for concurrent fits, no UI.

    On a cluster pass ``master=None``: partition counts and memory are then those of
    spark-submit; they are set here only for a local master or when given.
    """
    builder = SparkSession.builder.appName(app)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            conf |= {"spark.sql.shuffle.partitions": str(shuffle_partitions or 8), "spark.driver.memory": "8g"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (conf | (extra or {})).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring the context from the session.

    The cluster names the folder in ``spark.checkpoint.dir``; we only make our own
    when nothing is configured and the master is local (tests, laptops). On a
    cluster without the setting we refuse rather than write to a machine-local
    folder that a lost executor would take with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="sprout-ckpt-", dir=os.environ.get("SPROUT_SCRATCH", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before running iterative operators")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint to the shared folder: survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads it from."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder of any store; none if there is no such folder."""
    fs, p = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file that must not be there yet."""
    fs, p = _file_system(spark, path)
    fs.create(p, False).close()


_STORED: list[str] = []


def store(df, name: str = "table"):
    """Write a derived table as Parquet to the shared folder and return it reread.

    Later reads prune columns and push filters, and it survives lost executors.
    ``discard_stored`` deletes the tables when their readers are done.
    """
    table, path = store_at(df, name)
    _STORED.append(path)
    return table


def store_at(df, name: str = "table"):
    """The stored table and its path, for a caller who discards it by itself."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def discard_stored(spark: SparkSession) -> None:
    """Delete every table that ``store`` has written in this process."""
    while _STORED:
        discard_path(spark, _STORED.pop())
