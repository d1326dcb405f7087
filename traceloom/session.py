"""Session helpers: a local session for tests, the shared folder of a cluster, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files are deleted when their query ends, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "traceloom") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir, and has to; only
    where all runs on one machine (tests) and it is unset, a temporary one is made and remembered."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="traceloom-"))
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path in whatever storage its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. All of an application's lie in one folder, which goes when
    the application ends, or with ``clear_scratch``."""
    home = f"{shared_dir(spark).rstrip('/')}/traceloom-{spark.sparkContext.applicationId}"
    fs, p = file_system(spark, home)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote so far; frames that still read it must be done with."""
    fs, p = file_system(spark, f"{shared_dir(spark).rstrip('/')}/traceloom-{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame written once to the shared folder: read as often as needed, and not made again when an
    executor is lost. The shuffles that made it go when it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application. Python workers import it by
    name, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_traceloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="traceloom-pkg-")) / "traceloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # the driver serves it from its own disk; nothing but the driver reads that folder
    sc.addPyFile(str(target))
    sc._traceloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
