"""Session helpers: building a local session, reading tables, shared folders, shipping code to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "strandmill") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names in spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandmill-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that its lineage is cut and a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows; otherwise as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan (no shuffle before) for costly work per row: dealt out anew if it has fewer tasks than there are cores.

    A small file or one row group is one task, however long its rows take; large inputs have tasks enough and stay.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run and whatever their path (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_strandmill_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strandmill-code-"), "strandmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._strandmill_shipped = True
