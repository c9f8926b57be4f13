"""Session settings, lineage cuts and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir`` of the session.

    Only a local session may lack it (tests); a folder of this machine is set then. On a cluster
    a missing setting is an error, since a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"file://{tempfile.gettempdir()}/strandloom-checkpoints"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the tables of this application; they may be read until its end."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the application has ended before this hook ran
        pass


def application_folder(spark: SparkSession) -> str:
    """The folder of this application's stored tables in the shared folder; it is removed at its end."""
    folder = f"{shared_dir(spark)}/strandloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """Part files of a folder in their order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Ends the lineage of iterative plans and keeps one computed copy of a table that several
    branches read. The table survives the loss of executors; Parquet compresses what
    ``checkpoint()`` would store plainly.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for Python functions run there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if sc.master.startswith("local["):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="strandloom"), "strandloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder, ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
