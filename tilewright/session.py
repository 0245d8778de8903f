"""Session helpers: tables, the shared folder, and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tilewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in remote Python workers (once per context)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_tilewright_shipped", False):
        return
    folder = tempfile.mkdtemp()  # on the driver only; Spark copies the archive to every executor
    archive = os.path.join(folder, "tilewright.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    sc._tilewright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, named by spark.checkpoint.dir; a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_tilewright_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.sparkContext._tilewright_dir = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def _own(spark: SparkSession):
    """File system and folder of this application's intermediate tables below the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tilewright-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table; what lies there is deleted when the driver's JVM ends, or by :func:`clear_scratch`."""
    files, folder = _own(spark)
    if not getattr(spark.sparkContext, "_tilewright_scratch", False):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        spark.sparkContext._tilewright_scratch = True
    return f"{folder.toString()}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; call it when no query of it is running."""
    for t in spark.catalog.listTables():
        if t.name.startswith("tilewright_"):
            spark.sql(f"DROP TABLE `{t.name}`")
    files, folder = _own(spark)
    files.delete(folder, True)
