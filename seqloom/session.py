"""Session settings, the shared work folder, and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: functions that run there import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("seqloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", work: str | None = None) -> SparkSession:
    """A local session with the settings the operators expect (tests, bench); ``work`` is the folder for tables between rounds."""
    builder = SparkSession.builder
    if work:
        builder = builder.config("spark.checkpoint.dir", work)
    return (
        builder.master(f"local[{cores}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only in a local session without that setting. Anything else raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted when this program ends."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Returns the table read back and its path, for :func:`drop`.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`, once nothing will read it again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_WRITTEN):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
