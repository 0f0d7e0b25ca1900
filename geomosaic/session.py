"""Session helpers: where shared files go, how lineage is cut, how Python code reaches the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="geomosaic-")
    path = os.path.join(folder, "geomosaic_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join("geomosaic", os.path.relpath(full, root)))
    sc.addPyFile(path)  # the driver's file server hands it out
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, it is a local folder where driver and executors are one
    process (tests), and an error on a cluster, whose machines would each write to a folder of their own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not d:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = held.get() if held.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = "file://" + tempfile.mkdtemp(prefix="geomosaic-shared-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/geomosaic/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation. The files
    go when the application ends, or by ``discard``."""
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    _filesystem(spark, path)[0].deleteOnExit(_filesystem(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``written`` wrote for these; nothing may read them later."""
    for df in frames:
        dropped(spark, df.written_to)


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)
