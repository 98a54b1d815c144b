"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def get_session(app: str = "rivulet", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only in local mode (tests, a laptop), where one machine does everything, may that setting be absent: a temporary
    folder is then made, once a process.  On a cluster its absence is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="rivulet-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/rivulet/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file on whatever file system holds the path; it appears whole or not at all."""
    jvm, part = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = part.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"cannot write {path}")


def release(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables, once nothing reads them any more."""
    for one in tables:
        if one is not None and getattr(one, "scratch_path", None):
            drop_path(one.sparkSession, one.scratch_path)
            one.scratch_path = None


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver forget plans that are done, upon which Spark deletes their shuffle files; else these stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system holds it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application: their Python may not have its folder on the path."""
    app = spark.sparkContext.applicationId
    if _LOCAL.get("shipped") == app:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="rivulet-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "rivulet.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _LOCAL["shipped"] = app
