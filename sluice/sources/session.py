"""Preparing a session's executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let executors import this package: they fetch a zip of it from the driver, once a session."""
    import sluice

    context = spark.sparkContext
    if getattr(context, "_sluice_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(sluice.__file__))
    path = os.path.join(tempfile.mkdtemp(), "sluice.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sluice", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._sluice_shipped = True


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of this machine serves, but only in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file:///tmp/checkpoints/sluice"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the work folder, deleted when the session ends."""
    path = f"{work_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
