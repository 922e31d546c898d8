"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own on a single machine, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_roots: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The application's scratch folder, which goes when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/ledgerline/{spark.sparkContext.applicationId}"
    if root not in _roots:
        fs, at = hadoop(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _roots.add(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below it."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
