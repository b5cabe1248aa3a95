"""Where intermediate tables go: the shared folder the cluster names."""

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; a fresh local one only on a local master."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="mastline-")
    spark.conf.set(_SETTING, folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
