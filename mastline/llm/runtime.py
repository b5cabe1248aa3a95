"""What all operators of this package need from a session."""

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mastline.workspace import new_folder

_ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write below the shared folder and read again: cuts lineage, survives lost executors.

    ``folders`` are columns whose values get folders of their own.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.partitionBy(*folders).parquet(folder)
    kept = spark.read.schema(df.schema).parquet(folder)
    return kept.select(*df.columns) if folders else kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
