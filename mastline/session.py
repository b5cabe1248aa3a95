"""Session settings the pipelines count on."""

from pyspark.sql import SparkSession

SETTINGS = {
    # timestamps carry no zone; a fixed one keeps casts the same everywhere
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a refresh of a few hundred keys names them in the scan; see plans/refresh.py
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    # the streams keep every id: state belongs on local disk and in the checkpoint, not the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a builder; the master and the sizes are the caller's."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
