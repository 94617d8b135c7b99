"""Size of the Arrow batches that Python workers are handed."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch: its kernel's arrays and lists take up to some fifty times as much.
BATCH_BYTES = 2 << 20
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of at most BATCH_BYTES (or one larger row), unless the session already asks for smaller ones."""
    asked = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(KEY))
    if asked > BATCH_BYTES:
        spark.conf.set(KEY, str(BATCH_BYTES))
