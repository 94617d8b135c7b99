"""The per-image plan over a stream of image files: stateless, so it runs as it stands, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from glyphmill.plans.pipeline import Recognition, ocr
from glyphmill.sources.images import image_stream


def recognise_files(spark: SparkSession, source: str, target: str, checkpoint: str, recognition: Recognition = Recognition()) -> StreamingQuery:
    """Reads what is there and ends (available now); a restart with the same checkpoint takes only new files."""
    lines = ocr(image_stream(spark, source), recognition)
    return lines.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
