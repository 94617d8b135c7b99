"""Schemas of the recognition dataflow; images have Spark's own image schema."""

from __future__ import annotations

from pyspark.sql import types as T

CORNERS = [f"{axis}{n}" for n in (1, 2, 3, 4) for axis in "xy"]

#: Image rows, as Spark's image source has them, with a key.
IMAGE = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType()),
])
RESULT = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("box_id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()),
    *(T.StructField(c, T.DoubleType()) for c in CORNERS),
])
ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])


class OcrError(ValueError):
    """What is wrong with an image, a shape or a model: a code and words."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def error_of(why: Exception) -> dict[str, str]:
    """An exception as a row of ERROR."""
    return {"code": getattr(why, "code", "Preprocess"), "message": str(why)}
