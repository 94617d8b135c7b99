"""Arrow batches are bounded by bytes, whatever their rows, where an operator hands wide rows to Python workers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill import batches
from glyphmill.operators import outlines
from glyphmill.plans import catalogue

UNSET = "2147483646b"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(batches.KEY)
    spark.conf.set(batches.KEY, UNSET)
    yield spark
    spark.conf.set(batches.KEY, before)


def most_bytes(rows):
    """Bytes of the largest batch that a Python worker is handed."""

    def run(given):
        for batch in given:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.max("n")).first()[0]


def test_asked_for_less_stays(unbounded):
    unbounded.conf.set(batches.KEY, "1m")
    batches.bounded_batches(unbounded)
    assert unbounded.conf.get(batches.KEY) == "1m"


def test_long_lines_come_in_small_batches(unbounded, sf_dir):
    catalogue.char_boxes(unbounded, sf_dir)
    lines = unbounded.range(64).select(F.repeat(F.lit("x"), 1 << 17).alias("text")).coalesce(1)
    assert most_bytes(lines) < 1.1 * batches.BATCH_BYTES


def test_lists_of_polygons_come_in_small_batches(unbounded, sf_dir):
    polygons = unbounded.range(6000).select(F.col("id").alias("image_id"), F.col("id").alias("polygon_id"), *(F.array(*(F.lit(float(v)) for v in (0, 4, 4, 0, k))).alias(c) for k, c in enumerate(("xs", "ys"))))
    maps = unbounded.range(1).selectExpr("id AS image_id", "8 AS h", "8 AS w", "array_repeat(0.5d, 64) AS probs")
    scores = outlines.polygon_scores(maps, polygons)
    lists = polygons.groupBy((F.col("image_id") % 20).alias("image_id")).agg(F.collect_list(F.struct("polygon_id", "xs", "ys")).alias("polygons"))
    wide = lists.crossJoin(unbounded.range(12)).coalesce(1)
    assert most_bytes(wide) < 1.1 * batches.BATCH_BYTES
    assert scores.count() == 6000 and scores.where("score > 0").count() == 1


def test_pictures_come_in_small_batches(unbounded, sf_dir):
    assert most_bytes(catalogue.pictures(unbounded, sf_dir)) < 1.1 * batches.BATCH_BYTES
