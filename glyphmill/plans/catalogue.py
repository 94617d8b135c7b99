"""Every query of the recognition dataflow by name, over tables that stand in for its inputs, and SQL for the same rows.

Stand-ins: `embeddings` as eight by eight probability maps and as logits of 64 classes, `events` as quadrilaterals,
`orders` as image sizes, the lines of `conversations` as recognised lines with a column for each character.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.batches import bounded_batches
from glyphmill.config import Config, DetConfig, GlobalConfig
from glyphmill.functions import quads as Q
from glyphmill.functions import sizing as S
from glyphmill.operators import decode, raster, segment, shapes, wordboxes
from glyphmill.operators import outlines as borders_
from glyphmill.plans.pipeline import Recognition, image_summary, ocr
from glyphmill.schemas import CORNERS
from glyphmill.sources import images, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

THRESH = 0.05
CHARACTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def query(sql: str | None = None):
    def register(make):
        name = make.__name__.removesuffix("_query")
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return register


def logits(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("label").alias("line_id"), F.col("vec_id").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("probs"))


def maps(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("probs"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Quadrilaterals of events, a hundred to an image of 2000 by 1200."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value")
    x0, y0 = ((F.col("event_id") * k) % m for k, m in ((37, 1900), (91, 1100)))
    w, h, skew = F.lit(2.0) + F.col("value"), F.lit(3.0) + F.col("user_id") % 60, F.col("event_id") % 7 - 3
    corner = {"x1": x0, "y1": y0, "x2": x0 + w, "y2": y0 + skew, "x3": x0 + w, "y3": y0 + h + skew, "x4": x0, "y4": y0 + h}
    score = (F.col("event_id") * 7919) % 1000 / 1000.0
    return e.select(F.expr("event_id DIV 100").alias("image_id"), F.col("event_id").alias("rank"), *(v.cast("double").alias(k) for k, v in corner.items()), score.alias("score"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", (20 + F.col("o_orderkey") % 4000).cast("int").alias("w"), (10 + F.col("o_custkey") % 3000).cast("int").alias("h"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files make fewer partitions than that: for small tables from which much is made."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every turn that isn't empty, as if a recogniser had read it: kept steps, columns and a slanted box.

    A character takes two columns, and five more follow each tenth.
    """
    bounded_batches(spark)
    c = spread(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("image_id"), F.posexplode(F.split("text", "\n", -1)).alias("box_id", "text"))
    places = F.sequence(F.lit(0), F.char_length("text") - 1)
    prob = lambda i: ((F.col("image_id") * 31 + i * 17) % 50 + 50) / 100.0
    place = lambda i: i * 2 + F.floor(i / 10).cast("int") * 5
    kept = F.transform(places, lambda i: F.struct(place(i).alias("col"), F.lit(1).alias("token"), prob(i).alias("prob")))
    x, y, skew = F.col("image_id") * 37 % 500, F.col("box_id") * 25, F.col("image_id") % 5
    corner = {"x1": x, "y1": y, "x2": x + 400, "y2": y + skew, "x3": x + 400, "y3": y + 20 + skew, "x4": x, "y4": y + 20}
    return c.where("text <> ''").select("*", kept.alias("kept"), *(v.cast("double").alias(k) for k, v in corner.items())).withColumn("line_cols", place(F.char_length("text") - 1) + 2.0)


#: Neighbouring ranks of one width that are numbered in one task.
WIDTH_PART = 4096


def rounded(columns: dict[str, Column], places: int = 4) -> list[Column]:
    return [F.round(v, places).alias(k) for k, v in columns.items()]


LOGITS_SQL = """
WITH steps AS (
    SELECT label AS line_id, vec_id AS t, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings
), best AS (
    SELECT line_id, t, list_position(p, list_max(p)) - 1 AS token, list_max(p) AS prob FROM steps
), kept AS (
    SELECT * FROM (SELECT *, lag(token) OVER (PARTITION BY line_id ORDER BY t) AS before FROM best) WHERE token <> 0 AND token IS DISTINCT FROM before
)"""


@query(LOGITS_SQL + " SELECT l.line_id, count(k.t) AS n_kept, round(coalesce(avg(round(k.prob, 5)), 0), 6) AS score FROM (SELECT DISTINCT line_id FROM steps) l LEFT JOIN kept k USING (line_id) GROUP BY l.line_id")
def ctc_decode(spark: SparkSession, d: str) -> DataFrame:
    kept = decode.kept(F.col("tokens"), F.col("probs"))
    return decode.collected(logits(spark, d)).select("line_id", F.size(kept).cast("long").alias("n_kept"), F.round(decode.score_of(kept), 6).alias("score"))


@query(LOGITS_SQL + """, dict AS (SELECT i - 1 AS class_id, CASE i WHEN 1 THEN 'blank' WHEN 64 THEN ' ' ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'[i - 1] END AS ch FROM range(1, 65) AS r(i))
SELECT l.line_id, coalesce(string_agg(ch, '' ORDER BY k.t), '') AS text, round(coalesce(avg(round(k.prob, 5)), 0), 6) AS score
FROM (SELECT DISTINCT line_id FROM steps) l LEFT JOIN kept k USING (line_id) LEFT JOIN dict ON class_id = token GROUP BY l.line_id""")
def ctc_text(spark: SparkSession, d: str) -> DataFrame:
    lines = decode.collected(logits(spark, d)).withColumn("kept", decode.kept(F.col("tokens"), F.col("probs")))
    return lines.select("line_id", decode.text_of(F.col("kept"), decode.symbols(CHARACTERS)).alias("text"), F.round(decode.score_of(F.col("kept")), 6).alias("score"))


SPACES_SQL = r"'^[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$'"
KINDS_SQL = {"letters": "CASE WHEN regexp_matches(ch, '^[A-Za-z]$') THEN 'letter' ELSE 'other' END", "scripts": r"CASE WHEN regexp_matches(ch, '[\x{4e00}-\x{9fff}]') THEN 'Cn' ELSE 'EnNum' END"}


def chars_sql(kinds: str) -> str:
    return f"""
WITH turns AS (SELECT conv_id * 1000 + turn AS image_id, string_split(text, chr(10)) AS ls FROM conversations), lines AS MATERIALIZED (
    SELECT image_id, (n - 1)::INT AS box_id, ls[n] AS line FROM turns, unnest(range(1, len(ls) + 1)) AS u(n) WHERE ls[n] <> ''
), chars AS MATERIALIZED (
    SELECT image_id, box_id, (pos - 1)::INT AS pos, line[pos:pos] AS ch, ((pos - 1) * 2 + (pos - 1) // 10 * 5)::INT AS col, ((image_id * 31 + (pos - 1) * 17) % 50 + 50) / 100.0::DOUBLE AS prob
    FROM lines, unnest(range(1, length(line) + 1)) AS u(pos)
), steps AS (
    SELECT *, {KINDS_SQL[kinds]} AS kind, col - lag(col) OVER w AS gap, regexp_matches(ch, {SPACES_SQL}) AS space, coalesce(regexp_matches(lag(ch) OVER w, {SPACES_SQL}), false) AS after_space
    FROM chars WINDOW w AS (PARTITION BY image_id, box_id ORDER BY pos)
), marked AS (
    SELECT *, (after_space OR coalesce(gap, 0) > 5 OR lag(kind) OVER w IS DISTINCT FROM kind)::INT AS b FROM steps WHERE NOT space WINDOW w AS (PARTITION BY image_id, box_id ORDER BY pos)
), solid AS MATERIALIZED (SELECT *, sum(b) OVER (PARTITION BY image_id, box_id ORDER BY pos) - 1 AS word FROM marked)
, words AS MATERIALIZED (
    SELECT image_id, box_id, word, string_agg(ch, '' ORDER BY pos) AS text, any_value(kind) AS kind, count(*) AS n_chars, min(col) AS first_col, max(col) AS last_col FROM solid GROUP BY ALL
)"""


@query(chars_sql("letters") + " SELECT image_id, box_id, word::BIGINT AS word, text, kind, n_chars, first_col, last_col FROM words")
def word_segments(spark: SparkSession, d: str) -> DataFrame:
    words = wordboxes.letter_words(F.col("text"), F.transform("kept", lambda s: s["col"])).alias("w")
    found = text_lines(spark, d).select(*wordboxes.LINE, words).select(*wordboxes.LINE, F.posexplode("w").alias("word", "w"))
    cols = F.col("w.cols")
    return found.select(*wordboxes.LINE, F.col("word").cast("long").alias("word"), "w.text", "w.kind", F.size(cols).cast("long").alias("n_chars"), cols[0].alias("first_col"), F.element_at(cols, -1).alias("last_col"))


BOX_SQL = chars_sql("scripts") + """
, sized AS (SELECT image_id, box_id, 400.0::DOUBLE / ((length(line) - 1) * 2 + (length(line) - 1) // 10 * 5 + 2) AS step, 400.0::DOUBLE / length(line) AS plain FROM lines)
, widths AS MATERIALIZED (
    SELECT image_id, box_id, any_value(step) AS step, bool_and(kind = 'EnNum') AS latin, coalesce(avg(CASE WHEN n_chars > 1 THEN (last_col - first_col) * step / (n_chars - 1) END), any_value(plain)) AS cw
    FROM words JOIN sized USING (image_id, box_id) GROUP BY ALL
), cells AS (
    SELECT image_id, box_id, pos, word, ch, row_number() OVER (PARTITION BY image_id, box_id ORDER BY pos) - 1 AS k, latin, greatest((col + 0.5) * step - cw / 2, 0) AS l, least((col + 0.5) * step + cw / 2, 400) AS r
    FROM solid JOIN widths USING (image_id, box_id)
)"""


#: Cut to thousandths here, as halves of these are frequent and depend on the last bit of a sum.
OFF_TIES = 0.137


def placed_sql(boxes_: str) -> str:
    """Boxes (image_id, box_id, word_id, text, l, r) with scores and corners in their lines."""
    x, y, skew = "(image_id * 37 % 500)", "(box_id * 25)", "(image_id % 5)"
    corner = {"x1": f"{x} + l", "y1": f"{y} + {skew} * l / 400", "x2": f"{x} + r", "y2": f"{y} + {skew} * r / 400", "x3": f"{x} + r", "y3": f"{y} + 20 + {skew} * r / 400", "x4": f"{x} + l", "y4": f"{y} + 20 + {skew} * l / 400"}
    return BOX_SQL + f", found AS ({boxes_}) SELECT image_id, box_id, word_id::INT AS word_id, text, prob AS score, " + ", ".join(f"floor(({v}) * 1000 + {OFF_TIES}) / 1000 AS {k}" for k, v in corner.items()) + " FROM found JOIN (SELECT image_id, box_id, pos AS word_id, prob FROM chars) USING (image_id, box_id, word_id)"


def boxed(spark: SparkSession, d: str, single: bool) -> DataFrame:
    found = wordboxes.word_boxes(wordboxes.word_results(text_lines(spark, d), single))
    return found.select(*wordboxes.LINE, "word_id", "text", "score", *((F.floor(F.col(c) * 1000 + OFF_TIES) / 1000).alias(c) for c in CORNERS))


@query(placed_sql("SELECT image_id, box_id, k AS word_id, ch AS text, l, r FROM cells"))
def char_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxed(spark, d, single=True)


@query(placed_sql("SELECT image_id, box_id, word AS word_id, string_agg(ch, '' ORDER BY pos) AS text, min(l) AS l, max(r) AS r FROM cells WHERE latin GROUP BY ALL UNION ALL SELECT image_id, box_id, k, ch, l, r FROM cells WHERE NOT latin"))
def word_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxed(spark, d, single=False)


SIZE_SQL = "WITH s AS (SELECT o_orderkey, (20 + o_orderkey % 4000)::INT AS w, (10 + o_custkey % 3000)::INT AS h FROM orders)"


@query(SIZE_SQL + """, a AS (
    SELECT *, CASE WHEN greatest(h, w) > 2000 THEN floor(floor(h * (2000.0::DOUBLE / greatest(h, w))) / 32 + 0.5) * 32 ELSE h END AS h1,
           CASE WHEN greatest(h, w) > 2000 THEN floor(floor(w * (2000.0::DOUBLE / greatest(h, w))) / 32 + 0.5) * 32 ELSE w END AS w1 FROM s
), b AS (
    SELECT *, CASE WHEN least(h1, w1) < 30 THEN floor(floor(h1 * (30.0::DOUBLE / nullif(least(h1, w1), 0))) / 32 + 0.5) * 32 ELSE h1 END AS h2,
           CASE WHEN least(h1, w1) < 30 THEN floor(floor(w1 * (30.0::DOUBLE / nullif(least(h1, w1), 0))) / 32 + 0.5) * 32 ELSE w1 END AS w2 FROM a
), c AS (SELECT *, least(h1, w1) > 0 AND coalesce(least(h2, w2) > 0, false) AS ok, CASE WHEN least(h1, w1) < 30 THEN h1 ELSE h END AS bh, CASE WHEN least(h1, w1) < 30 THEN w1 ELSE w END AS bw FROM b)
SELECT o_orderkey, CASE WHEN ok THEN h2::INT END AS new_h, CASE WHEN ok THEN w2::INT END AS new_w, CASE WHEN ok THEN round(bh / h2, 6) END AS ratio_h,
       CASE WHEN ok THEN round(bw / w2, 6) END AS ratio_w, CASE WHEN ok THEN 'ok' ELSE 'preprocess_error' END AS status FROM c""")
def resize_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = S.bounded_size(F.col("h"), F.col("w"))
    return sizes(spark, d).select("o_orderkey", out["new_h"].alias("new_h"), out["new_w"].alias("new_w"), F.round(out["ratio_h"], 6).alias("ratio_h"), F.round(out["ratio_w"], 6).alias("ratio_w"), out["status"].alias("status"))


@query(SIZE_SQL + " SELECT o_orderkey, (CASE WHEN h <= 30 OR w::DOUBLE / h > 8 THEN abs(greatest(floor(w / 8.0), 30) * 2 - h)::INT // 2 ELSE 0 END)::INT AS padding FROM s")
def vertical_padding(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d).select("o_orderkey", S.vertical_padding(F.col("h"), F.col("w")).alias("padding"))


@query(SIZE_SQL + """, l AS (SELECT *, CASE WHEN greatest(h, w) < 960 THEN 960 WHEN greatest(h, w) < 1500 THEN 1500 ELSE 2000 END AS most FROM s)
SELECT o_orderkey, most AS max_limit, (floor(floor(h * greatest(1, 736.0::DOUBLE / least(h, w))) / 32 + 0.5) * 32)::INT AS min_h, (floor(floor(w * greatest(1, 736.0::DOUBLE / least(h, w))) / 32 + 0.5) * 32)::INT AS min_w,
       (floor(floor(h * least(1, most::DOUBLE / greatest(h, w))) / 32 + 0.5) * 32)::INT AS max_h, (floor(floor(w * least(1, most::DOUBLE / greatest(h, w))) / 32 + 0.5) * 32)::INT AS max_w FROM l""")
def det_input_shape(spark: SparkSession, d: str) -> DataFrame:
    h, w, by_max = F.col("h"), F.col("w"), DetConfig(limit_type="max")
    small, large = S.detector_size(h, w), S.detector_size(h, w, by_max)
    return sizes(spark, d).select("o_orderkey", S.detector_limit(h, w, by_max).alias("max_limit"), small[0].alias("min_h"), small[1].alias("min_w"), large[0].alias("max_h"), large[1].alias("max_w"))


@query("SELECT vec_id, list_transform(range(1, 193), lambda i: round((trunc(abs(embedding[(i - 1) % 64 + 1]::DOUBLE) * 255 / (1 + (i - 1) // 64)) / 255 - 0.5) / 0.5, 5)) AS planes FROM embeddings")
def normalize_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each map as an image of three planes of unlike levels, through the tensor that models are fed: all red, then green, then blue."""

    def run(batches):
        for batch in batches:
            grey = np.abs(np.array(batch.column("probs").to_pylist(), np.float64).reshape(-1, 8, 8, 1)) * 255
            fed = [raster.tensor((g / np.array([1, 2, 3])).astype(np.uint8)).ravel().round(5).astype(np.float64) for g in grey]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(fed, pa.list_(pa.float64()))], names=["vec_id", "planes"])

    planes = maps(spark, d).mapInArrow(run, "vec_id long, planes array<double>")
    return planes.withColumn("planes", F.transform("planes", lambda v: F.round(v, 5)))


QUAD_SQL = """
WITH e AS (SELECT event_id, (event_id * 37) % 1900 AS x0, (event_id * 91) % 1100 AS y0, 2.0::DOUBLE + value AS w, 3.0::DOUBLE + user_id % 60 AS h, event_id % 7 - 3 AS skew FROM events), q AS (
    SELECT event_id // 100 AS image_id, event_id AS rank, x0::DOUBLE AS x1, y0::DOUBLE AS y1, x0 + w AS x2, (y0 + skew)::DOUBLE AS y2, x0 + w AS x3, y0 + h + skew AS y3, x0::DOUBLE AS x4, y0 + h AS y4,
           (event_id * 7919) % 1000 / 1000.0::DOUBLE AS score FROM e
)"""
AREA_SQL = "abs(x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2"


def side_sql(i: int, j: int) -> str:
    return f"sqrt((x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2)"


AROUND_SQL = " + ".join(side_sql(i % 4 + 1, i) for i in (1, 2, 3, 4))


@query(QUAD_SQL + f" SELECT rank, round({AREA_SQL}, 4) AS area, round({AROUND_SQL}, 4) AS perimeter FROM q")
def quad_area_perimeter(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("rank", F.round(Q.area(), 4).alias("area"), F.round(Q.perimeter(), 4).alias("perimeter"))


@query(QUAD_SQL + f", u AS (SELECT *, {AREA_SQL} * 1.6 / nullif({AROUND_SQL}, 0) AS dist FROM q) SELECT rank, round(dist, 4) AS distance, round(x2 - x1 + 2 * dist, 4) AS new_w, round(y4 - y1 + 2 * dist, 4) AS new_h FROM u")
def unclip(spark: SparkSession, d: str) -> DataFrame:
    distance = Q.unclip_distance()
    return boxes(spark, d).select("rank", F.round(distance, 4).alias("distance"), F.round(F.col("x2") - F.col("x1") + 2 * distance, 4).alias("new_w"), F.round(F.col("y4") - F.col("y1") + 2 * distance, 4).alias("new_h"))


ROTATED_SQL = QUAD_SQL + ", r AS (SELECT rank, x1 AS cx, y1 AS cy, x2 - x1 AS w, y4 - y1 AS h, radians((rank % 180)::DOUBLE) AS a FROM q)"


def corners_sql(w: str, h: str) -> str:
    return ", ".join(f"round(cx + {sx} * ({w}) / 2 * cos(a) - {sy} * ({h}) / 2 * sin(a), 4) AS x{n}, round(cy + {sx} * ({w}) / 2 * sin(a) + {sy} * ({h}) / 2 * cos(a), 4) AS y{n}" for n, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)), 1))


def turned(spark: SparkSession, d: str) -> DataFrame:
    out = Q.rectangle(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y4") - F.col("y1"), (F.col("rank") % 180).cast("double"))
    return boxes(spark, d).select("rank", *(out[c].alias(c) for c in CORNERS))


@query(ROTATED_SQL + ", g AS (SELECT *, w * h * 1.6::DOUBLE / (2 * (w + h)) AS dist FROM r) SELECT rank, " + corners_sql("w + 2 * dist", "h + 2 * dist") + " FROM g")
def unclip_polygon(spark: SparkSession, d: str) -> DataFrame:
    return turned(spark, d).select("rank", *rounded(Q.grown()))


SHUFFLED = {"x1": "x3", "y1": "y3", "x2": "x1", "y2": "y1", "x3": "x4", "y3": "y4", "x4": "x2", "y4": "y2"}


@query(QUAD_SQL + """, r AS (SELECT rank, list_sort([(x3, 0, y3), (x1, 1, y1), (x4, 2, y4), (x2, 3, y2)]) AS p FROM q)
, s AS (SELECT rank, CASE WHEN p[1][3] > p[2][3] THEN p[2] ELSE p[1] END AS a, CASE WHEN p[1][3] > p[2][3] THEN p[1] ELSE p[2] END AS dd, CASE WHEN p[3][3] > p[4][3] THEN p[4] ELSE p[3] END AS b, CASE WHEN p[3][3] > p[4][3] THEN p[3] ELSE p[4] END AS c FROM r)
SELECT rank, round(a[1], 4) AS x1, round(a[3], 4) AS y1, round(b[1], 4) AS x2, round(b[3], 4) AS y2, round(c[1], 4) AS x3, round(c[3], 4) AS y3, round(dd[1], 4) AS x4, round(dd[3], 4) AS y4 FROM s""")
def order_points(spark: SparkSession, d: str) -> DataFrame:
    mixed = boxes(spark, d).select("rank", *(F.col(v).alias(k) for k, v in SHUFFLED.items()))
    out = Q.ordered()
    return mixed.select("rank", *rounded({c: out[c] for c in CORNERS}))


@query(QUAD_SQL + " SELECT rank, " + ", ".join(f"round(greatest(least(x{n}, 1799), 0), 4) AS x{n}, round(greatest(least(y{n}, 999), 0), 4) AS y{n}" for n in (1, 2, 3, 4)) + " FROM q")
def clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("rank", *rounded(Q.clipped(F.lit(1800), F.lit(1000))))


@query(QUAD_SQL + " SELECT rank, " + ", ".join(f"round(x{n} * (1600.0::DOUBLE / 736), 4) AS x{n}, round(y{n} * (1200.0::DOUBLE / 480), 4) AS y{n}" for n in (1, 2, 3, 4)) + " FROM q")
def scale_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("rank", *rounded(Q.scaled(F.lit(1600 / 736), F.lit(1200 / 480))))


@query(QUAD_SQL + " SELECT rank, " + ", ".join(f"round(least(greatest(x{n} * 0.75::DOUBLE, 0), 1500), 4) AS x{n}, round(least(greatest(y{n} * 0.625::DOUBLE - 60, 0), 700), 4) AS y{n}" for n in (1, 2, 3, 4)) + " FROM q")
def unmap_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("rank", *rounded(Q.unmapped(F.lit(0.625), F.lit(0.75), F.lit(60.0), F.lit(1500), F.lit(700))))


@query(ROTATED_SQL + " SELECT rank, " + corners_sql("w", "h") + " FROM r")
def rotated_corners(spark: SparkSession, d: str) -> DataFrame:
    return turned(spark, d).select("rank", *rounded({c: F.col(c) for c in CORNERS}))


CROP_SQL = f", k AS (SELECT *, trunc(greatest({side_sql(1, 2)}, {side_sql(3, 4)}))::INT AS cw, trunc(greatest({side_sql(1, 4)}, {side_sql(2, 3)}))::INT AS ch FROM q)"


@query(QUAD_SQL + CROP_SQL + " SELECT rank, CASE WHEN ch::DOUBLE / cw >= 1.5 THEN ch ELSE cw END AS crop_w, CASE WHEN ch::DOUBLE / cw >= 1.5 THEN cw ELSE ch END AS crop_h, ch::DOUBLE / cw >= 1.5 AS rotated FROM k")
def crop_dims(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("rank", *(v.alias(k) for k, v in Q.crop_size().items()))


@query(QUAD_SQL + f" SELECT image_id, rank, score FROM q WHERE least(trunc({side_sql(1, 2)}), trunc({side_sql(1, 4)})) >= 3 AND score >= 0.5 AND trunc({side_sql(1, 2)}) > 3 AND trunc({side_sql(1, 4)}) > 3")
def box_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    shortest = F.least(S.whole(Q.side(0, 1)), S.whole(Q.side(0, 3)))
    return boxes(spark, d).where((shortest >= 3) & (F.col("score") >= 0.5) & Q.long_enough()).select("image_id", "rank", "score")


@query(QUAD_SQL + " SELECT image_id, rank, (row_number() OVER (PARTITION BY image_id ORDER BY floor(y1), floor(x1), rank) - 1)::INT AS box_id FROM q")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return decode.reading_order(boxes(spark, d)).select("image_id", "rank", "box_id")


@query(QUAD_SQL + f" SELECT image_id, label, rank::INT AS rank FROM (SELECT image_id, rank AS label, row_number() OVER (PARTITION BY image_id ORDER BY round({AREA_SQL}, 6) DESC, rank) AS rank FROM q) WHERE rank <= 10")
def candidate_topk(spark: SparkSession, d: str) -> DataFrame:
    shapes_ = boxes(spark, d).select("image_id", F.col("rank").alias("label"), F.round(Q.area(), 6).alias("area"))
    return segment.candidates(shapes_, 10).select("image_id", "label", "rank")


@query(QUAD_SQL + CROP_SQL + """, r AS (SELECT image_id, rank, CASE WHEN ch > 0 THEN cw::DOUBLE / ch ELSE 1 END AS ratio FROM k)
, b AS (SELECT *, ((row_number() OVER (PARTITION BY image_id ORDER BY ratio, rank) - 1) // 6)::INT AS batch_id FROM r)
, m AS (SELECT *, greatest(320.0::DOUBLE / 48, max(ratio) OVER (PARTITION BY image_id, batch_id)) AS most FROM b)
SELECT rank, batch_id, round(most, 6) AS max_ratio, floor(48 * most + 0.5)::INT AS batch_width, least(ceil(48 * ratio), floor(48 * most + 0.5))::INT AS own_width FROM m""")
def rec_batches(spark: SparkSession, d: str) -> DataFrame:
    w, h = S.whole(F.greatest(Q.side(0, 1), Q.side(2, 3))), S.whole(F.greatest(Q.side(0, 3), Q.side(1, 2)))
    crops = boxes(spark, d).select("image_id", F.col("rank").alias("box_id"), F.coalesce(F.try_divide(w.cast("double"), h), F.lit(1.0)).alias("ratio"))
    wide = F.floor(48 * F.col("max_ratio") + 0.5).cast("int")
    return decode.recognition_batches(crops).select(F.col("box_id").alias("rank"), "batch_id", F.round("max_ratio", 6).alias("max_ratio"), wide.alias("batch_width"), F.least(F.ceil(48 * F.col("ratio")).cast("int"), wide).alias("own_width"))


@query(QUAD_SQL + CROP_SQL + """, p AS (SELECT rank, (ceil(greatest(320, CASE WHEN ch > 0 THEN ceil(48 * cw / ch::DOUBLE) ELSE 48 END) / 64) * 64)::INT AS padded_width FROM k)
SELECT rank, padded_width, row_number() OVER (PARTITION BY padded_width ORDER BY rank) AS place FROM p""")
def line_widths(spark: SparkSession, d: str) -> DataFrame:
    """Padded widths that don't hang on batch mates, and each crop's place among those of its width over all images; a common width is dealt to salts and numbered in two steps."""
    w, h = S.whole(F.greatest(Q.side(0, 1), Q.side(2, 3))), S.whole(F.greatest(Q.side(0, 3), Q.side(1, 2)))
    crops = boxes(spark, d).select("rank", S.padded_width(w, h, 64).alias("padded_width"))
    return decode.numbered(crops, "padded_width", "rank", WIDTH_PART).withColumn("place", F.col("place").cast("long"))


MASK_SQL = f"""
WITH RECURSIVE px AS MATERIALIZED (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS p FROM embeddings, unnest(range(1, 65)) AS u(i)), fg AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE p > {THRESH})"""


@query(MASK_SQL + " SELECT * FROM fg")
def threshold_mask(spark: SparkSession, d: str) -> DataFrame:
    return segment.mask(segment.pixels(maps(spark, d)), THRESH).select("image_id", "y", "x")


@query(MASK_SQL + " SELECT DISTINCT image_id, (y - dy)::INT AS y, (x - dx)::INT AS x FROM fg, unnest([0, 1]) AS a(dy), unnest([0, 1]) AS b(dx) WHERE y >= dy AND x >= dx")
def dilate_mask(spark: SparkSession, d: str) -> DataFrame:
    return segment.dilated(segment.mask(segment.pixels(maps(spark, d)), THRESH))


LABEL_SQL = MASK_SQL + """, reach AS (
    SELECT image_id, y, x, y * 8 + x AS root FROM fg
    UNION SELECT f.image_id, f.y, f.x, r.root FROM reach r JOIN fg f ON f.image_id = r.image_id AND abs(f.y - r.y) + abs(f.x - r.x) = 1
), comp AS MATERIALIZED (SELECT image_id, y, x, min(root) AS root FROM reach GROUP BY ALL)
, lab AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root)::INT AS label FROM comp)
, edge AS (SELECT a.*, (SELECT count(*) FROM lab b WHERE b.image_id = a.image_id AND b.label = a.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1) < 4 AS is_boundary FROM lab a)"""


@query(LABEL_SQL + " SELECT image_id, label, y, x, is_boundary FROM edge")
def components(spark: SparkSession, d: str) -> DataFrame:
    return segment.components(maps(spark, d), THRESH)


@query(LABEL_SQL + """, ring AS (
    SELECT image_id, label, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM edge WHERE is_boundary WINDOW w AS (PARTITION BY image_id, label ORDER BY y, x)
), s AS (SELECT image_id, label, count(*) AS boundary, sum(x * ny - nx * y) AS s FROM ring GROUP BY ALL)
SELECT image_id, label, pixels, boundary, CASE WHEN boundary < 3 THEN 0.0::DOUBLE ELSE abs(s)::DOUBLE / 2 END AS area FROM s JOIN (SELECT image_id, label, count(*) AS pixels FROM lab GROUP BY ALL) USING (image_id, label)""")
def contour_area(spark: SparkSession, d: str) -> DataFrame:
    return segment.contour_areas(segment.components(maps(spark, d), THRESH))


#: Boxes of events in the maps of embeddings; most of the smaller tables' boxes have no map.
SPOTS_SQL = """
, spots AS (
    SELECT event_id % 2000 AS image_id, event_id AS box_id, ((event_id * 37) % 70)::DOUBLE / 10 AS x0, ((event_id * 91) % 70)::DOUBLE / 10 AS y0, 0.5::DOUBLE + ((event_id * 13) % 50)::DOUBLE / 10 AS w, 0.5::DOUBLE + (user_id % 50)::DOUBLE / 10 AS h, (event_id % 7 - 3)::DOUBLE / 5 AS skew FROM events
), quad AS (SELECT image_id, box_id, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 + skew AS y2, x0 + w AS x3, y0 + h + skew AS y3, x0 AS x4, y0 + h AS y4 FROM spots)
, cut AS (
    SELECT *, least(greatest(floor(least(x1, x2, x3, x4)), 0), 7)::INT AS left_, least(greatest(ceil(greatest(x1, x2, x3, x4)), 0), 7)::INT AS right_,
           least(greatest(floor(least(y1, y2, y3, y4)), 0), 7)::INT AS top_, least(greatest(ceil(greatest(y1, y2, y3, y4)), 0), 7)::INT AS bottom_ FROM quad
)"""


def spots(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    tenth = lambda v: v.cast("double") / 10
    x0, y0, skew = tenth(F.col("event_id") * 37 % 70), tenth(F.col("event_id") * 91 % 70), (F.col("event_id") % 7 - 3).cast("double") / 5
    w, h = 0.5 + tenth(F.col("event_id") * 13 % 50), 0.5 + tenth(F.col("user_id") % 50)
    corner = {"x1": x0, "y1": y0, "x2": x0 + w, "y2": y0 + skew, "x3": x0 + w, "y3": y0 + h + skew, "x4": x0, "y4": y0 + h}
    return e.select((F.col("event_id") % 2000).alias("image_id"), F.col("event_id").alias("box_id"), *(v.alias(k) for k, v in corner.items()), F.lit(8).alias("h"), F.lit(8).alias("w"))


def inside_sql() -> str:
    """Even-odd test of a pixel's centre."""
    tests = []
    for i in range(1, 5):
        j = i - 1 or 4
        tests.append(f"coalesce(((y{i} > y + 0.5::DOUBLE) <> (y{j} > y + 0.5::DOUBLE)) AND x + 0.5::DOUBLE < (x{j} - x{i}) * (y + 0.5::DOUBLE - y{i}) / nullif(y{j} - y{i}, 0) + x{i}, false)::INT")
    return f"({' + '.join(tests)}) % 2 = 1"


@query(MASK_SQL + SPOTS_SQL + f""", hit AS (
    SELECT c.image_id, c.box_id, avg(p) AS score FROM cut c JOIN px USING (image_id) WHERE left_ < right_ AND top_ < bottom_ AND x BETWEEN left_ AND right_ AND y BETWEEN top_ AND bottom_ AND {inside_sql()} GROUP BY ALL
) SELECT image_id, box_id, round(coalesce(score, 0), 6) AS score FROM cut LEFT JOIN hit USING (image_id, box_id)""")
def box_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each box's map inside it: boxes and pixels meet by tiles."""
    return segment.box_scores(segment.pixels(maps(spark, d)), spots(spark, d)).withColumn("score", F.round("score", 6))


POLYGON_SQL = """
, polygons AS (SELECT event_id % 2000 AS image_id, event_id AS polygon_id, unnest(range(5)) AS k, """ + ", ".join(f"((event_id * {m} + k * {n} * (1 + event_id % 11)) % 90)::DOUBLE / 10 - 0.5::DOUBLE AS {c}" for c, m, n in (("px_", 37, 29), ("py_", 53, 31))) + """ FROM events)
, low AS (SELECT polygon_id, least(greatest(floor(min(px_)), 0), 7) AS lx, least(greatest(floor(min(py_)), 0), 7) AS ly, least(greatest(ceil(max(px_)), 0), 8) AS hx, least(greatest(ceil(max(py_)), 0), 8) AS hy FROM polygons GROUP BY polygon_id)
, whole AS (SELECT p.image_id, polygon_id, k, trunc(px_ - lx)::BIGINT AS x, trunc(py_ - ly)::BIGINT AS y FROM polygons p JOIN low USING (polygon_id) WHERE hx > lx AND hy > ly)
, sides AS (SELECT a.polygon_id, a.k, CASE WHEN a.y <= b.y THEN a.x ELSE b.x END AS xa, least(a.y, b.y) AS ya, CASE WHEN a.y <= b.y THEN b.x ELSE a.x END AS xb, greatest(a.y, b.y) AS yb FROM whole a JOIN whole b ON a.polygon_id = b.polygon_id AND b.k = (a.k + 1) % 5)
, met AS (
    SELECT polygon_id, k, y, yb, xa + (y - ya) * (xb - xa)::DOUBLE / (yb - ya) AS exact, floor((2 * (xa * (yb - ya) + (y - ya) * (xb - xa)) + (yb - ya))::DOUBLE / (2 * (yb - ya)))::BIGINT AS x FROM sides, unnest(range(ya, yb + 1)) AS u(y) WHERE ya < yb
), nth AS (SELECT *, row_number() OVER (PARTITION BY polygon_id, y ORDER BY exact, x) AS r FROM met WHERE y < yb)
, spans AS (
    SELECT polygon_id, ya AS y, least(xa, xb) AS a, greatest(xa, xb) AS b FROM sides WHERE ya = yb
    UNION ALL SELECT polygon_id, y, x, x FROM met
    UNION ALL SELECT p.polygon_id, p.y, p.x, q.x FROM nth p JOIN nth q ON p.polygon_id = q.polygon_id AND p.y = q.y AND q.r = p.r + 1 WHERE p.r % 2 = 1
), inked AS (SELECT DISTINCT polygon_id, y, x FROM spans, unnest(range(a, b + 1)) AS u(x))
, meant AS (SELECT polygon_id, avg(p) AS score FROM inked i JOIN low USING (polygon_id) JOIN px ON px.image_id = polygon_id % 2000 AND px.y = i.y + ly AND px.x = i.x + lx WHERE i.y <= hy - ly AND i.x <= hx - lx GROUP BY polygon_id)"""


@query(MASK_SQL + POLYGON_SQL + " SELECT DISTINCT p.image_id, polygon_id, round(coalesce(score, 0), 6) AS score FROM polygons p LEFT JOIN meant USING (polygon_id)")
def polygon_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each map inside filled polygons of five corners, most of which cross themselves."""
    e = F.col("event_id")
    at = lambda m, n: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((e * m + k * n * (1 + e % 11)) % 90).cast("double") / 10 - 0.5)
    events = spread(spark.read.parquet(f"{d}/events.parquet").select("event_id"))
    polygons = events.select((e % 2000).alias("image_id"), e.alias("polygon_id"), at(37, 29).alias("xs"), at(53, 31).alias("ys"))
    return borders_.polygon_scores(maps(spark, d), polygons).withColumn("score", F.round("score", 6))


#: Largest distance of a chord from its arc.
ARC = 0.25
TURNS_SQL = ", ".join(f"atan2((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}), (x{b} - x{a}) * (x{c} - x{b}) + (y{b} - y{a}) * (y{c} - y{b})) AS t{b}" for a, b, c in ((4, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 1)))


@query(QUAD_SQL + f", u AS (SELECT *, {AREA_SQL} AS area, {AROUND_SQL} AS around, {AREA_SQL} * 1.6::DOUBLE / ({AROUND_SQL}) AS dist, {TURNS_SQL} FROM q), v AS (SELECT *, 2 * acos(1 - least({ARC}::DOUBLE, dist) / dist) AS step FROM u)"
    + " SELECT rank, round(dist, 4) AS distance, (" + " + ".join(f"ceil(t{n} / step - 1e-9) + 1" for n in (1, 2, 3, 4)) + ")::INT AS n_points, round(area + around * dist + dist * dist / 2 * (" + " + ".join(f"ceil(t{n} / step - 1e-9) * sin(t{n} / ceil(t{n} / step - 1e-9))" for n in (1, 2, 3, 4)) + "), 3) AS area FROM v")
def round_offset(spark: SparkSession, d: str) -> DataFrame:
    """Quadrilaterals grown with round corners; SQL has the closed form of convex polygons."""
    quads = spread(boxes(spark, d)).select("rank", F.array(*Q.X).alias("xs"), F.array(*Q.Y).alias("ys"))
    found = borders_.grown_polygons(quads, ["rank"], tolerance=ARC)
    return found.select("rank", F.round("distance", 4).alias("distance"), "n_points", F.round("area", 3).alias("area"))


@query(MASK_SQL + """, crack AS MATERIALIZED (
    SELECT f.image_id, y, x, s, (y * 8 + x) * 4 + s AS c FROM fg f, unnest(range(4)) AS u(s) WHERE NOT EXISTS (SELECT 1 FROM fg g WHERE g.image_id = f.image_id AND g.y = f.y + CASE s WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AND g.x = f.x + CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)
), ways AS (
    SELECT *, CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS fy, CASE s WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS fx, CASE s WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS oy, CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS ox FROM crack
), after AS MATERIALIZED (
    SELECT w.image_id, c, w.y, w.x, s, CASE WHEN g.y IS NOT NULL THEN (g.y * 8 + g.x) * 4 + (s + 3) % 4 WHEN a.y IS NOT NULL THEN (a.y * 8 + a.x) * 4 + s ELSE (w.y * 8 + w.x) * 4 + (s + 1) % 4 END AS n
    FROM ways w LEFT JOIN fg a ON a.image_id = w.image_id AND a.y = w.y + fy AND a.x = w.x + fx LEFT JOIN fg g ON g.image_id = w.image_id AND g.y = w.y + fy + oy AND g.x = w.x + fx + ox
), round_ AS (
    SELECT image_id, c AS start, c, 0 AS k FROM after UNION ALL SELECT r.image_id, r.start, a.n, k + 1 FROM round_ r JOIN after a ON a.image_id = r.image_id AND a.c = r.c WHERE a.n > r.start
), closed AS (SELECT r.image_id, r.start FROM round_ r JOIN after a ON a.image_id = r.image_id AND a.c = r.c WHERE a.n = r.start)
, walk AS MATERIALIZED (SELECT r.image_id, r.start, k, a.y, a.x FROM round_ r JOIN closed USING (image_id, start) JOIN after a ON a.image_id = r.image_id AND a.c = r.c)
, moved AS (SELECT *, coalesce((y, x) IS DISTINCT FROM (lag(y) OVER w, lag(x) OVER w), true) AS new FROM walk WINDOW w AS (PARTITION BY image_id, start ORDER BY k))
, dots AS MATERIALIZED (
    SELECT image_id, start, row_number() OVER (PARTITION BY image_id, start ORDER BY k) AS i, y, x FROM moved m WHERE new AND NOT (k > 0 AND y * 8 + x = start // 4 AND NOT EXISTS (SELECT 1 FROM moved o WHERE o.image_id = m.image_id AND o.start = m.start AND o.k > m.k AND o.new))
), sizes AS (SELECT image_id, start, count(*) AS n FROM dots GROUP BY ALL)
, beside AS (
    SELECT d.*, n, b.y AS by_, b.x AS bx_, a.y AS ay_, a.x AS ax_ FROM dots d JOIN sizes USING (image_id, start)
    JOIN dots b ON b.image_id = d.image_id AND b.start = d.start AND b.i = (d.i + n - 2) % n + 1 JOIN dots a ON a.image_id = d.image_id AND a.start = d.start AND a.i = d.i % n + 1
)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY start) - 1)::INT AS border, start % 4 > 0 AS is_hole, any_value(n)::INT AS n_points, abs(sum(x * ay_ - ax_ * y))::DOUBLE / 2 AS area,
       count(*) FILTER (WHERE n < 3 OR (ay_ - y, ax_ - x) IS DISTINCT FROM (y - by_, x - bx_))::INT AS n_corners FROM beside GROUP BY image_id, start""")
def borders(spark: SparkSession, d: str) -> DataFrame:
    """Outer and hole borders of each map. SQL walks from crack to crack, from the least of each cycle."""
    return borders_.borders(maps(spark, d), THRESH).select("image_id", "border", "is_hole", "n_points", "area", F.size("xs").alias("n_corners"))


def outlines(spark: SparkSession, d: str) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("y", "x")))
    edge = segment.components(maps(spark, d), THRESH).where("is_boundary").groupBy("image_id", "label").agg(points.alias("s")).where(F.size("s") >= 4)
    return edge.select("image_id", "label", F.transform("s", lambda p: p["x"]).alias("xs"), F.transform("s", lambda p: p["y"]).alias("ys"))


@query(LABEL_SQL + """, big AS MATERIALIZED (SELECT image_id, label, x, y FROM edge WHERE is_boundary QUALIFY count(*) OVER (PARTITION BY image_id, label) >= 4)
, dir AS (SELECT DISTINCT a.image_id, a.label, b.x - a.x AS dx, b.y - a.y AS dy FROM big a JOIN big b USING (image_id, label) WHERE (a.x, a.y) <> (b.x, b.y))
, hull AS (SELECT d.image_id, d.label, dx, dy, max(p.x * dx + p.y * dy) - min(p.x * dx + p.y * dy) AS u, max(p.y * dx - p.x * dy) - min(p.y * dx - p.x * dy) AS v FROM dir d JOIN big p USING (image_id, label) GROUP BY ALL)
SELECT image_id, label, round(min(u * v::DOUBLE / (dx * dx + dy * dy)), 4) AS rect_area FROM hull GROUP BY image_id, label""")
def min_area_rect(spark: SparkSession, d: str) -> DataFrame:
    """The smallest rectangle's area. SQL tries the directions of all pairs of points: no other is smaller than one along an edge."""
    found = shapes.rectangles(outlines(spark, d), ["image_id", "label"], truncate=False)
    return found.select("image_id", "label", F.round(F.col("w") * F.col("h"), 4).alias("rect_area"))


@query(LABEL_SQL + """, big AS MATERIALIZED (SELECT image_id, label, x, y FROM edge WHERE is_boundary QUALIFY count(*) OVER (PARTITION BY image_id, label) >= 4)
, side AS (
    SELECT a.image_id, a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS cy,
           min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) AS least,
           max(CASE WHEN (b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) THEN (p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y) END) AS far,
           min(CASE WHEN (b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) THEN (p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y) END) AS near
    FROM big a JOIN big b USING (image_id, label) JOIN big p USING (image_id, label) WHERE (a.x, a.y) <> (b.x, b.y) GROUP BY ALL
)
SELECT image_id, label, count(*)::INT AS hull_points, round(abs(sum(ax * cy - bx * ay))::DOUBLE / 2, 4) AS hull_area
FROM side WHERE least >= 0 AND near = 0 AND far = (bx - ax) ** 2 + (cy - ay) ** 2 GROUP BY image_id, label""")
def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    return shapes.rectangles(outlines(spark, d), ["image_id", "label"]).select("image_id", "label", "hull_points", "hull_area")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Lines in reading order with scores and a text each, as recognition would give them."""
    kept = decode.reading_order(boxes(spark, d).where("score >= 0.5"))
    return kept.select("image_id", "box_id", F.concat(F.lit("line "), F.col("rank").cast("string")).alias("text"), "score", *CORNERS)


RESULT_SQL = QUAD_SQL + ", res AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY floor(y1), floor(x1), rank) - 1)::INT AS box_id, 'line ' || rank AS text FROM q WHERE score >= 0.5)"


@query(RESULT_SQL + ", i AS (SELECT DISTINCT event_id // 50 AS image_id FROM events) SELECT i.image_id, count(text) AS n_lines, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, round(coalesce(avg(score), 0), 6) AS mean_score FROM i LEFT JOIN res USING (image_id) GROUP BY i.image_id")
def image_summary_query(spark: SparkSession, d: str) -> DataFrame:
    """Half of these images have no lines and stay."""
    all_images = spark.read.parquet(f"{d}/events.parquet").select(F.expr("event_id DIV 50").alias("image_id"))
    return image_summary(all_images, results(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query(RESULT_SQL + " SELECT image_id, box_id, text || chr(9) || printf('%.3f', score) || chr(9) || printf('%.1f,%.1f,%.1f,%.1f,%.1f,%.1f,%.1f,%.1f', x1, y1, x2, y2, x3, y3, x4, y4) AS value FROM (SELECT * REPLACE (" + ", ".join(f"floor({c} * 4) / 4 + 0.01 AS {c}" for c in CORNERS) + ") FROM res)")
def format_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Corners stand clear of halves, which the two engines' formatters round differently."""
    return sinks.as_tsv(results(spark, d).withColumns({c: F.floor(F.col(c) * 4) / 4 + 0.01 for c in CORNERS}))


@query(RESULT_SQL + " SELECT image_id, string_agg(text, chr(10) ORDER BY box_id) AS value FROM res GROUP BY image_id")
def format_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.as_text(results(spark, d))


POINTS_SQL = "[" + ", ".join(f"{{'x': x{n}, 'y': y{n}}}" for n in (1, 2, 3, 4)) + "]"


@query(RESULT_SQL + f""" SELECT image_id, to_json({{'boxes': list({POINTS_SQL} ORDER BY box_id), 'txts': list(text ORDER BY box_id), 'scores': list(score ORDER BY box_id), 'word_results': list([]::VARCHAR[] ORDER BY box_id)}})::VARCHAR AS value
FROM (SELECT * REPLACE (""" + ", ".join(f"floor({c} * 4) / 4 AS {c}" for c in CORNERS) + ") FROM res) GROUP BY image_id")
def format_json(spark: SparkSession, d: str) -> DataFrame:
    """Corners are quarters, which both engines write alike."""
    return sinks.as_json(results(spark, d).withColumns({c: F.floor(F.col(c) * 4) / 4 for c in CORNERS}))


@query(RESULT_SQL + " SELECT image_id, box_id, text, round(score, 6) AS score, " + ", ".join(f"round({c}, 4) AS {c}" for c in CORNERS) + " FROM res")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = sinks.from_json_rows(sinks.to_json_rows(results(spark, d)))
    return back.select("image_id", "box_id", "text", F.round("score", 6).alias("score"), *rounded({c: F.col(c) for c in CORNERS}))


#: Pictures that are drawn at once.
DRAWN = 64


def pictures(spark: SparkSession, d: str, scale: int = 16) -> DataFrame:
    """Each map as a grey image, `scale` pixels to a value; DRAWN at once."""
    bounded_batches(spark)

    def draw(batches):
        for batch in (b.slice(a, DRAWN) for b in batches for a in range(0, b.num_rows, DRAWN)):
            data = []
            for probs in batch.column("probs").to_pylist():
                grey = np.kron(np.clip(np.abs(np.array(probs)) * 600, 0, 255).astype(np.uint8).reshape(8, 8), np.ones((scale, scale), np.uint8))
                data.append(np.repeat(grey[:, :, None], 3, 2).tobytes())
            n, side = len(data), 8 * scale
            columns = [batch.column("image_id"), *(pa.array([v] * n, pa.int32()) for v in (side, side, 3)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", "height", "width", "nChannels", "data"])

    return maps(spark, d).mapInArrow(draw, "image_id long, height int, width int, nChannels int, data binary")


TAPS_SQL = """
, {n}t AS (SELECT k, floor((k + 0.5::DOUBLE) * {source} / {target} - 0.5)::INT AS low, (k + 0.5::DOUBLE) * {source} / {target} - 0.5 AS exact FROM range({target}) AS r(k))
, {n} AS (SELECT k::INT AS k, greatest(least(low, {source} - 1), 0) AS a, least(greatest(least(low, {source} - 1), 0) + 1, {source} - 1) AS b, CASE WHEN low < 0 OR low >= {source} - 1 THEN 0 ELSE floor((exact - low) * 2048 + 0.5)::BIGINT END AS w FROM {n}t)"""


@query("WITH g AS MATERIALIZED (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, trunc(least(abs(embedding[i]::DOUBLE) * 600, 255))::BIGINT AS v FROM embeddings, unnest(range(1, 65)) AS u(i))"
    + TAPS_SQL.format(n="rows_", source=8, target=5) + TAPS_SQL.format(n="cols_", source=8, target=13)
    + """ SELECT p.image_id, r.k AS y, c.k AS x, ((p.v * (2048 - c.w) + q.v * c.w) * (2048 - r.w) + (s.v * (2048 - c.w) + t.v * c.w) * r.w + 2097152) // 4194304 AS value
FROM rows_ r, cols_ c JOIN g p ON p.y = r.a AND p.x = c.a JOIN g q ON q.image_id = p.image_id AND q.y = r.a AND q.x = c.b JOIN g s ON s.image_id = p.image_id AND s.y = r.b AND s.x = c.a JOIN g t ON t.image_id = p.image_id AND t.y = r.b AND t.x = c.b""")
def resize_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel of each map as a small grey image at 5 by 13, in whole numbers."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                made = raster.resize_fixed(images.pixels_of(r["height"], r["width"], r["nChannels"], r["data"]), 5, 13)[:, :, 0]
                y, x = np.indices(made.shape)
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * made.size, pa.int64()), *(pa.array(v.ravel().astype(np.int32)) for v in (y, x)), pa.array(made.ravel().astype(np.int64))], names=["image_id", "y", "x", "value"])

    return pictures(spark, d, 1).mapInArrow(run, "image_id long, y int, x int, value long")


@query()
def resize_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(pictures(spark, d, 4), lambda img: raster.resize(img, 20, 48))


@query()
def warp_crop(spark: SparkSession, d: str) -> DataFrame:
    quad = np.array([(3.0, 2.0), (27.0, 5.0), (25.0, 20.0), (2.0, 17.0)])
    return _pixels(pictures(spark, d, 4), lambda img: raster.crop(img, quad))


def _pixels(rows: DataFrame, kernel) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [kernel(images.pixels_of(r["height"], r["width"], r["nChannels"], r["data"])) for r in batch.to_pylist()]
            columns = [pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([float(m.mean()) for m in made])]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *columns], names=["image_id", "height", "width", "mean"])

    return rows.mapInArrow(run, "image_id long, height int, width int, mean double")


@query()
def ocr_e2e(spark: SparkSession, d: str) -> DataFrame:
    settings = Config(det=DetConfig(limit_type="max", box_thresh=0.3), glob=GlobalConfig(text_score=0.3, return_word_box=True))
    return ocr(pictures(spark, d), Recognition(config=settings))
