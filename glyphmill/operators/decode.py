"""CTC decoding and word segmentation of whole tables of time steps, in windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = 0
GAP = 5
# The characters that Unicode calls white space.
SPACE = "^[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]$"


def argmax(probs: Column) -> tuple[Column, Column]:
    """The first of the greatest classes (from 0), and its probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int"), F.array_max(probs)


def collected(logits: DataFrame, line: str = "line_id", t: str = "t", probs: str = "probs") -> DataFrame:
    """line, tokens and probs (of each step's greatest class, in order of t), from rows of steps; a line has as many as its model makes."""
    token, prob = argmax(F.col(probs))
    steps = logits.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), token.alias("token"), prob.cast("double").alias("prob")))).alias("s"))
    return steps.select(line, F.col("s.token").alias("tokens"), F.col("s.prob").alias("probs"))


def kept(tokens: Column, probs: Column) -> Column:
    """Steps (col, token, prob rounded to five places) that are no repetition of the step before and no blank.

    Repetitions are of raw tokens, before blanks go: a, blank, a keeps both.
    """
    steps = F.transform(F.arrays_zip(tokens.alias("token"), probs.alias("prob")), lambda s, i: F.struct(i.alias("col"), s["token"].alias("token"), F.round(s["prob"], 5).alias("prob"), F.get(tokens, i - 1).alias("before")))
    chosen = F.filter(steps, lambda s: (s["token"] != BLANK) & ~s["token"].eqNullSafe(s["before"]))
    return F.transform(chosen, lambda s: F.struct(s["col"].alias("col"), s["token"].alias("token"), s["prob"].alias("prob")))


def symbols(characters: Sequence[str]) -> Column:
    """A dictionary as an array: blank first, a space last; some thousand entries."""
    return F.lit(["blank", *characters, " "])


def text_of(kept: Column, symbols: Column) -> Column:
    """The characters of kept steps; classes that the dictionary lacks give none."""
    return F.array_join(F.transform(kept, lambda s: F.get(symbols, s["token"])), "")


def score_of(kept: Column) -> Column:
    """The mean of the kept steps' probabilities, 0 for none; classes that the dictionary lacks count."""
    total = F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s["prob"])
    return F.coalesce(total / F.nullif(F.size(kept), F.lit(0)), F.lit(0.0))


def is_cjk(ch: Column) -> Column:
    return ch.rlike("[\\u4e00-\\u9fff]")


def segmented(chars: DataFrame, kind: Column, line: list[str], pos: str = "pos", col: str = "col", ch: str = "ch") -> DataFrame:
    """chars that are no white space, with kind and word (from 0 in each line).

    A word ends at white space, where the kind changes (from the last character that is no white space), or
    where the columns since the character before are more than GAP; the first gap is at most three.
    """
    order = Window.partitionBy(*line).orderBy(pos)
    gap = F.col(col) - F.lag(col).over(order)
    steps = chars.withColumns({"kind": kind, "gap": F.coalesce(gap, F.lit(0)), "space": F.col(ch).rlike(SPACE), "after_space": F.coalesce(F.lag(ch).over(order).rlike(SPACE), F.lit(False))})
    solid = steps.where(~F.col("space"))
    before = F.lag("kind").over(order)
    # white space between two solid characters breaks, and so does the first of a line, which starts word 0
    breaks = F.col("after_space") | (F.col("gap") > GAP) | before.isNull() | (before != F.col("kind"))
    marked = solid.withColumn("break", breaks.cast("int"))
    return marked.withColumn("word", F.sum("break").over(order) - 1).drop("break", "gap", "space", "after_space")


def words(solid: DataFrame, line: list[str], pos: str = "pos", col: str = "col", ch: str = "ch") -> DataFrame:
    """word, its text, kind, columns and number of characters."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(ch).alias("c"), F.col(col).alias("k"))))
    return solid.groupBy(*line, "word").agg(sorted_.alias("s"), F.first("kind").alias("kind")).select(
        *line, "word", F.array_join(F.transform("s", lambda x: x["c"]), "").alias("text"), "kind", F.transform("s", lambda x: x["k"]).alias("cols"), F.size("s").alias("n_chars")
    )


def recognition_batches(crops: DataFrame, image: str = "image_id", box: str = "box_id", ratio: str = "ratio", size: int = 6, floor: float = 320 / 48) -> DataFrame:
    """crops with batch_id (by rising ratio, `size` to a batch) and the batch's greatest ratio, from keys alone."""
    rank = F.row_number().over(Window.partitionBy(image).orderBy(ratio, box)) - 1
    dealt = crops.withColumn("batch_id", F.floor(rank / size).cast("int"))
    most = F.max(ratio).over(Window.partitionBy(image, "batch_id"))
    return dealt.withColumn("max_ratio", F.greatest(F.lit(floor), most))


def numbered(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """rows with place: from 1 within a group by a whole-numbered order, ties as they come.

    A group is cut into parts of `size` neighbouring values of order, which are numbered for themselves; the rows of all
    parts before come from a running sum over parts. So a group that has most rows is many tasks.
    """
    part = rows.withColumn("part", F.floor(F.col(order) / size))
    sizes = part.groupBy(group, "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "part", before.alias("before"))
    placed = part.withColumn("nth", F.row_number().over(Window.partitionBy(group, "part").orderBy(order)))
    return placed.join(starts, [group, "part"]).withColumn("place", F.col("before") + F.col("nth")).drop("part", "before", "nth")


def reading_order(boxes: DataFrame, image: str = "image_id", rank: str = "rank") -> DataFrame:
    """boxes with box_id: by whole y, then whole x of the first corner, then rank."""
    order = Window.partitionBy(image).orderBy(F.floor("y1"), F.floor("x1"), rank)
    return boxes.withColumn("box_id", (F.row_number().over(order) - 1).cast("int"))
