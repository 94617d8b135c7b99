"""Results as text: plain lines, tab-separated rows, one JSON document an image, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.schemas import CORNERS, RESULT


def tsv_line(text: Column, score: Column, corners: list[Column]) -> Column:
    return F.concat_ws("\t", text, F.format_string("%.3f", score), F.concat_ws(",", *(F.format_string("%.1f", c) for c in corners)))


def as_tsv(results: DataFrame) -> DataFrame:
    return results.select("image_id", "box_id", tsv_line(F.col("text"), F.col("score"), [F.col(c) for c in CORNERS]).alias("value"))


def as_text(results: DataFrame) -> DataFrame:
    """image_id and value: an image's texts, a line each, in order of box_id."""
    rows = F.array_sort(F.collect_list(F.struct("box_id", "text")))
    return results.groupBy("image_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("value"))


def as_json(results: DataFrame, words: bool = False, pretty: bool = False) -> DataFrame:
    """image_id and value: boxes, txts, scores and word_results as parallel lists, a document for each image.

    word_results are empty lists, unless words asks for those of the lines (text, score and box; lines need word_results
    then, null ones count as empty). pretty: on lines of their own, indented.
    """

    def box(row: Column | None = None) -> Column:
        get = F.col if row is None else (lambda c: row[c])
        return F.array(*(F.struct(get(f"x{n}").alias("x"), get(f"y{n}").alias("y")) for n in (1, 2, 3, 4)))

    empty = F.array().cast("array<string>")
    held = F.struct("box_id", box().alias("box"), "text", "score", *(["word_results"] if words else []))
    grouped = results.groupBy("image_id").agg(F.array_sort(F.collect_list(held), lambda a, b: a["box_id"] - b["box_id"]).alias("rows"))
    if words:
        found = F.transform("rows", lambda r: F.coalesce(F.transform(r["word_results"], lambda w: F.struct(w["text"].alias("text"), w["score"].alias("score"), box(w).alias("box"))), F.array()))
    else:
        found = F.transform("rows", lambda r: empty)
    document = F.struct(
        F.transform("rows", lambda r: r["box"]).alias("boxes"), F.transform("rows", lambda r: r["text"]).alias("txts"),
        F.transform("rows", lambda r: r["score"]).alias("scores"), found.alias("word_results"),
    )
    return grouped.select("image_id", F.to_json(document, {"pretty": str(pretty).lower()}).alias("value"))


def to_json_rows(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*RESULT.names)).alias("value"))


def from_json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("value", RESULT).alias("r")).select("r.*")


def write(results: DataFrame, path: str, form: str = "json", words: bool = False, pretty: bool = False) -> None:
    """Rows or documents as lines of text files, in order. words and pretty: of JSON, see as_json()."""
    made = as_json(results, words, pretty) if form == "json" else {"text": as_text, "tsv": as_tsv}[form](results)
    order = ["image_id", "box_id"] if form == "tsv" else ["image_id"]
    made.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("error").text(path)
