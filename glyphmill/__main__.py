"""python -m glyphmill IMAGES OUT [-f json|text|tsv] [--words] [--pretty] [--det MODEL.onnx --rec MODEL.onnx --dict FILE]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from glyphmill.config import Config, GlobalConfig
from glyphmill.plans.pipeline import Recognition, ocr
from glyphmill.sources.images import dictionary, image_files
from glyphmill.sources.sinks import write


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glyphmill", description="Read the text lines of images.")
    parser.add_argument("images")
    parser.add_argument("out")
    parser.add_argument("-f", "--format", choices=["json", "text", "tsv"], default="json")
    parser.add_argument("--det")
    parser.add_argument("--rec")
    parser.add_argument("--dict")
    parser.add_argument("--words", action="store_true", help="word boxes in JSON")
    parser.add_argument("--pretty", action="store_true", help="JSON on several lines")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    settings = {}
    if given.det:
        settings["detector"] = ("onnx", given.det)
    if given.rec:
        settings["recogniser"] = ("onnx", given.rec)
    if given.dict:
        listed = dictionary(spark, given.dict).orderBy("class_id").collect()  # a dictionary's few thousand characters
        settings["characters"] = tuple(r["ch"] for r in listed[1:-1])
    if given.words:
        settings["config"] = Config(glob=GlobalConfig(return_word_box=True))
    lines = ocr(image_files(spark, given.images), Recognition(**settings))
    write(lines.where("error IS NULL").drop("error"), given.out, given.format, given.words, given.pretty)


if __name__ == "__main__":
    main()
