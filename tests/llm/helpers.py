from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
LONG = "word " * 60_000 + "end"
#: Nulls in every column, empty and blank texts, a very long one, odd characters, a repeated row.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, "one two three four five six seven", "en", None, 33),
    (5, "one two three four five six seven", "en", None, 33),
    (6, "one two three four five six seven", "de", "b", 33),
    (None, "no id here at all, but words", "fr", "c", 28),
    (7, "\x00\x1c\u2028 😀 Ǆ ﷺ 漢字 <|endoftext|> e\u0301 İ", None, "c", 30),
    (8, "short", "en", "c", 5),
]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, DOCS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """``df`` with columns named like those that operators make."""
    names = ("score", "size", "n_words", "row", "kept", "key", "id", "n", "digest", "keys", "cells", "taken", "times", "source_size", "target", "lang_pred", "bin", "finish", "upto", "range", "root", "class_id", "start", "sequence_id", "rule", "host", "path", "payload", "refers_to", "digest_", "block", "v", "s", "r", "in_question", "dropped_id", "_row", "number", "source_of_line", "ends_of_line", "lap_of_mix", "spot", "ends", "lap", "words", "hub", "main", "met", "length", "first", "size_", "left", "right", "line", "place")
    return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))


def documents(spark: SparkSession, folder: str = SMALL) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, name: str, folder: str = SMALL) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
