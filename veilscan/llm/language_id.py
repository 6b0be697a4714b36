"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from training texts; a text belongs to the language
whose dictionary lets it be compressed to the fewest bytes.  Texts are compressed in blocks, so that a long
text's own repetitions don't stand in for the dictionary, and over their whole length.  Where the best two are
within a narrow margin the operator rejects: the row is flagged, and its score is low.

Training takes a bounded number of texts for each language, in the order of a hash, and a stretch of
bounded length from each; languages with no training text are not known.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without a trained language
everything is ``und``; rows are judged one by one, so repeated rows get equal results; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import slices

#: Bounds of training: texts for each language, the length of the stretch taken from each, bytes of a dictionary.
TEXTS_PER_LANGUAGE = 200
CHARS_PER_TEXT = 600
DICTIONARY_BYTES = 64_000
BLOCK = 2_000
LEVEL = 7
#: Saved bytes of the best over the second, as a share of the best; below it the text is rejected.
MARGIN = 0.004
#: How a margin becomes a score.
SHARPNESS = 60.0
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def train(texts: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionaries from rows of (doc_id, text, lang): at most ``per_language`` texts of each language reach the driver."""
    known = texts.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    counts = known.groupBy("lang").agg(F.count("*").alias("rows_of_lang"))  # a row for each language
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    rows = known.select("lang", unit("lang").alias("h"), "doc_id", "text").join(F.broadcast(counts), "lang")
    # four times as many as wanted pass by their hash alone, wherever they are; of these the least hashes are taken
    rows = rows.where(F.col("h") * F.col("rows_of_lang") < 4 * per_language)
    spot = (unit("spot") * F.greatest(F.lit(1), F.length("text") - CHARS_PER_TEXT)).cast("int") + 1  # a stretch from anywhere in the text
    rows = rows.select("lang", "h", "doc_id", F.col("text").substr(spot, F.lit(CHARS_PER_TEXT)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    chosen = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    out: dict[str, bytes] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], -r["k"])):
        out[row["lang"]] = out.get(row["lang"], b"") + row["text"].lower().encode("utf-8", "ignore") + b"\n"
    return {lang: data[-DICTIONARY_BYTES:] for lang, data in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text for each language."""
        data = text.lower().encode("utf-8", "ignore")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], dtype=float)

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the margin is too narrow."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        weights = np.exp(-SHARPNESS * (sizes / sizes[best] - 1.0))
        margin = float(np.min(np.delete(sizes, best)) / sizes[best] - 1.0) if len(sizes) > 1 else 1.0
        return self.languages[best], float(weights[best] / weights.sum()), margin, margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of each row's whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in slices(batches):
            columns = zip(*(classifier.classify(t) for t in batch.column(1).to_pylist()), strict=True)
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
