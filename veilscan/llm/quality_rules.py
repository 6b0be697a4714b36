"""Quality rules: a learned decision list over text statistics.

Sequential covering in the manner of Fürnkranz's incremental reduced-error pruning: each rule is a
conjunction of thresholds grown on two thirds of the labelled rows by information gain, pruned on the
remaining third, and the rows it covers are removed before the next rule is grown.  The result is an ordered
list that becomes one ``CASE WHEN`` expression, so the verdict runs inside the JVM.

Defined results: a null or empty text has all statistics 0; rows are judged one by one, so repeated rows get
equal verdicts; an empty table gives an empty result; no labelled rows, or labels of one kind only, give an
empty list, which keeps everything that passes the base rule; columns other than ``doc_id`` and ``text`` are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm.common import WORDS, bounded_sample, map_batches

#: Fixed values of the base statistics.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: At most so many labelled rows are used to learn the list.
SAMPLE_ROWS = 12_000

STATS_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_upper long, n_letters long, n_digits long, n_punct long, n_lines long, n_distinct long, longest_word long"
)
_SPACE, _SYMBOL, _UPPER, _LETTER, _DIGIT, _PUNCT = range(6)


def _class_table() -> np.ndarray:
    kinds = np.full(0x10000, _PUNCT, dtype=np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            kinds[code] = _UPPER if char.isupper() else _LETTER
        elif char.isdigit():
            kinds[code] = _DIGIT
    for char in SYMBOLS:
        kinds[ord(char)] = _SYMBOL
    for char in " \t\n\v\f\r":
        kinds[ord(char)] = _SPACE
    return kinds


_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _class_table()
    return _CLASSES


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text has twice or more, its first place included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    starts = np.fromiter((seen[g] > 1 for g in grams), dtype=np.int32, count=len(grams))
    steps = np.zeros(len(words) + 1, dtype=np.int32)
    steps[: len(grams)] += starts
    steps[window : window + len(grams)] -= starts
    return int((np.cumsum(steps[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``STATS_SCHEMA`` after doc_id."""
    if not text:
        return (0,) * 12
    words = WORDS.findall(text)
    lines = text.split("\n")
    duplicates, seen = 0, set()
    for line in lines:
        if line in seen:
            duplicates += 1
        elif WORDS.search(line):
            seen.add(line)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=6)
    return (
        len(words),
        len(codes) - int(kinds[_SPACE]),
        int(kinds[_SYMBOL]),
        duplicates,
        repeated_words(words),
        int(kinds[_UPPER]),
        int(kinds[_UPPER] + kinds[_LETTER]),
        int(kinds[_DIGIT]),
        int(kinds[_PUNCT]),
        len(lines),
        len(set(words)),
        max(map(len, words), default=0),
    )


STATS = tuple(f.split()[0] for f in STATS_SCHEMA.split(", "))[1:]


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row of statistics for each row of ``docs`` (doc_id, text), over the whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(statistics(t) for t in batch.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *STATS])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, STATS_SCHEMA)


def with_statistics(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column ``row`` beside the statistics of their texts, so that no name can clash."""
    kind = docs.schema["text"].dataType
    if kind != T.StringType():
        raise TypeError(f"text is {kind}")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).field("text").to_pylist()
        columns = zip(*(statistics(t) for t in texts), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["row", *STATS])

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return map_batches(rows, run, T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in STATS)]))


def _ratio(top: str, below: str) -> F.Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(below).cast("double")), F.lit(0.0))


def measures() -> dict[str, F.Column]:
    """The measures that rules may test, as Spark expressions over the statistics."""
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "upper_ratio": _ratio("n_upper", "n_letters"),
        "digit_ratio": _ratio("n_digits", "word_chars"),
        "punct_ratio": _ratio("n_punct", "word_chars"),
        "letter_ratio": _ratio("n_letters", "word_chars"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "distinct_ratio": _ratio("n_distinct", "n_words"),
        "mean_word": _ratio("word_chars", "n_words"),
        "longest_word": F.col("longest_word").cast("double"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def mask(self, data: dict[str, np.ndarray]) -> np.ndarray:
        values = data[self.measure]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> F.Column:
        value = measures()[self.measure]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction; texts that meet it are of poor quality."""

    conditions: tuple[Condition, ...]

    def mask(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.mask(data) for c in self.conditions])

    def column(self) -> F.Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _best_condition(data: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[Condition, float] | None:
    """The threshold with the most of FOIL's information gain among the rows where ``weight`` is set."""
    p0, n0 = bad[weight].sum(), (~bad[weight]).sum()
    if not p0 or not n0:
        return None
    base, best = math.log2(p0 / (p0 + n0)), None
    for name, values in data.items():
        order = np.argsort(values[weight], kind="stable")
        v, b = values[weight][order], bad[weight][order]
        ends = np.flatnonzero(np.diff(v) > 0)
        if not len(ends):
            continue
        low_p, low_n = np.cumsum(b)[ends], np.cumsum(~b)[ends]
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[1]):
                best = Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)), float(gain[k])
    return best


def learn(data: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 24, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3) -> list[Rule]:
    """Ordered rules for ``bad`` rows by sequential covering; ``data`` has one array for each measure."""
    rules: list[Rule] = []
    if not len(bad) or bad.all() or not bad.any():
        return rules
    part = np.random.default_rng(20).permutation(len(bad)) % 3
    grow, prune, left = part != 0, part == 0, np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules and (bad & left & grow).any():
        conditions: list[Condition] = []
        covered = left & grow
        while len(conditions) < max_conditions and (~bad & covered).any():
            found = _best_condition(data, bad, covered)
            if found is None:
                break
            conditions.append(found[0])
            covered &= found[0].mask(data)
        if not conditions:
            break

        def worth(k: int, held: np.ndarray) -> float:
            mask = Rule(tuple(conditions[:k])).mask(data) & held
            p, n = int((bad & mask).sum()), int((~bad & mask).sum())
            return (p - n) / (p + n) if p + n else -1.0

        held = prune & left
        best = max(range(1, len(conditions) + 1), key=lambda k: (worth(k, held), -k))
        rule = Rule(tuple(conditions[:best]))
        mask = rule.mask(data) & left
        p, n = int((bad & mask).sum()), int((~bad & mask).sum())
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left &= ~mask
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled rows; ``stats`` is a table of statistics of exactly those rows or more."""
    rows = stats.join(labels, "doc_id").select("doc_id", "bad", *(c.alias(n) for n, c in measures().items()))
    # of rows that repeat an id the least counts, so there are no more rows than labels and reruns agree
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("bad", *measures())).alias("row")).select("row.*").limit(sample_rows).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(list(rows.columns), kind="stable")  # the order in which rows arrive decides nothing
    return learn({n: rows[n].to_numpy(dtype=float) for n in measures()}, rows["bad"].to_numpy(dtype=bool))


def training_labels(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample of labelled ids: doc_id, bad."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 0).alias("bad"))
    return bounded_sample(known, "doc_id", sample_rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn the list from labelled documents; only the sampled documents' statistics are computed for it."""
    sample = training_labels(labels, sample_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left_semi")  # at most sample_rows ids
    return learn_rules(text_statistics(chosen), F.broadcast(sample), sample_rows)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fired_rule(rules: list[Rule]) -> F.Column:
    """The number (from 0) of the first rule of the list that fires, else null: one ordered CASE WHEN."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(0))
    for k, rule in enumerate(rules[1:], 1):
        out = out.when(rule.column(), F.lit(k))
    return out.cast("int")


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics and verdict for each row of ``docs``."""
    judged = text_statistics(docs).withColumns({"base_failed": base_failed(), "rule": fired_rule(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` (all columns) that pass the base rules and the learned list."""
    return with_statistics(docs).where(~base_failed() & fired_rule(rules).isNull()).select("row.*")
