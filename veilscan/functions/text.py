"""Spans of a pattern, windows of context, masks, scores: Column expressions over a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules as R

_SPANS = "array<struct<start:int,end:int,value:string>>"


def unicode_classes(pattern: str) -> str:
    """Java's classes and word boundaries made Unicode-aware, whatever the Java version."""
    return "(?U)" + pattern


def passes(text: Column, guard: str | None) -> Column:
    """Whether the text has what the guard asks for; plain strings are searched for without a pattern."""
    if guard is None:
        return text.isNotNull()
    folded = guard.startswith("(?i)")
    parts = guard.removeprefix("(?i)").split("|")
    if any(set(p) & set(r"\.^$*+?{}[]()") for p in parts):
        return text.rlike(unicode_classes(guard))
    if folded:  # the long s and the Kelvin sign are s and k to a pattern, but are no capitals
        odd = [c for c, plain in (("\u017f", "s"), ("\u212a", "k")) if any(plain in p for p in parts)]
        any_of = lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in (*parts, *odd)))
        return text.isNotNull() & F.exists(F.array(F.lower(text)), any_of)  # an array of one, so that the text is lowered once
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


#: A code point that is no character; matches are set between two of it.
MARK = "\uffff"
#: Pieces of a text that are walked at once; even, as each chunk begins between two matches.
CHUNK = 128


def spans(text: Column, pattern: str, guard: str | None = None, keep=None) -> Column:
    """All matches as array<struct<start, end, value>>, offsets in code points.

    There is no function for match positions.  So one pass of the pattern sets marks around the matches, the text is
    cut at the marks into what lies between the matches and the matches themselves, by turns, and offsets are
    running sums over these.  A text that has the mark itself is cut by the pattern instead, in two passes.
    ``guard`` is a cheap test that spares most texts both; ``keep`` filters values within the sums, so that long arrays
    are never built.  Appending copies an array, so pieces are walked a chunk at a time: a text of very many matches
    copies no more than a chunk's for each of them.
    """
    pattern = unicode_classes(pattern)
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    twice = F.flatten(F.transform(F.arrays_zip(between.alias("gap"), found.alias("value")), lambda x: F.array_compact(F.array(x["gap"], x["value"]))))
    once = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    empty = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x)
        wanted = state["match"] if keep is None else state["match"] & keep(x)
        out = F.when(wanted, F.array_append(state["out"], F.struct(state["at"].alias("start"), end.alias("end"), x.alias("value")))).otherwise(state["out"])
        return F.struct(end.alias("at"), (~state["match"]).alias("match"), out.alias("out"))

    def walk(state: Column, chunk: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), F.lit(False).alias("match"), empty.alias("out"))
        longer = lambda s: F.when(F.size(s["out"]) > 0, F.array_append(state["out"], s["out"])).otherwise(state["out"])
        return F.aggregate(chunk, begin, step, lambda s: F.struct(s["at"].alias("at"), longer(s).alias("out")))

    def chunks(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(CHUNK)), lambda k: F.slice(pieces, k + 1, F.lit(CHUNK)))

    pieces = F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)
    cut = F.flatten(F.transform(F.array(pieces), chunks))  # an array of one, so that the text is cut once
    walked = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), walk, lambda s: F.flatten(s["out"]))
    return F.when(passes(text, guard), walked).otherwise(empty)


def window(text: Column, start: Column, end: Column, size: int = R.CONTEXT_CHARS) -> Column:
    """The text from ``size`` characters before a span to as many behind it."""
    first = F.greatest(start - size, F.lit(0))
    return text.substr(first + 1, F.least(F.length(text), end + size) - first)


#: White space as stripping knows it: Unicode's, and the four separators from U+001C on.
SPACE_CLASS = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def flattened(context: Column) -> Column:
    return stripped(F.replace(context, F.lit("\n"), F.lit(" ")))


def has_any(lowered: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(lowered, k))


def has_assignment(context: Column) -> Column:
    return context.rlike(unicode_classes(R.ASSIGNMENT))


def mask(value: Column) -> Column:
    """Up to six characters are hidden wholly; of longer values the first four and last two stay."""
    n = F.length(value)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), n - 6), F.right(value, F.lit(2))))


def severity(category: Column) -> Column:
    chain = None
    for name, level in R.SEVERITY.items():
        chain = F.when(category == name, level) if chain is None else chain.when(category == name, level)
    return chain.otherwise("MEDIUM")


def points(flag: Column | bool, worth: int) -> Column:
    return F.when(F.lit(flag) if isinstance(flag, bool) else F.coalesce(flag, F.lit(False)), F.lit(worth)).otherwise(F.lit(0))


def score(reputation: Column, *, regex=False, entropy=False, validated=False, keyword=False, assignment=False, strong=False) -> Column:
    """The sum of what speaks for a candidate; a passed strong validator lifts it to at least 90."""
    total = reputation + points(regex, R.REGEX_SCORE) + points(entropy, R.ENTROPY_SCORE) + points(validated, R.VALIDATOR_SCORE) + points(keyword, R.KEYWORD_SCORE) + points(assignment, R.ASSIGNMENT_SCORE)
    return F.when(F.lit(strong) if isinstance(strong, bool) else strong, F.greatest(total, F.lit(R.STRONG_SCORE))).otherwise(total).cast("int")


def confidence(total: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), total)) / F.lit(100.0)


def publishable(total: Column) -> Column:
    return total >= R.PUBLISH_SCORE
