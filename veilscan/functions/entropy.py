"""Tokens and their randomness, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.functions.paths import contains_any
from veilscan.functions.text import spans, unicode_classes

TOKEN = r"[^\s\x1c-\x1f\"'=:]+"


def stripped_token(token: Column) -> Column:
    return F.btrim(token, F.lit(R.TOKEN_STRIPPED))


def tokens(text: Column, all_lengths: bool = False) -> Column:
    """Runs without white space, quotes, ``=`` and ``:``; those whose stripped length can matter, unless all are asked for."""
    if all_lengths:
        return spans(text, TOKEN)
    # only runs of the least length are found at all; stripping may make them shorter
    long = TOKEN.removesuffix("+") + f"{{{R.TOKEN_MIN},}}"
    return spans(text, long, long, lambda v: F.length(stripped_token(v)).between(R.TOKEN_MIN, R.TOKEN_MAX))


def token_count(text: Column) -> Column:
    """How many runs leave something when they are stripped; only their beginnings are looked at, no array of runs is made."""
    cut = "".join("\\" + c for c in R.TOKEN_STRIPPED if c not in "\"'")
    one = TOKEN.removesuffix("+")
    return F.regexp_count(text, F.lit(unicode_classes(f"(?<!{one})[{cut}]*+{one.removesuffix(']')}{cut}]")))


def shannon(token: Column) -> Column:
    """Bits per character."""
    n = F.length(token).cast("double")

    def part(c: Column) -> Column:
        return (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / n

    chars = F.filter(F.array_distinct(F.split(token, "")), lambda c: c != "")
    return F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def charset(token: Column) -> Column:
    return F.when(token.rlike(rf"^{R.HEX_TOKEN}$"), "hex").when(token.rlike(rf"^{R.BASE64_TOKEN}$"), "base64").otherwise("alphanumeric")


def class_count(token: Column) -> Column:
    """How many of upper case, lower case, digits and other characters a token has."""
    kinds = (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[^\p{L}\p{N}]")
    return reduce(lambda a, b: a + b, (token.rlike(k).cast("int") for k in kinds))


def is_false_positive(token: Column) -> Column:
    """Lengths, one-class tokens, and shapes that are no secrets: URLs, paths, file and package names, UUIDs."""
    out = ~F.length(token).between(R.TOKEN_MIN, R.TOKEN_MAX) | (class_count(token) < 2)
    for pattern in R.TOKEN_EXCLUSIONS:
        out = out | token.rlike(pattern)
    return out


_ASSET = "(" + "|".join(e.replace(".", r"\.") for e in R.ASSET_EXTENSIONS) + ")"


def is_beside_asset(token: Column, context: Column) -> Column:
    """Whether an asset's extension comes right after or before the token, white space between them aside.

    White space beside extensions only is taken out, so that what is split elsewhere does not count as one.
    """
    low, near = F.lower(token), F.lower(context)
    space = r"(?U)[\s\x1c-\x1f]+"
    behind, ahead = F.regexp_replace(near, space + _ASSET, "$1"), F.regexp_replace(near, "(?U)" + _ASSET + r"[\s\x1c-\x1f]+", "$1")
    return reduce(lambda a, b: a | b, (F.contains(behind, F.concat(low, F.lit(e))) | F.contains(ahead, F.concat(F.lit(e), low)) for e in R.ASSET_EXTENSIONS))


def is_build_artifact(token: Column, context: Column) -> Column:
    """Asset names, tokens beside an asset's extension, and identifiers where the context speaks of a build."""
    return contains_any(F.lower(token), R.ASSET_EXTENSIONS) | is_beside_asset(token, context) | (contains_any(F.lower(context), R.BUILD_HINTS) & token.rlike(rf"^{R.GENERATED_ID}\z"))


def threshold(kind: Column, boosted: Column) -> Column:
    chain = None
    for name, value in R.ENTROPY_THRESHOLDS.items():
        own = F.when(boosted, F.lit(value - R.ENTROPY_KEYWORD_BOOST)).otherwise(F.lit(value))
        chain = F.when(kind == name, own) if chain is None else chain.when(kind == name, own)
    return chain


def margin(h: Column, least: Column) -> Column:
    """How far the entropy is above the threshold, in steps; 0 where too little."""
    chain = F.when(h - least >= R.ENTROPY_MARGINS[0][0], R.ENTROPY_MARGINS[0][1])
    for step, value in R.ENTROPY_MARGINS[1:]:
        chain = chain.when(h - least >= step, value)
    return chain.otherwise(0.0)
