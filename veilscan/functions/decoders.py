"""Decoded variants of a text, as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.functions.text import passes, unicode_classes
from veilscan.functions.validators import decoded_base64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def printable_share(text: Column) -> Column:
    """Share of characters that can be printed, line breaks and tabs included; 0 for an empty text."""
    shown = F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ \n\r\t]]", ""))
    return F.when(F.length(text) > 0, shown / F.length(text)).otherwise(0.0)


def is_printable(text: Column) -> Column:
    return printable_share(text) > R.PRINTABLE_SHARE


def _readable(found: Column, decode) -> Column:
    texts = F.transform(found, lambda v: F.try_validate_utf8(decode(v)))
    return F.filter(texts, lambda t: t.isNotNull() & is_printable(t))


def base64_variants(text: Column) -> Column:
    return _readable(F.regexp_extract_all(text, F.lit(R.BASE64_RUN), F.lit(0)), decoded_base64)


def hex_variants(text: Column) -> Column:
    return _readable(F.regexp_extract_all(text, F.lit(R.HEX_RUN), F.lit(0)), F.unhex)


def url_decoded(text: Column) -> Column:
    """Per cent escapes decoded; ``+`` and malformed escapes stay; null where bytes are no UTF-8."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def url_variants(text: Column) -> Column:
    decoded = F.when(F.contains(text, F.lit("%")), url_decoded(text))
    return F.when(decoded.isNotNull() & (decoded != text), F.array(decoded)).otherwise(F.array().cast("array<string>"))


def rot13(text: Column) -> Column:
    turn = lambda s: s[13:] + s[:13]
    return F.translate(text, _UPPER + _LOWER, turn(_UPPER) + turn(_LOWER))


def rot13_variants(text: Column) -> Column:
    hinted = passes(text, "(?i)rot|caesar") & text.rlike(unicode_classes(R.ROT13_HINT))  # the plain test spares most texts the other
    return F.when(hinted, F.array(rot13(text))).otherwise(F.array().cast("array<string>"))


def variants(text: Column) -> Column:
    """All decoded variants, distinct and in order."""
    return F.array_sort(F.array_distinct(F.concat(base64_variants(text), hex_variants(text), url_variants(text), rot13_variants(text))))
