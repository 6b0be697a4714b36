"""Validators of matched values, as boolean Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules as R


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The check sum of card numbers: from the right, every second digit doubled and its digits added."""
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    parts = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))
    return (F.length(_digits(value)) > 0) & (total % 10 == 0)


def _dihedral() -> list[list[int]]:
    """Products in the symmetry group of a pentagon: rotations 0 to 4, reflections 5 to 9."""

    def product(a: int, b: int) -> int:
        ra, rb, fa, fb = a % 5, b % 5, a // 5, b // 5
        return (ra - rb if fa else ra + rb) % 5 + 5 * (fa ^ fb)

    return [[product(a, b) for b in range(10)] for a in range(10)]


def _permutations() -> list[list[int]]:
    """Powers 0 to 7 of Verhoeff's permutation."""
    base, out = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        out.append([base[i] for i in out[-1]])
    return out


def verhoeff(value: Column) -> Column:
    """The check of twelve-digit identity numbers: products of permuted digits from the right end in the unit."""
    # tables as strings of digits: one literal each instead of arrays of arrays
    products = F.lit("".join(str(x) for row in _dihedral() for x in row))
    permuted = F.lit("".join(str(x) for row in _permutations() for x in row))
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    moved = F.transform(digits, lambda c, i: permuted.substr((i % 8) * 10 + c.cast("int") + 1, F.lit(1)))
    check = F.aggregate(moved, F.lit("0"), lambda a, x: products.substr(a.cast("int") * 10 + x.cast("int") + 1, F.lit(1)))
    return (F.length(_digits(value)) == 12) & (check == "0")


def pan(value: Column) -> Column:
    return (F.length(value) == 10) & F.contains(F.lit(R.PAN_HOLDERS), F.upper(F.substring(value, 4, 1)))


def upi(value: Column) -> Column:
    low = F.lower(value)
    scoped = low.rlike(R.NPM_PACKAGE)
    for scope in R.NPM_SCOPES:
        scoped = scoped | low.startswith(scope)
    return ~scoped & (F.length(low) - F.length(F.replace(low, F.lit("@"), F.lit(""))) == 1) & (F.length(F.substring_index(low, "@", 1)) > 0) & F.substring_index(low, "@", -1).isin(*R.UPI_PROVIDERS)


def shape(kind: str, value: Column) -> Column:
    return value.rlike(rf"^(?:{R.SHAPES[kind]})\z")


def decoded_base64(value: Column) -> Column:
    """Bytes of a base64 run of any padding; null where its length is impossible."""
    core = F.rtrim(value, F.lit("="))
    return F.when(F.length(core) % 4 != 1, F.try_to_binary(F.rpad(core, F.length(core) + F.pmod(-F.length(core), F.lit(4)), "="), F.lit("base64")))


def jwt(value: Column) -> Column:
    """Three parts, the first two of them JSON in base64url."""
    parts = F.split(value, r"\.", -1)

    def is_json(k: int) -> Column:
        text = F.try_validate_utf8(decoded_base64(F.translate(F.try_element_at(parts, F.lit(k)), "-_", "+/")))
        return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))

    return (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "") & is_json(1) & is_json(2)


def by_name(name: str | Callable[[Column], Column], value: Column) -> Column:
    if callable(name):
        return name(value)
    own = {"luhn": luhn, "verhoeff": verhoeff, "pan": pan, "upi": upi, "jwt": jwt}
    return own[name](value) if name in own else shape(name, value)
