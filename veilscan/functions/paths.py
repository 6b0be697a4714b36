"""Path predicates and the reputation of a path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules as R


def normalized(path: Column) -> Column:
    """The path with forward slashes."""
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def lowered(path: Column) -> Column:
    return F.lower(normalized(path))


def basename(path: Column) -> Column:
    return F.element_at(F.split(lowered(path), "/"), -1)


def components(path: Column) -> Column:
    return F.filter(F.split(lowered(path), "/"), lambda c: c != "")


def extension(name: Column) -> Column:
    """The last extension with its dot; leading dots begin no extension."""
    return F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(value, F.lit(p)) for p in parts))


def first_match(path: Column, scores: tuple[tuple[str, int], ...]) -> Column:
    chain = F.when(path.rlike(scores[0][0]), F.lit(scores[0][1]))
    for pattern, score in scores[1:]:
        chain = chain.when(path.rlike(pattern), F.lit(score))
    return chain.otherwise(F.lit(0))


def reputation(path: Column) -> Column:
    """The first match of each of three groups, summed."""
    p = normalized(path)
    return first_match(p, R.POSITIVE_REPUTATION) + first_match(p, R.NEGATIVE_REPUTATION) + first_match(p, R.APPLICATION_DATA)


def is_suppressed(path: Column) -> Column:
    """No rule, path rules included, reports anything for such a path."""
    return contains_any(lowered(path), R.SUPPRESSED_PATH_PARTS)


def path_entity(path: Column) -> Column:
    """The entity of the first path rule that the path meets, else null."""
    p = normalized(path)
    chain = F.when(p.rlike(R.PATH_RULES[0][0]), R.PATH_RULES[0][1])
    for pattern, entity in R.PATH_RULES[1:]:
        chain = chain.when(p.rlike(pattern), entity)
    return chain


def is_distribution(path: Column) -> Column:
    """Something to install, below a downloads folder."""
    parts = components(path)
    return F.array_contains(parts, "downloads") & F.exists(parts, lambda c: extension(c).isin(*R.DISTRIBUTION_EXTENSIONS))


def is_excluded(path: Column) -> Column:
    name, parts = basename(path), components(path)
    return (
        name.startswith("$")
        | (name == "system volume information")
        | F.arrays_overlap(parts, F.array(*map(F.lit, R.EXCLUDED_COMPONENTS)))
        | name.isin(*R.EXCLUDED_FILES)
        | name.isin(*R.EXCLUDED_APPS)
        | F.exists(parts, lambda c: c.endswith(".app"))
        | is_distribution(path)
        | contains_any(lowered(path), R.EXCLUDED_PATH_PARTS)
    )


def is_own_database(path: Column, table_names: Column) -> Column:
    """A database file that holds this library's own tables."""
    return extension(basename(path)).isin(".db", ".sqlite", ".sqlite3") & (F.size(F.array_except(F.array(*map(F.lit, R.OWN_TABLES)), F.coalesce(table_names, F.array().cast("array<string>")))) == 0)


def scan_decision(path: Column, table_names: Column | None = None) -> Column:
    """``scan``, ``excluded`` or ``unsupported_extension``."""
    name = basename(path)
    own = is_own_database(path, table_names) if table_names is not None else F.lit(False)
    suffix = F.when((extension(name) == "") & name.startswith("."), name).otherwise(extension(name))
    return F.when(is_excluded(path) | name.endswith(".log") | name.endswith(".evtx") | own, "excluded").when(suffix.isin(*R.SCANNED_EXTENSIONS) | (name == "config"), "scan").otherwise("unsupported_extension")


def is_generated_source(path: Column) -> Column:
    """Build output, whose tokens look random but are no secrets."""
    name = basename(path)
    return name.isin(*R.GENERATED_FILES) | F.arrays_overlap(components(path), F.array(*map(F.lit, R.GENERATED_DIRECTORIES))) | contains_any(name, R.GENERATED_NAME_PARTS)


def control_share_below(head: Column) -> Column:
    """Whether bytes below 32 other than tab, line feed and carriage return are rare; empty heads count as text."""
    pairs = F.filter(F.regexp_extract_all(F.hex(head), F.lit("(..)"), F.lit(1)), lambda h: (h < "20") & ~h.isin("09", "0A", "0D"))
    return (F.octet_length(head) == 0) | (F.size(pairs) / F.octet_length(head) < R.CONTROL_SHARE)


def triage(path: Column, head: Column) -> Column:
    """The parser for a file by its first bytes, else by how many control bytes its first 512 have."""
    start = F.hex(F.substring(head, 1, 8))
    chain = F.when(head.isNull(), "SKIP")
    for magic, parser in R.MAGICS:
        kind = F.when(extension(basename(path)).isin(*R.OFFICE_EXTENSIONS), "office_parser").otherwise("archive_parser") if parser == "zip" else F.lit(parser)
        chain = chain.when(start.startswith(magic.hex().upper()), kind)
    return chain.when(control_share_below(F.substring(head, 1, 512)), "text_parser").otherwise("SKIP")
