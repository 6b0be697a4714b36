"""Greedy suppression of overlapping candidates within one row's array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def best_first(candidates: Column, *order) -> Column:
    """The array sorted by keys made from an element, each ascending; the element itself rides along."""
    keyed = F.transform(candidates, lambda c: F.struct(*(key(c).alias(f"k{i}") for i, key in enumerate(order)), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def keep_greedily(ordered: Column, kind: str, clash) -> Column:
    """Elements in order, without those that clash with one kept before; ``kind`` is the array's type."""
    return F.aggregate(ordered, F.array().cast(kind), lambda kept, c: F.when(F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.array_append(kept, c)))


def by_priority(candidates: Column, kind: str) -> Column:
    """Candidates by clipped score, length and category, then rule and place; overlapping later ones go."""
    ordered = best_first(
        candidates,
        lambda c: -F.least(F.lit(100), F.greatest(F.lit(0), c["confidence_score"])),
        lambda c: c["start"] - c["end"],
        lambda c: F.when(c["category"] == "HIGH_SENSITIVE", 0).otherwise(1),
        lambda c: F.coalesce(c["rule_idx"], F.lit(-1)),
        lambda c: c["start"],
    )
    return keep_greedily(ordered, kind, overlaps)
