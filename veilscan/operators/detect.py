"""Detectors: DataFrame in, one row per candidate or finding out.

All steps up to the last are expressions over an array in the text's own row, so detection, scoring and overlap
suppression need no shuffle; only then is the array exploded.  ``explode_outer`` and a filter on its result keep
Catalyst from copying the array's expression below (see :mod:`veilscan.session`).

Columns named in ``keep`` are carried along; the text and, where given, the path are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.functions import decoders, entropy, overlap, paths, text, validators
from veilscan.schemas import CANDIDATE

_CANDIDATES = f"array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>"


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _of_rule(values, idx: Column) -> Column:
    """A rule's attribute by its number, from a constant array."""
    return F.element_at(_literals(values), idx + 1)


def rule_spans(content: Column, rules: tuple[R.Rule, ...] = R.RULES) -> Column:
    """Matches of all rules: array<struct<rule_idx, start, end, value>>, those of one rule by place."""

    def of(idx: int, rule: R.Rule) -> Column:
        return F.transform(text.spans(content, rule.pattern, rule.guard), lambda s: F.struct(F.lit(idx).alias("rule_idx"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    none = F.array().cast("array<struct<rule_idx:int,start:int,end:int,value:string>>")
    numeric = [of(i, r) for i, r in enumerate(rules) if r.digits]
    rest = [of(i, r) for i, r in enumerate(rules) if not r.digits]
    if numeric:
        rest.append(F.when(content.rlike(text.unicode_classes(R.FOUR_DIGITS)), F.concat(*numeric)).otherwise(none))
    return F.concat(none, *rest)


def _valid(idx: Column, value: Column, rules: tuple[R.Rule, ...]) -> Column:
    chain = None
    for i, rule in enumerate(rules):
        if rule.validator:
            own = validators.by_name(rule.validator, value)
            chain = F.when(idx == i, own) if chain is None else chain.when(idx == i, own)
    return F.lit(True) if chain is None else chain.otherwise(True)


def regex_candidates(content: Column, reputation: Column, rules: tuple[R.Rule, ...] = R.RULES, found: Column | None = None) -> Column:
    """Validated and scored matches, published or not, as an array of candidates; ``found`` are the spans, if known."""
    keywords = F.array(*(_literals(r.keywords) if r.keywords else F.array().cast("array<string>") for r in rules))
    valid = F.filter(rule_spans(content, rules) if found is None else found, lambda s: _valid(s["rule_idx"], s["value"], rules))
    placed = F.transform(valid, lambda s: F.struct(s.alias("s"), text.window(content, s["start"], s["end"]).alias("near")))

    def scored(p: Column) -> Column:
        s, near = p["s"], p["near"]
        checked = _of_rule([r.validator is not None for r in rules], s["rule_idx"])
        total = text.score(
            reputation,
            regex=True,
            validated=checked,
            keyword=text.has_any(F.lower(near), F.element_at(keywords, s["rule_idx"] + 1)),
            assignment=text.has_assignment(near),
            strong=_of_rule([r.strong for r in rules], s["rule_idx"]),
        )
        return F.struct(p["s"].alias("s"), p["near"].alias("near"), total.alias("total"), checked.alias("checked"))

    def candidate(p: Column) -> Column:
        s, category = p["s"], _of_rule([r.category for r in rules], p["s"]["rule_idx"])
        return F.struct(
            F.lit("regex").alias("detector"),
            _of_rule([r.name for r in rules], s["rule_idx"]).alias("rule_name"),
            s["rule_idx"].alias("rule_idx"),
            _of_rule([r.entity for r in rules], s["rule_idx"]).alias("entity_type"),
            category.alias("category"),
            s["value"].alias("raw_value"),
            text.flattened(p["near"]).alias("context"),
            p["total"].alias("confidence_score"),
            text.confidence(p["total"]).alias("confidence"),
            text.severity(category).alias("severity"),
            p["checked"].alias("requires_validation"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        )

    return F.transform(F.transform(placed, scored), candidate).cast(_CANDIDATES)


def settled(candidates: Column) -> Column:
    """Candidates worth publishing, overlapping ones suppressed."""
    return overlap.by_priority(F.filter(candidates, lambda c: text.publishable(c["confidence_score"])), _CANDIDATES)


def regex_findings(content: Column, reputation: Column, rules: tuple[R.Rule, ...] = R.RULES) -> Column:
    return settled(regex_candidates(content, reputation, rules))


def count_by_entity(df: DataFrame, content: str = "text", path: str | None = None) -> DataFrame:
    """entity_type, checked, validated, published: how many matches of the rules got how far, in one pass over the texts."""
    rows = _prepared(df, [], content, path).withColumn("_spans", rule_spans(F.col("_text")))
    rows = rows.withColumn("_candidates", regex_candidates(F.col("_text"), F.col("_reputation"), found=F.col("_spans")))
    steps = {
        "checked": F.transform("_spans", lambda s: _of_rule([r.entity for r in R.RULES], s["rule_idx"])),
        "validated": F.transform("_candidates", lambda c: c["entity_type"]),
        "published": F.transform(settled(F.col("_candidates")), lambda c: c["entity_type"]),
    }

    def marked_as(kind: str, found: Column) -> Column:
        return F.transform(found, lambda e: F.struct(e.alias("entity_type"), F.lit(kind).alias("kind")))

    marked = F.concat(*(marked_as(kind, found) for kind, found in steps.items()))
    reached = rows.select(F.explode_outer(marked).alias("m")).where("m is not null").select("m.*")
    return reached.groupBy("entity_type").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in steps))


def entropy_findings(content: Column, reputation: Column) -> Column:
    """Random-looking tokens worth publishing, each clean token once, in order of place."""
    cleaned = F.transform(entropy.tokens(content), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), entropy.stripped_token(t["value"]).alias("value")))
    suspicious = F.filter(cleaned, lambda t: ~entropy.is_false_positive(t["value"]))

    def measured(t: Column) -> Column:
        near = text.flattened(text.window(content, t["start"], t["end"]))
        return F.struct(t.alias("t"), near.alias("near"), entropy.shannon(t["value"]).alias("h"))

    def judged(p: Column) -> Column:
        boosted = text.has_any(F.lower(p["near"]), _literals(R.ENTROPY_KEYWORDS))
        least = entropy.threshold(entropy.charset(p["t"]["value"]), boosted)
        total = text.score(reputation, entropy=True, keyword=boosted, assignment=text.has_assignment(p["near"]))
        return F.struct(p["t"].alias("t"), p["near"].alias("near"), (entropy.margin(p["h"], least) > 0).alias("random"), total.alias("total"))

    def candidate(p: Column) -> Column:
        return F.struct(
            F.lit("entropy").alias("detector"),
            F.lit(None).cast("string").alias("rule_name"),
            F.lit(None).cast("int").alias("rule_idx"),
            F.lit("HIGH_ENTROPY_SECRET").alias("entity_type"),
            F.lit(R.HIGH).alias("category"),
            p["t"]["value"].alias("raw_value"),
            p["near"].alias("context"),
            p["total"].alias("confidence_score"),
            text.confidence(p["total"]).alias("confidence"),
            text.severity(F.lit(R.HIGH)).alias("severity"),
            F.lit(False).alias("requires_validation"),
            p["t"]["start"].alias("start"),
            p["t"]["end"].alias("end"),
        )

    unbuilt = F.filter(F.transform(suspicious, measured), lambda p: ~entropy.is_build_artifact(p["t"]["value"], p["near"]))
    worth = F.filter(F.transform(unbuilt, judged), lambda p: p["random"] & text.publishable(p["total"]))
    found = F.transform(worth, candidate).cast(_CANDIDATES)
    return overlap.keep_greedily(found, _CANDIDATES, lambda k, c: k["raw_value"] == c["raw_value"])


def run_counters(df: DataFrame, content: str = "text", path: str | None = None) -> DataFrame:
    """counter, n: how many matches of rules and how many tokens were looked at, and what came of them, in one pass.

    A token that was accepted in a text is not looked at again in it.
    """
    rows = _prepared(df, [], content, path)
    none = F.array().cast(_CANDIDATES)
    open_, source = ~paths.is_suppressed(F.col("_path")), ~paths.is_generated_source(F.col("_path"))
    rows = rows.withColumn("_spans", F.when(open_, rule_spans(F.col("_text"))))
    rows = rows.withColumn("_valid", F.when(open_, regex_candidates(F.col("_text"), F.col("_reputation"), found=F.col("_spans"))).otherwise(none))
    rows = rows.withColumn("_own", F.when(open_, path_findings(F.col("_path"), F.col("_reputation"))).otherwise(none))
    rows = rows.withColumn("_random", F.when(source, entropy_findings(F.col("_text"), F.col("_reputation"))).otherwise(none))
    # an accepted token is one of those of the lengths that matter, so its repetitions are, too
    again = F.filter(entropy.tokens(F.col("_text")), lambda t: F.exists("_random", lambda r: (r["raw_value"] == entropy.stripped_token(t["value"])) & (t["start"] > r["start"])))
    looked_at = F.when(source, entropy.token_count(F.col("_text"))) - F.when(F.size("_random") > 0, F.size(again)).otherwise(0)
    size = lambda found: F.coalesce(F.sum(F.greatest(F.size(F.coalesce(found, F.array())), F.lit(0))), F.lit(0)).cast("long")
    counters = {
        "regex_candidates_checked": size(F.transform("_spans", lambda s: s["rule_idx"])),
        "regex_validated": size(F.transform(F.filter("_valid", lambda c: c["requires_validation"]), lambda c: c["rule_idx"])),
        "entropy_candidates_checked": F.coalesce(F.sum(looked_at), F.lit(0)).cast("long"),
        "entropy_accepted": size(F.transform("_random", lambda c: c["start"])),
        "final_findings_published": size(F.transform(F.concat(settled(F.col("_valid")), "_own", "_random"), lambda c: F.lit(1))),
    }
    return as_rows(rows.agg(*(n.alias(name) for name, n in counters.items())))


def as_rows(counters: DataFrame) -> DataFrame:
    """One row of counters as rows (counter, n)."""
    return counters.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in counters.columns))).alias("c")).select("c.*")


def path_findings(path: Column, reputation: Column) -> Column:
    """At most one finding for what the path itself says."""
    total = text.score(reputation, regex=True)
    entity = paths.path_entity(path)
    one = F.struct(
        F.lit("path").alias("detector"),
        F.lit("credential_store_path").alias("rule_name"),
        F.lit(None).cast("int").alias("rule_idx"),
        entity.alias("entity_type"),
        F.lit("CREDENTIAL_STORE").alias("category"),
        path.alias("raw_value"),
        path.alias("context"),
        total.alias("confidence_score"),
        text.confidence(total).alias("confidence"),
        text.severity(F.lit("CREDENTIAL_STORE")).alias("severity"),
        F.lit(False).alias("requires_validation"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end"),
    )
    return F.when(entity.isNotNull() & text.publishable(total), F.array(one)).otherwise(F.array()).cast(_CANDIDATES)


def _exploded(df: DataFrame, keep: list[str], found: Column) -> DataFrame:
    rows = df.withColumn("_found", found).select(*keep, F.explode_outer("_found").alias("_c"))
    return rows.where("_c is not null").select(*keep, "_c.*")


def _prepared(df: DataFrame, keep: list[str], content: str, path: str | None) -> DataFrame:
    where = F.col(path) if path else F.lit(None).cast("string")
    return df.select(*keep, F.col(content).alias("_text"), F.coalesce(where, F.lit("")).alias("_path")).withColumn("_reputation", paths.reputation(F.col("_path")))


def detect_candidates(df: DataFrame, keep: list[str], content: str = "text", path: str | None = None, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """All validated and scored matches of the rules, whatever their score."""
    return _exploded(_prepared(df, keep, content, path), keep, regex_candidates(F.col("_text"), F.col("_reputation"), rules))


def detect_regex(df: DataFrame, keep: list[str], content: str = "text", path: str | None = None, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """Findings of the path rules and of ``rules`` over the text; none below suppressed paths."""
    rows = _prepared(df, keep, content, path).where(~paths.is_suppressed(F.col("_path")))
    found = F.concat(path_findings(F.col("_path"), F.col("_reputation")), F.coalesce(regex_findings(F.col("_text"), F.col("_reputation"), rules), F.array().cast(_CANDIDATES)))
    return _exploded(rows, keep, found)


def detect_entropy(df: DataFrame, keep: list[str], content: str = "text", path: str | None = None) -> DataFrame:
    """Findings of the entropy detector; none in build output."""
    rows = _prepared(df, keep, content, path).where(~paths.is_generated_source(F.col("_path")))
    return _exploded(rows, keep, entropy_findings(F.col("_text"), F.col("_reputation")))


def decode_variants(df: DataFrame, keep: list[str], content: str = "text") -> DataFrame:
    """One row (variant_no from 1, variant) per distinct decoded variant of a text."""
    rows = df.select(*keep, F.posexplode_outer(decoders.variants(F.col(content))).alias("variant_no", "variant"))
    return rows.where("variant is not null").withColumn("variant_no", F.col("variant_no") + 1)


def detect(df: DataFrame, keep: list[str], content: str = "text", path: str | None = None, mode: str = "compat", rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """Findings of all detectors over a text and its decoded variants.

    ``compat``: findings of rules are final for each variant (a path's own finding comes once for each), and only
    those of the entropy detector compete with each other over all variants.  ``strict``: each finding once, and
    in the text itself findings of both detectors compete.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"mode is {mode}")
    rows = _prepared(df, keep, content, path)
    rows = rows.withColumn("_texts", F.concat(F.array("_text"), decoders.variants(F.col("_text"))))
    rows = rows.withColumn("_open", ~paths.is_suppressed(F.col("_path"))).withColumn("_source", ~paths.is_generated_source(F.col("_path")))
    none = F.array().cast(_CANDIDATES)
    own = path_findings(F.col("_path"), F.col("_reputation"))
    by_rule = F.transform("_texts", lambda t: regex_findings(t, F.col("_reputation"), rules))
    random = F.transform("_texts", lambda t: entropy_findings(t, F.col("_reputation")))
    rows = rows.withColumn("_rule", F.when(F.col("_open"), by_rule)).withColumn("_random", F.when(F.col("_source"), random))
    if mode == "compat":
        stated = F.flatten(F.transform("_rule", lambda found: F.concat(own, found)))
        resolved = overlap.by_priority(F.flatten("_random"), _CANDIDATES)
        found = F.concat(F.coalesce(stated, none), F.coalesce(resolved, none))
    else:
        raw = F.concat(F.coalesce(F.element_at("_rule", 1), none), F.coalesce(F.element_at("_random", 1), none))
        rest = F.concat(F.coalesce(F.flatten(F.slice("_rule", 2, 1 << 20)), none), F.coalesce(F.flatten(F.slice("_random", 2, 1 << 20)), none))
        known = overlap.by_priority(raw, _CANDIDATES)
        same = lambda k, c: (k["raw_value"] == c["raw_value"]) & (k["entity_type"] == c["entity_type"])
        found = F.concat(F.when(F.col("_open"), own).otherwise(none), overlap.keep_greedily(F.concat(known, rest), _CANDIDATES, same))
    return _exploded(rows, keep, found)
