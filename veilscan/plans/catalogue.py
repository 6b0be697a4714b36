"""The queries of the library by name, and their SQL for another engine.

Each query reads its whole table.  ``_CATALOGUE`` holds, for each name, the query and its SQL (None where SQL cannot
express it); both sides name their columns alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.functions import decoders, entropy, paths, text, validators
from veilscan.operators import correlation, detect, findings
from veilscan.operators.layout import spread
from veilscan.plans import fixtures, jobs
from veilscan.plans import sql as S

Query = Callable[[SparkSession, str], DataFrame]
_CATALOGUE: dict[str, tuple[Query, str | None]] = {}

_RESULT = ("doc_id", "detector", "rule_name", "entity_type", "category", "raw_value", "context", "confidence_score", "requires_validation", "start", "stop")
_RESULT_SQL = ", ".join(_RESULT)


def _add(name: str, query: Query, statement: str | None = None) -> None:
    _CATALOGUE[name] = query, statement


def _docs_query(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fixtures.documents(spark, sf_dir))


def _result(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("end", "stop").select(*_RESULT)


# --- candidates of each rule -------------------------------------------------------------------------------------


def _rule_query(idx: int) -> Query:
    def build(docs: DataFrame) -> DataFrame:
        rule = R.RULES[idx]
        rows = docs.select("doc_id", F.explode_outer(text.spans(F.col("text"), rule.pattern, rule.guard)).alias("s")).where("s is not null")
        return rows.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.value").alias("value"))

    return _docs_query(build)


for _i, _rule in enumerate(R.RULES):
    _add(f"rule_{_rule.name}_candidates", _rule_query(_i), f"WITH {S.DOCS}, {S.spans('docs', [(_i, _rule.pattern)])} SELECT doc_id, start, stop, value FROM spans")


# --- validators --------------------------------------------------------------------------------------------------


def _validator_query(name: str) -> Query:
    rule = next(r for r in R.RULES if r.validator == name)

    def build(docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", F.explode_outer(text.spans(F.col("text"), rule.pattern, rule.guard)).alias("s")).where("s is not null")
        return rows.select("doc_id", F.col("s.start").alias("start"), F.col("s.value").alias("value"), validators.by_name(name, F.col("s.value")).alias("valid"))

    return _docs_query(build)


for _name in ("luhn", "verhoeff", "pan", "upi", "jwt", "aws", "google", "github", "openai", "stripe", "ssh"):
    _i, _rule = next((i, r) for i, r in enumerate(R.RULES) if r.validator == _name)
    _test = S.VALIDATORS[_name]("value") if _name in S.VALIDATORS else f"regexp_full_match(value, {S.string(R.SHAPES[_name])})"
    _add(f"validate_{_name}", _validator_query(_name), f"WITH {S.DOCS}, {S.spans('docs', [(_i, _rule.pattern)])} SELECT doc_id, start, value, {_test} AS valid FROM spans")

# check digits of every order and customer number, for digit runs that no document holds
_add(
    "validate_check_digits_orders",
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", validators.luhn(F.lpad(F.col("o_orderkey").cast("string"), 16, "4")).alias("luhn"), validators.verhoeff(F.lpad(F.col("o_orderkey").cast("string"), 12, "7")).alias("verhoeff")),
    f"SELECT o_orderkey, {S.luhn('lpad(CAST(o_orderkey AS VARCHAR), 16, chr(52))')} AS luhn, {S.verhoeff('lpad(CAST(o_orderkey AS VARCHAR), 12, chr(55))')} AS verhoeff FROM orders",
)


# --- scalar steps ------------------------------------------------------------------------------------------------

_add(
    "mask_values",
    lambda spark, d: spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.mask(F.col("c_name")).alias("masked_name"), text.mask(F.col("c_mktsegment").substr(F.lit(1), (F.col("c_custkey") % 8).cast("int"))).alias("masked_part")),
    f"SELECT c_custkey, {S.mask('c_name')} AS masked_name, {S.mask('substr(c_mktsegment, 1, CAST(c_custkey % 8 AS INTEGER))')} AS masked_part FROM customer",
)
_CATEGORIES = ("HIGH_SENSITIVE", "MEDIUM_SENSITIVE", "CREDENTIAL_STORE", "HIGH_ENTROPY_SECRET", "OTHER")
_add(
    "severity_map",
    _docs_query(lambda docs: docs.select("doc_id", text.severity(fixtures.pick(_CATEGORIES, F.col("doc_id"))).alias("severity"))),
    f"WITH {S.DOCS} SELECT doc_id, {S.severity(S.picked(_CATEGORIES, 'doc_id'))} AS severity FROM docs",
)


def _email_windows(docs: DataFrame) -> DataFrame:
    rule = next(r for r in R.RULES if r.name == "email_address")
    rows = docs.select("doc_id", "text", F.explode_outer(text.spans(F.col("text"), rule.pattern, rule.guard)).alias("s")).where("s is not null")
    return rows.select("doc_id", F.col("s.start").alias("start"), text.window(F.col("text"), F.col("s.start"), F.col("s.end")).alias("near"))


_EMAIL = next(i for i, r in enumerate(R.RULES) if r.name == "email_address")
_WINDOWS = f"WITH {S.DOCS}, {S.spans('docs', [(_EMAIL, R.RULES[_EMAIL].pattern)])}, windows AS (SELECT doc_id, start, {S.window('t', 'start', 'stop')} AS near FROM spans)"
_add("context_window", _docs_query(lambda docs: _email_windows(docs).select("doc_id", "start", text.flattened(F.col("near")).alias("context"))), f"{_WINDOWS} SELECT doc_id, start, {S.flattened('near')} AS context FROM windows")
_add("assignment_hits", _docs_query(lambda docs: docs.select("doc_id", text.has_assignment(F.col("text")).alias("assigned"))), f"WITH {S.DOCS} SELECT doc_id, regexp_matches({S.folded('text')}, {S.string(R.ASSIGNMENT)}) AS assigned FROM docs")
_add(
    "keyword_hits",
    _docs_query(lambda docs: _email_windows(docs).select("doc_id", "start", text.has_any(F.lower("near"), F.array(*map(F.lit, R.RULES[_EMAIL].keywords))).alias("hit"))),
    f"{_WINDOWS} SELECT doc_id, start, {S.has_any('lower(near)', S.listed(R.RULES[_EMAIL].keywords))} AS hit FROM windows",
)
_add("file_reputation", _docs_query(lambda docs: docs.select("doc_id", "path", paths.reputation(F.col("path")).alias("reputation"))), f"WITH {S.DOCS} SELECT doc_id, path, CAST({S.reputation('path')} AS INTEGER) AS reputation FROM docs")
_add("score_regex", _docs_query(lambda docs: _result(detect.detect_candidates(docs, ["doc_id"], path="path"))), f"WITH {S.DOCS}, {S.candidates()} SELECT {_RESULT_SQL} FROM candidates")
_add(
    "publish_threshold",
    _docs_query(lambda docs: _result(detect.detect_candidates(docs, ["doc_id"], path="path").where(text.publishable(F.col("confidence_score"))))),
    f"WITH {S.DOCS}, {S.candidates()} SELECT {_RESULT_SQL} FROM candidates WHERE confidence_score >= {R.PUBLISH_SCORE}",
)
_add(
    "confidence_values",
    _docs_query(lambda docs: detect.detect_candidates(docs, ["doc_id"], path="path").groupBy("confidence_score").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))),
    f"WITH {S.DOCS}, {S.candidates()} SELECT confidence_score, count(*) AS n, max(least(100, greatest(0, confidence_score)) / 100.0::DOUBLE) AS confidence FROM candidates GROUP BY 1",
)
_add(
    "printable_ratio",
    _docs_query(lambda docs: docs.select("doc_id", F.round(decoders.printable_share(F.col("text")), 9).alias("share"), decoders.is_printable(F.col("text")).alias("printable"))),
    f"WITH {S.DOCS}, shown AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\P{{C}}\\n\\r\\t]|[^\\P{{Z}} ]', '', 'g')) AS k FROM docs) SELECT doc_id, round(k / CAST(n AS DOUBLE), 9) AS share, k / CAST(n AS DOUBLE) > {R.PRINTABLE_SHARE} AS printable FROM shown",
)

# --- paths and files ---------------------------------------------------------------------------------------------

_FILES_SQL = (
    f"files AS (SELECT doc_id, replace({S.picked(fixtures.NAMES, 'doc_id')}, '{{}}', CAST(doc_id % 50 AS VARCHAR)) AS path, n_chars AS length, {S.picked(fixtures.HEADS, 'doc_id')} AS head, "
    "CASE WHEN doc_id % 46 = 22 THEN ['findings', 'honeycomb_alerts', 'x'] WHEN doc_id % 23 = 22 THEN ['x'] ELSE [] END AS tables FROM documents)"
)
_OWN = f"({S.extension(S.basename('path'))} IN ('.db', '.sqlite', '.sqlite3') AND list_has_all(tables, {S.listed(R.OWN_TABLES)}))"
_SUFFIX = f"(CASE WHEN {S.extension(S.basename('path'))} = '' AND starts_with({S.basename('path')}, '.') THEN {S.basename('path')} ELSE {S.extension(S.basename('path'))} END)"
_DECISION = (
    f"(CASE WHEN {S.is_excluded('path')} OR ends_with({S.basename('path')}, '.log') OR ends_with({S.basename('path')}, '.evtx') OR {_OWN} THEN 'excluded' "
    f"WHEN {S.within(_SUFFIX, R.SCANNED_EXTENSIONS)} OR {S.basename('path')} = 'config' THEN 'scan' ELSE 'unsupported_extension' END)"
)


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return findings.decisions(fixtures.files(spark, d), "path", "table_names")


_add("path_policy_decision", lambda spark, d: _decided(spark, d).select("doc_id", "path", "decision"), f"WITH {_FILES_SQL} SELECT doc_id, path, {_DECISION} AS decision FROM files")
_add("policy_stats", lambda spark, d: findings.scan_statistics(_decided(spark, d)), f"WITH {_FILES_SQL} SELECT {_DECISION} AS decision, count(*) AS n FROM files GROUP BY 1")
_add("path_exclusion", lambda spark, d: fixtures.files(spark, d).select("doc_id", paths.is_excluded(F.col("path")).alias("excluded")), f"WITH {_FILES_SQL} SELECT doc_id, {S.is_excluded('path')} AS excluded FROM files")
_add(
    "size_limit",
    lambda spark, d: fixtures.files(spark, d).select("doc_id", (F.col("length") * 10_000).alias("length")).where(findings.within_size(F.col("length"))),
    f"WITH {_FILES_SQL} SELECT doc_id, length * 10000 AS length FROM files WHERE length * 10000 <= {R.MAX_FILE_BYTES}",
)
_add("own_database", lambda spark, d: fixtures.files(spark, d).select("doc_id", paths.is_own_database(F.col("path"), F.col("table_names")).alias("own")), f"WITH {_FILES_SQL} SELECT doc_id, {_OWN} AS own FROM files")
_MAGIC_SQL = " ".join(
    f"WHEN starts_with(left(head, 16), '{magic.hex().upper()}') THEN "
    + (f"CASE WHEN {S.within(S.extension(S.basename('path')), R.OFFICE_EXTENSIONS)} THEN 'office_parser' ELSE 'archive_parser' END" if parser == "zip" else f"'{parser}'")
    for magic, parser in R.MAGICS
)
_CONTROL_SQL = "len(list_filter(regexp_extract_all(head, '..'), lambda h: h < '20' AND h NOT IN ('09', '0A', '0D')))"
_add(
    "triage_magic",
    lambda spark, d: fixtures.files(spark, d).select("doc_id", paths.triage(F.col("path"), F.col("head")).alias("parser")),
    f"WITH {_FILES_SQL} SELECT doc_id, CASE {_MAGIC_SQL} WHEN length(head) = 0 OR {_CONTROL_SQL} / (length(head) / 2.0) < {R.CONTROL_SHARE} THEN 'text_parser' ELSE 'SKIP' END AS parser FROM files",
)
_PARSER_SQL = f"CASE {_MAGIC_SQL} WHEN length(head) = 0 OR {_CONTROL_SQL} / (length(head) / 2.0) < {R.CONTROL_SHARE} THEN 'text_parser' ELSE 'SKIP' END"
_add(
    "scan_outcomes",
    lambda spark, d: jobs.outcomes(fixtures.files(spark, d), spark.createDataFrame([("/home/u/.env",), ("/srv/app/config",)], "path string")).groupBy("outcome").agg(F.count("*").alias("n")),
    f"WITH {_FILES_SQL}, judged AS (SELECT *, {_DECISION} AS decision, {_PARSER_SQL} AS parser FROM files) SELECT CASE WHEN path IN ('/home/u/.env', '/srv/app/config') THEN 'honeytoken' WHEN decision <> 'scan' THEN decision WHEN length IS NULL THEN 'unreadable' WHEN length > {R.MAX_FILE_BYTES} THEN 'too_large' WHEN parser NOT IN ('text_parser', 'sqlite_parser') THEN 'no_parser' ELSE 'scanned' END AS outcome, count(*) AS n FROM judged GROUP BY 1",
)
_PATHS_ONLY = f"WITH {S.DOCS}"
_add(
    "path_rule_findings",
    _docs_query(lambda docs: detect._exploded(detect._prepared(docs, ["doc_id"], "text", "path").where(~paths.is_suppressed(F.col("_path"))), ["doc_id"], detect.path_findings(F.col("_path"), F.col("_reputation"))).select("doc_id", "entity_type", "raw_value", "confidence_score", "severity")),
    f"{_PATHS_ONLY} SELECT doc_id, {S.path_entity('path')} AS entity_type, path AS raw_value, CAST({S.reputation('path')} + {R.REGEX_SCORE} AS INTEGER) AS confidence_score, 'CRITICAL' AS severity FROM docs WHERE NOT {S.is_suppressed('path')} AND {S.path_entity('path')} IS NOT NULL AND {S.reputation('path')} + {R.REGEX_SCORE} >= {R.PUBLISH_SCORE}",
)
_add("path_suppression", _docs_query(lambda docs: docs.select("doc_id", paths.is_suppressed(F.col("path")).alias("suppressed"), paths.is_generated_source(F.col("path")).alias("generated"))), f"{_PATHS_ONLY} SELECT doc_id, {S.is_suppressed('path')} AS suppressed, {S.is_generated('path')} AS generated FROM docs")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select(F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/+$", "")).alias("path")).unionAll(pages.select(F.concat(F.lit("/"), F.regexp_extract("url", "://([^/?#]*)", 1)).alias("path")))


_add(
    "nested_roots",
    lambda spark, d: findings.outermost_roots(_roots(spark, d)),
    "WITH roots AS (SELECT '/' || regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+$', '') AS root FROM pages UNION SELECT '/' || regexp_extract(url, '://([^/?#]*)', 1) FROM pages) SELECT root FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE o.root <> r.root AND starts_with(r.root, o.root || '/'))",
)

# --- entropy -----------------------------------------------------------------------------------------------------


def _tokens(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.explode_outer(entropy.tokens(F.col("text"))).alias("t")).where("t is not null")
    return rows.select("doc_id", F.col("t.start").alias("start"), F.col("t.end").alias("stop"), entropy.stripped_token(F.col("t.value")).alias("clean"))


def _token_query(**columns: Callable[[Column], Column]) -> Query:
    return _docs_query(lambda docs: _tokens(docs).select("doc_id", "start", *(make(F.col("clean")).alias(name) for name, make in columns.items())))


_TOKENS = f"WITH {S.DOCS}, {S.token_spans('docs')}"
_add("tokenize", _docs_query(_tokens), f"{_TOKENS} SELECT doc_id, start, stop, clean FROM tokens")
_add("shannon_entropy", _token_query(h=lambda c: F.round(entropy.shannon(c), 9)), f"{_TOKENS} SELECT doc_id, start, round({S.shannon('clean')}, 9) AS h FROM tokens")
_add("charset_class", _token_query(charset=entropy.charset), f"{_TOKENS} SELECT doc_id, start, {S.charset('clean')} AS charset FROM tokens")
_add("char_class_count", _token_query(classes=entropy.class_count), f"{_TOKENS} SELECT doc_id, start, {S.class_count('clean')} AS classes FROM tokens")
_add("entropy_false_positive", _token_query(rejected=entropy.is_false_positive), f"{_TOKENS} SELECT doc_id, start, {S.is_false_positive('clean')} AS rejected FROM tokens")


def _artifacts(docs: DataFrame) -> DataFrame:
    rows = _tokens(docs).join(docs.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "start", entropy.is_build_artifact(F.col("clean"), text.flattened(text.window(F.col("text"), F.col("start"), F.col("stop")))).alias("artifact"))


_add(
    "build_artifact_filter",
    _docs_query(_artifacts),
    f"{_TOKENS}, near AS (SELECT t.doc_id, t.start, t.clean, {S.flattened(S.window('d.text', 't.start', 't.stop'))} AS near FROM tokens t JOIN docs d USING (doc_id)) SELECT doc_id, start, {S.is_build_artifact('clean', 'near')} AS artifact FROM near",
)
_add("entropy_findings", _docs_query(lambda docs: _result(detect.detect_entropy(docs, ["doc_id"], path="path"))), f"WITH {S.DOCS}, {S.entropy_findings()} SELECT {_RESULT_SQL} FROM random")

# --- decoders ----------------------------------------------------------------------------------------------------


def _variant_query(make: Callable[[Column], Column]) -> Query:
    return _docs_query(lambda docs: docs.select("doc_id", F.explode_outer(make(F.col("text"))).alias("variant")).where("variant is not null"))


_READABLE = f"length(variant) > 0 AND length(regexp_replace(variant, '[^\\P{{C}}\\n\\r\\t]|[^\\P{{Z}} ]', '', 'g')) / CAST(length(variant) AS DOUBLE) > {R.PRINTABLE_SHARE}"
_BASE64_SQL = (
    f"base64_runs AS (SELECT doc_id, rtrim(unnest(regexp_extract_all(text, '{R.BASE64_RUN}')), '=') AS run FROM docs), "
    "base64_variants AS (SELECT doc_id, try(decode(from_base64(rpad(run, CAST(ceil(length(run) / 4.0) * 4 AS INTEGER), '=')))) AS variant FROM base64_runs WHERE length(run) % 4 <> 1)"
)
_HEX_SQL = f"hex_runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{R.HEX_RUN}')) AS run FROM docs), hex_variants AS (SELECT doc_id, try(decode(unhex(run))) AS variant FROM hex_runs)"
_URL_SQL = "url_variants AS (SELECT doc_id, url_decode(text) AS variant FROM docs WHERE contains(text, '%') AND url_decode(text) <> text)"
_ROT_SQL = (
    "rot13_variants AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS variant "
    f"FROM docs WHERE regexp_matches({S.folded('text')}, {S.string(R.ROT13_HINT)}))"
)
_ALL_SQL = (
    f"{_BASE64_SQL}, {_HEX_SQL}, {_URL_SQL}, {_ROT_SQL}, variants AS (SELECT DISTINCT doc_id, variant FROM (SELECT * FROM base64_variants WHERE {_READABLE} UNION ALL SELECT * FROM hex_variants WHERE {_READABLE} "
    "UNION ALL SELECT * FROM url_variants UNION ALL SELECT * FROM rot13_variants))"
)
_add("decode_base64", _variant_query(decoders.base64_variants), f"WITH {S.DOCS}, {_BASE64_SQL} SELECT doc_id, variant FROM base64_variants WHERE {_READABLE}")
_add("decode_hex", _variant_query(decoders.hex_variants), f"WITH {S.DOCS}, {_HEX_SQL} SELECT doc_id, variant FROM hex_variants WHERE {_READABLE}")
_add("decode_url", _variant_query(decoders.url_variants), f"WITH {S.DOCS}, {_URL_SQL} SELECT doc_id, variant FROM url_variants")
_add("decode_rot13", _variant_query(decoders.rot13_variants), f"WITH {S.DOCS}, {_ROT_SQL} SELECT doc_id, variant FROM rot13_variants")
_add("decode_all_distinct", _docs_query(lambda docs: detect.decode_variants(docs, ["doc_id"]).select("doc_id", "variant")), f"WITH {S.DOCS}, {_ALL_SQL} SELECT doc_id, variant FROM variants")

# --- findings ----------------------------------------------------------------------------------------------------

_PUBLISHED = f"published AS (SELECT * FROM candidates WHERE confidence_score >= {R.PUBLISH_SCORE})"
_OPEN_PUBLISHED = f"published AS (SELECT * FROM candidates WHERE confidence_score >= {R.PUBLISH_SCORE} AND NOT {S.is_suppressed('path')})"
_PATH_FINDINGS = (
    f"SELECT doc_id, 'path' AS detector, 'credential_store_path' AS rule_name, {S.path_entity('path')} AS entity_type, 'CREDENTIAL_STORE' AS category, path AS raw_value, path AS context, CAST({S.reputation('path')} + {R.REGEX_SCORE} AS INTEGER) AS confidence_score, "
    f"false AS requires_validation, CAST(NULL AS INTEGER) AS start, CAST(NULL AS INTEGER) AS stop FROM docs WHERE NOT {S.is_suppressed('path')} AND {S.path_entity('path')} IS NOT NULL AND {S.reputation('path')} + {R.REGEX_SCORE} >= {R.PUBLISH_SCORE}"
)
_REGEX_SQL = f"{S.candidates()}, {_OPEN_PUBLISHED}, {S.greedy('published', 'kept')}"


def _overlap(docs: DataFrame) -> DataFrame:
    rows = detect._prepared(docs, ["doc_id"], "text", "path")
    return _result(detect._exploded(rows, ["doc_id"], detect.regex_findings(F.col("_text"), F.col("_reputation"))))


_add("overlap_suppression", _docs_query(_overlap), f"WITH {S.DOCS}, {S.candidates()}, {_PUBLISHED}, {S.greedy('published', 'kept')} SELECT {_RESULT_SQL} FROM kept")
_add(
    "regex_findings_documents",
    _docs_query(lambda docs: _result(detect.detect_regex(docs, ["doc_id"], path="path"))),
    f"WITH {S.DOCS}, {_REGEX_SQL} SELECT {_RESULT_SQL} FROM kept UNION ALL SELECT {_RESULT_SQL} FROM ({_PATH_FINDINGS})",
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("/srv/config.json").alias("path"))


_PAGES_SQL = "docs AS (SELECT page_id AS doc_id, html AS text, '/srv/config.json' AS path FROM pages)"
_add("regex_findings_pages", lambda spark, d: _result(detect.detect_regex(_pages(spark, d), ["doc_id"], path="path")), f"WITH {_PAGES_SQL}, {_REGEX_SQL} SELECT {_RESULT_SQL} FROM kept UNION ALL SELECT {_RESULT_SQL} FROM ({_PATH_FINDINGS})")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.lit("/srv/config.json").alias("path"))


_TALKS_SQL = "docs AS (SELECT conv_id * 1000 + turn AS doc_id, text, '/srv/config.json' AS path FROM conversations)"
_add("regex_findings_conversations", lambda spark, d: _result(detect.detect_regex(_conversations(spark, d), ["doc_id"], path="path")), f"WITH {_TALKS_SQL}, {_REGEX_SQL} SELECT {_RESULT_SQL} FROM kept")


def _union(docs: DataFrame) -> DataFrame:
    both = detect.detect_regex(docs, ["doc_id"], path="path").unionByName(detect.detect_entropy(docs, ["doc_id"], path="path"))
    return _result(both)


_add("union_detectors", _docs_query(_union), f"WITH {S.DOCS}, {_REGEX_SQL}, {S.entropy_findings()} SELECT {_RESULT_SQL} FROM kept UNION ALL SELECT {_RESULT_SQL} FROM ({_PATH_FINDINGS}) UNION ALL SELECT {_RESULT_SQL} FROM random")


def _cross(docs: DataFrame) -> DataFrame:
    """Findings of both detectors over the text itself, competing with each other."""
    from veilscan.functions import overlap

    rows = detect._prepared(docs, ["doc_id"], "text", "path")
    rows = rows.withColumn("_rule", detect.regex_findings(F.col("_text"), F.col("_reputation"))).withColumn("_random", F.when(~paths.is_generated_source(F.col("_path")), detect.entropy_findings(F.col("_text"), F.col("_reputation"))))
    found = overlap.by_priority(F.concat("_rule", F.coalesce("_random", F.array().cast(detect._CANDIDATES))), detect._CANDIDATES)
    return _result(detect._exploded(rows, ["doc_id"], found))


_add(
    "cross_engine_overlap",
    _docs_query(_cross),
    f"WITH {S.DOCS}, {S.candidates()}, {_PUBLISHED}, {S.greedy('published', 'kept')}, {S.entropy_findings()}, both_engines AS (SELECT {_RESULT_SQL}, rule_idx FROM kept UNION ALL SELECT {_RESULT_SQL}, rule_idx FROM random), {S.greedy('both_engines', 'resolved')} SELECT {_RESULT_SQL} FROM resolved",
)

# all detectors over the text and its variants, as stored; the variants have their own key in SQL
_VARIANT_DOCS = f"{S.DOCS.replace('docs AS', 'raw AS', 1)}, {_ALL_SQL.replace('FROM docs', 'FROM raw')}, docs AS (SELECT doc_id * 100 AS doc_id, text, path FROM raw UNION ALL SELECT v.doc_id * 100 + row_number() OVER (PARTITION BY v.doc_id ORDER BY v.variant), v.variant, r.path FROM variants v JOIN raw r USING (doc_id))"


def _stored(docs: DataFrame, mode: str) -> DataFrame:
    found = detect.detect(docs, ["doc_id"], path="path", mode=mode)
    return found.select("doc_id", "detector", "entity_type", text.severity(F.col("category")).alias("severity"), text.mask(F.col("raw_value")).alias("masked_value"), "context", "confidence", F.col("requires_validation").alias("validated"))


_ALL_FOUND = f"SELECT {_RESULT_SQL} FROM kept UNION ALL SELECT {_RESULT_SQL} FROM ({_PATH_FINDINGS}) UNION ALL SELECT {_RESULT_SQL} FROM settled"
_add(
    "findings_full",
    _docs_query(lambda docs: _stored(docs, "compat")),
    f"WITH {_VARIANT_DOCS}, {_REGEX_SQL}, {S.entropy_findings()}, random_of_doc AS (SELECT * REPLACE (doc_id // 100 AS doc_id), doc_id % 100 AS variant FROM random), "
    + S.greedy("random_of_doc", "settled_rows").replace("coalesce(rule_idx, -1), start", "coalesce(rule_idx, -1), start, variant")
    + f", settled AS (SELECT * REPLACE (doc_id * 100 AS doc_id) FROM settled_rows), found AS ({_ALL_FOUND}) SELECT doc_id // 100 AS doc_id, detector, entity_type, {S.severity('category')} AS severity, {S.mask('raw_value')} AS masked_value, context, least(100, greatest(0, confidence_score)) / 100.0::DOUBLE AS confidence, requires_validation AS validated FROM found",
)
_add("findings_strict", _docs_query(lambda docs: _stored(docs, "strict")))
_add(
    "findings_by_entity",
    _docs_query(lambda docs: detect.count_by_entity(docs, path="path")),
    f"WITH {S.DOCS}, {S.candidates()}, {_PUBLISHED}, {S.greedy('published', 'kept')}, checked AS (SELECT {S.attribute([r.entity for r in R.RULES], 'rule_idx')} AS entity_type, count(*) AS checked FROM spans GROUP BY 1) "
    "SELECT c.entity_type, c.checked, coalesce(v.n, 0) AS validated, coalesce(p.n, 0) AS published FROM checked c LEFT JOIN (SELECT entity_type, count(*) AS n FROM candidates GROUP BY 1) v USING (entity_type) LEFT JOIN (SELECT entity_type, count(*) AS n FROM kept GROUP BY 1) p USING (entity_type)",
)


def _counters(docs: DataFrame) -> DataFrame:
    return _union(docs).agg(*findings.metrics(docs))


_add(
    "metric_counters",
    _docs_query(_counters),
    f"WITH {S.DOCS}, {_REGEX_SQL}, {S.entropy_findings()}, found AS (SELECT {_RESULT_SQL} FROM kept UNION ALL SELECT {_RESULT_SQL} FROM ({_PATH_FINDINGS}) UNION ALL SELECT {_RESULT_SQL} FROM random) SELECT count(*) AS candidates, count_if(detector = 'regex') AS regex, count_if(detector = 'entropy') AS entropy, count_if(requires_validation) AS regex_validated FROM found",
)

# --- honeytokens -------------------------------------------------------------------------------------------------

_TOKENS_SQL = "tokens AS (SELECT '/home/u/token' || k || '.txt' AS path, 't' || k AS token_id, CASE WHEN k % 2 = 0 THEN 'ENV_FILE' ELSE 'GENERIC_API_KEY' END AS token_type FROM range(40) r(k))"
_EVENTS_SQL = (
    f"file_events AS (SELECT event_id, ts AS event_time, {S.picked(('modified', 'deleted', 'moved', 'opened'), 'event_id')} AS kind, '/home/u/token' || (event_id % 97) || '.txt' AS src_path, "
    "CASE WHEN event_id % 4 = 2 THEN '/home/u/token' || (event_id % 61) || '.txt' END AS dest_path, event_id % 50 = 0 AS is_directory FROM events)"
)
_TOUCHED_SQL = (
    "touched AS (SELECT event_id, event_time, src_path AS path, kind AS event_type FROM file_events WHERE NOT is_directory UNION ALL SELECT event_id, event_time, dest_path, 'moved_to' FROM file_events WHERE NOT is_directory AND kind = 'moved' AND dest_path IS NOT NULL)"
)
_INCIDENT_SQL = "(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.INCIDENTS.items()) + " END)"
_TRIPPED_SQL = f"{_TOKENS_SQL}, {_EVENTS_SQL}, {_TOUCHED_SQL}, tripped AS (SELECT event_id, event_time, path, event_type, token_id, token_type, {_INCIDENT_SQL} AS incident_type FROM touched JOIN tokens USING (path))"
_SYSMON_SQL = (
    "sysmon AS (SELECT ts + to_seconds(CAST(event_id % 13 - 6 AS INTEGER)) AS system_time, event_id, CASE WHEN event_id % 3 = 0 THEN '/home/u/token' || (event_id % 97) || '.txt' ELSE 'c:\\temp\\x' END AS target_filename, "
    "CASE WHEN event_id % 3 = 1 THEN 'cat /home/u/token' || (event_id % 97) || '.txt' ELSE 'C:\\home\\u\\token' || (event_id % 97) || '.txt' END AS command_line, '/usr/bin/tool' || (event_id % 7) AS image, CAST(event_id + 1000 AS INTEGER) AS process_id, 'user' || user_id AS username FROM events)"
)


def _tripped(spark: SparkSession, d: str) -> DataFrame:
    return correlation.token_events(fixtures.file_events(spark, d), fixtures.tokens(spark))


def _alert_rows(spark: SparkSession, d: str) -> DataFrame:
    return _tripped(spark, d).withColumn("alert_id", F.concat_ws("/", F.col("event_id").cast("string"), "event_type"))


def _near_log(spark: SparkSession, d: str) -> DataFrame:
    return correlation.nearest_in_time(_alert_rows(spark, d), fixtures.sysmon(spark, d))


_ATTRIBUTES = ("alert_id", "path", "process_name", "process_id", "username", "process_path", "attribution_source")
_NEAR_SQL = (
    f"{_TRIPPED_SQL}, {_SYSMON_SQL}, alerts AS (SELECT *, event_id || '/' || event_type AS alert_id FROM tripped), "
    "pairs AS (SELECT a.alert_id, s.*, contains(lower(replace(s.target_filename, '\\', '/')), lower(a.path)) AS is_target FROM alerts a JOIN sysmon s ON s.system_time BETWEEN a.event_time - INTERVAL 5 SECONDS AND a.event_time + INTERVAL 5 SECONDS "
    "AND (contains(lower(replace(s.target_filename, '\\', '/')), lower(a.path)) OR contains(lower(replace(s.command_line, '\\', '/')), lower(a.path)))), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY is_target DESC, CASE WHEN is_target THEN -epoch_us(system_time) ELSE epoch_us(system_time) END, process_id) AS k FROM pairs), "
    "attributed AS (SELECT a.alert_id, a.path, coalesce(regexp_extract(r.image, '([^/]*)$', 1), 'UNKNOWN') AS process_name, r.process_id, coalesce(r.username, 'UNKNOWN') AS username, coalesce(r.image, 'UNKNOWN') AS process_path, CASE WHEN r.alert_id IS NULL THEN 'UNKNOWN' ELSE 'SYSMON' END AS attribution_source FROM alerts a LEFT JOIN ranked r ON r.alert_id = a.alert_id AND r.k = 1)"
)
_PROCESSES_SQL = "opened AS (SELECT 10 + k AS pid, 'p' || k AS name, '/usr/bin/p' || k AS exe, 'u' || (k % 3) AS username, unnest(['/home/u/token' || k || '.txt', '/home/u/token' || ((k * 7) % 40) || '.txt']) AS path FROM range(30) r(k)), first_open AS (SELECT path, min(pid) AS pid FROM opened GROUP BY 1)"
_FALLBACK_SQL = (
    "SELECT a.alert_id, a.path, CASE WHEN o.pid IS NULL THEN a.process_name ELSE o.name END AS process_name, CASE WHEN o.pid IS NULL THEN a.process_id ELSE CAST(o.pid AS INTEGER) END AS process_id, CASE WHEN o.pid IS NULL THEN a.username ELSE o.username END AS username, "
    "CASE WHEN o.pid IS NULL THEN a.process_path ELSE o.exe END AS process_path, CASE WHEN o.pid IS NULL THEN a.attribution_source ELSE 'FALLBACK' END AS attribution_source FROM attributed a LEFT JOIN first_open f ON a.attribution_source = 'UNKNOWN' AND f.path = a.path LEFT JOIN (SELECT DISTINCT * FROM opened) o ON o.path = f.path AND o.pid = f.pid"
)
_add(
    "honeytoken_anti_join",
    lambda spark, d: findings.drop_known(correlation.unfolded(fixtures.file_events(spark, d)).select("path").distinct(), fixtures.tokens(spark)),
    f"WITH {_TOKENS_SQL}, {_EVENTS_SQL}, {_TOUCHED_SQL} SELECT DISTINCT path FROM touched WHERE path NOT IN (SELECT path FROM tokens)",
)
_add("event_token_join", _tripped, f"WITH {_TRIPPED_SQL} SELECT * FROM tripped")
_add("move_explode", lambda spark, d: correlation.unfolded(fixtures.file_events(spark, d)), f"WITH {_EVENTS_SQL}, {_TOUCHED_SQL} SELECT event_id, event_time, path, event_type FROM touched")
_add("sysmon_interval_join", lambda spark, d: _near_log(spark, d).select(*_ATTRIBUTES), f"WITH {_NEAR_SQL} SELECT {', '.join(_ATTRIBUTES)} FROM attributed")
_add(
    "process_fallback",
    lambda spark, d: correlation.fall_back(_near_log(spark, d), fixtures.processes(spark)).select(*_ATTRIBUTES),
    f"WITH {_NEAR_SQL}, {_PROCESSES_SQL} {_FALLBACK_SQL}",
)
_add(
    "latest_n_events",
    lambda spark, d: correlation.newest(fixtures.sysmon(spark, d)).select("event_id", "system_time"),
    f"WITH {_SYSMON_SQL} SELECT CAST(event_id AS INTEGER) AS event_id, system_time FROM sysmon ORDER BY system_time DESC, event_id DESC LIMIT {R.SYSMON_LOOKBACK}",
)
_add(
    "incidents_by_window",
    lambda spark, d: correlation.incidents_by_window(_tripped(spark, d), "1 hour", "event_time"),
    f"WITH {_TRIPPED_SQL} SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS window_start, time_bucket(INTERVAL 1 HOUR, event_time) + INTERVAL 1 HOUR AS window_end, incident_type, count(*) AS n FROM tripped GROUP BY ALL",
)


def _run_counters(spark: SparkSession, d: str) -> DataFrame:
    judged = jobs.outcomes(fixtures.files(spark, d), spark.createDataFrame([("/home/u/.env",), ("/srv/app/config",)], "path string"))
    return jobs.file_counters(judged).unionAll(detect.run_counters(fixtures.documents(spark, d), path="path"))


_OUTCOME_SQL = (
    "(CASE WHEN path IN ('/home/u/.env', '/srv/app/config') THEN 'files_excluded' WHEN decision = 'excluded' THEN 'files_excluded' WHEN decision <> 'scan' OR length IS NULL OR length > "
    f"{R.MAX_FILE_BYTES} OR parser NOT IN ('text_parser', 'sqlite_parser') THEN 'files_skipped' ELSE 'files_scanned' END)"
)
_CLEAN_SQL = f"trim(p.value, {S.string(R.TOKEN_STRIPPED)})"
_add(
    "run_counters",
    _run_counters,
    f"WITH {S.DOCS}, {_REGEX_SQL}, {S.entropy_findings()}, {_FILES_SQL}, judged AS (SELECT *, {_DECISION} AS decision, {_PARSER_SQL} AS parser FROM files), outcomes AS (SELECT {_OUTCOME_SQL} AS counter FROM judged) "
    "SELECT counter, (SELECT count(*) FROM outcomes o WHERE o.counter = c.counter) AS n FROM (VALUES ('files_scanned'), ('files_skipped'), ('files_excluded')) AS c(counter) "
    f"UNION ALL SELECT 'regex_candidates_checked', count(*) FROM spans JOIN docs USING (doc_id) WHERE NOT {S.is_suppressed('path')} "
    f"UNION ALL SELECT 'regex_validated', count(*) FROM candidates WHERE requires_validation AND NOT {S.is_suppressed('path')} "
    f"UNION ALL SELECT 'entropy_candidates_checked', count(*) FROM token_places p JOIN docs d ON d.doc_id = p.doc_id WHERE NOT {S.is_generated('d.path')} AND {_CLEAN_SQL} <> '' "
    f"AND NOT EXISTS (SELECT 1 FROM random r WHERE r.doc_id = p.doc_id AND r.raw_value = {_CLEAN_SQL} AND p.stop - length(p.value) > r.start) "
    "UNION ALL SELECT 'entropy_accepted', count(*) FROM random "
    f"UNION ALL SELECT 'final_findings_published', (SELECT count(*) FROM kept) + (SELECT count(*) FROM ({_PATH_FINDINGS})) + (SELECT count(*) FROM random)",
)

# --- what is stored, and what is read back --------------------------------------------------------------------------

_add(
    "findings_stored",
    _docs_query(lambda docs: findings.to_findings(detect.detect_regex(docs, ["doc_id", "path"], path="path"), path="path", ordinal=["doc_id"]).drop("timestamp")),
    f"WITH {S.DOCS}, {_REGEX_SQL}, found AS (SELECT {_RESULT_SQL}, path FROM kept UNION ALL SELECT {_RESULT_SQL}, raw_value AS path FROM ({_PATH_FINDINGS})) "
    f"SELECT {S.finding_id()} AS event_id, {S.severity('category')} AS severity, '{findings.EVENT_TYPE}' AS event_type, '{findings.SOURCE}' AS source, CAST(NULL AS VARCHAR) AS raw_extract, CAST(NULL AS VARCHAR) AS vault_ref, path AS file_path, detector, entity_type, "
    f"{S.mask('raw_value')} AS masked_value, context, least(100, greatest(0, confidence_score)) / 100.0::DOUBLE AS confidence, CAST(NULL AS INTEGER) AS line_number, requires_validation AS validated FROM found",
)


def _stored_alerts(spark: SparkSession, d: str) -> DataFrame:
    return correlation.to_alerts(correlation.fall_back(_near_log(spark, d), fixtures.processes(spark)))


_add(
    "alerts_stored",
    _stored_alerts,
    f"WITH {_NEAR_SQL}, {_PROCESSES_SQL}, told AS ({_FALLBACK_SQL}) SELECT sha256(concat_ws(chr(31), t.path, t.token_id, t.event_type, CAST(epoch_us(t.event_time) AS VARCHAR), t.alert_id)) AS event_id, t.event_time AS timestamp, 'CRITICAL' AS severity, t.event_type, 'honeycomb' AS source, "
    "CAST(NULL AS VARCHAR) AS raw_extract, CAST(NULL AS VARCHAR) AS vault_ref, t.path AS honeytoken_path, t.token_id, t.token_type, t.incident_type, 1.0::DOUBLE AS confidence, process_name, process_id, username, process_path, attribution_source FROM alerts t JOIN told USING (alert_id)",
)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """One token for each document, through the encrypted manifest."""
    from veilscan.plans import folders
    from veilscan.sources import tokens

    docs = spark.read.parquet(f"{d}/documents.parquet")
    made = docs.select(F.concat(F.lit("/home/u/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("token_id"), F.col("source").alias("token_type"), F.lit(None).cast("timestamp").alias("deployed_at"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    path = folders.shared_path(spark, "manifest")
    tokens.write_manifest(made, path, "key of the demonstration")
    return tokens.read_manifest(spark, path, "key of the demonstration").drop("deployed_at")


_add("manifest_round_trip", _manifest, "SELECT '/home/u/' || doc_id AS path, 't' || doc_id AS token_id, source AS token_type, sha256(coalesce(text, '')) AS content_hash FROM documents")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A log entry in XML for each event, read back."""
    from veilscan.sources import sysmon

    events = spread(spark.read.parquet(f"{d}/events.parquet"))
    data = lambda name, value: F.concat(F.lit(f'<Data Name="{name}">'), value, F.lit("</Data>"))
    number = F.col("event_id").cast("string")
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>'),
        number,
        F.lit('</EventID><TimeCreated SystemTime="'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit('Z"/></System><EventData>'),
        data("TargetFilename", F.concat(F.lit("/home/u/"), number, F.lit("&amp;.txt"))),
        data("CommandLine", F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("cat "), number))),
        data("Image", F.lit("/usr/bin/cat")),
        data("ProcessId", F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(number)),
        F.lit("</EventData></Event>"),
    )
    return sysmon.parse_events(events.select(xml.alias("xml")))


_add(
    "log_events",
    _log,
    "SELECT CAST(ts AS TIMESTAMP) AS system_time, CAST(event_id AS INTEGER) AS event_id, '/home/u/' || event_id || '&.txt' AS target_filename, CASE WHEN event_id % 3 <> 0 THEN 'cat ' || event_id END AS command_line, '/usr/bin/cat' AS image, "
    "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS INTEGER) END AS process_id, CAST(NULL AS VARCHAR) AS \"user\" FROM events",
)


# --- sources, sinks and streams: the SQL states what the made folders and events have to give -----------------------------------------------------------------------


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.plans import folders

    return folders.walked(spark)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.plans import folders

    return folders.scanned(spark)


def _sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.plans import folders

    return folders.sqlite_cells(spark)


def _gzipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.plans import folders

    return folders.gzip_variants(spark, sf_dir)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.plans import folders

    return folders.streamed_alerts(spark, sf_dir)


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilscan.sources.tokens import synthetic_tokens

    return synthetic_tokens(spark, 1000)


# lengths and tables of the files below :func:`folders.made_folder`, without those in pruned folders
_add(
    "file_walk",
    _walked,
    "SELECT path, CAST(length AS BIGINT) AS length, CAST(table_names AS VARCHAR[]) AS table_names FROM (VALUES ('~/.env', 39, NULL), ('~/notes.txt', 48, NULL), ('~/own.db', 12288, ['findings', 'honeycomb_alerts']), "
    "('~/people.db', 12288, ['notes', 'people']), ('~/photo.png', 4, NULL), ('~/run.log', 20, NULL), ('~/app/config', 23, NULL), ('~/deep/er/settings.yaml', 47, NULL)) AS t(path, length, table_names)",
)
# scores by hand: parts for pattern, validator, keyword, assignment, and the file's reputation
_add(
    "file_scan",
    _scanned,
    f"SELECT file_path, detector, entity_type, CAST(points AS INTEGER) AS confidence_score FROM (VALUES ('~/.env', 'regex', 'AWS_ACCESS_KEY', {R.REGEX_SCORE + R.VALIDATOR_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE + 25}), "
    f"('~/notes.txt', 'regex', 'PASSWORD', {R.REGEX_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE}), ('~/notes.txt', 'regex', 'EMAIL', {R.REGEX_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE}), "
    f"('~/people.db', 'regex', 'PAN_CARD', {R.REGEX_SCORE + R.VALIDATOR_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE}), ('~/people.db', 'regex', 'UPI_ID', {R.REGEX_SCORE + R.VALIDATOR_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE}), "
    f"('~/people.db', 'regex', 'RECOVERY_CODE', {R.REGEX_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE}), ('~/app/config', 'regex', 'CREDIT_CARD', {R.REGEX_SCORE + R.VALIDATOR_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE + 20}), "
    f"('~/deep/er/settings.yaml', 'entropy', 'HIGH_ENTROPY_SECRET', {R.ENTROPY_SCORE + R.KEYWORD_SCORE + R.ASSIGNMENT_SCORE})) AS t(file_path, detector, entity_type, points)",
)
_add(
    "sqlite_scan",
    _sqlite,
    "SELECT '~/people.db' AS file_path, table_name, CAST(r AS BIGINT) AS row_no, CAST(c AS INTEGER) AS col_no, cell FROM (VALUES ('people', 0, 0, 'Ann'), ('people', 0, 1, 'pan: ABCPE1234F'), ('people', 1, 0, 'Bo'), "
    "('people', 1, 1, 'upi: alice@ybl'), ('notes', 0, 0, 'backup code: ABCD-1234-EF56')) AS t(table_name, r, c, cell)",
)
_add("gzip_decode", _gzipped, f"WITH texts AS (SELECT doc_id, text AS variant FROM documents) SELECT doc_id, variant FROM texts WHERE {_READABLE}")
# one event on each of the first four deployments, the third of them a move to the sixth
_PLACES = [(f"/home/u/{place}", kind) for place, kind in R.DEPLOYMENTS]
_ALERTED = ((0, "modified"), (1, "deleted"), (2, "moved"), (5, "moved_to"), (3, "opened"))
_add(
    "streaming_alerts",
    _streamed,
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{_PLACES[k][0]}', '{event}', '{R.INCIDENTS[event]}', '{_PLACES[k][1]}', 'UNKNOWN')" for k, event in _ALERTED)
    + ") AS t(honeytoken_path, event_type, incident_type, token_type, attribution_source)",
)
_add("honeytoken_generator", _synthetic, S.synthetic_tokens(1000, 1))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: statement for name, (_, statement) in _CATALOGUE.items() if statement}
