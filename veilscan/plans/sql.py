"""SQL for another engine: the same inputs and steps as the queries, stated without this library's expressions."""

from __future__ import annotations

from veilscan import rules as R
from veilscan.plans import fixtures
from veilscan.sources import tokens


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def string(text: str) -> str:
    """A string literal; line breaks and backslashes are written as they are."""
    return quoted(text)


def listed(values) -> str:
    return "[" + ", ".join(string(v) for v in values) + "]"


def picked(values, number: str) -> str:
    return f"({listed(values)})[(({number}) % {len(values)}) + 1]"


DOCS = f"docs AS (SELECT doc_id, coalesce(text, '') || {picked(fixtures.PLANTED, 'doc_id')} AS text, {picked(fixtures.PATHS, 'doc_id // 7')} AS path FROM documents)"


def folded(text: str) -> str:
    """Letters beyond ASCII as a plain letter, so that word boundaries fall where Unicode has them; lengths stay."""
    return f"regexp_replace({text}, '[^\\x00-\\x7F]', 'a', 'g')"


def spans(source: str, rules: list[tuple[int, str]], key: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in ``spans``(key, rule_idx, start, stop, value): matches and their offsets by running sums."""
    each = " UNION ALL ".join(f"SELECT {key}, {text} AS t, {i} AS rule_idx, regexp_extract_all({folded(text)}, {string(p)}) AS m, string_split_regex({folded(text)}, {string(p)}) AS s FROM {source}" for i, p in rules)
    return (
        f"matched AS ({each}), "
        f"steps AS (SELECT {key}, t, rule_idx, unnest(range(1, len(m) + 1)) AS i, m, s FROM matched WHERE len(m) > 0), "
        f"placed AS (SELECT {key}, t, rule_idx, i, length(m[i]) AS n, sum(length(s[i]) + length(m[i])) OVER (PARTITION BY {key}, rule_idx ORDER BY i) AS stop FROM steps), "
        f"spans AS (SELECT {key}, t, rule_idx, CAST(stop - n AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, substr(t, CAST(stop - n AS BIGINT) + 1, n) AS value FROM placed)"
    )


def normal(path: str) -> str:
    return f"replace({path}, '\\', '/')"


def first_match(path: str, scores) -> str:
    cases = " ".join(f"WHEN regexp_matches({path}, {string(p)}) THEN {s}" for p, s in scores)
    return f"(CASE {cases} ELSE 0 END)"


def reputation(path: str) -> str:
    p = normal(path)
    return f"({first_match(p, R.POSITIVE_REPUTATION)} + {first_match(p, R.NEGATIVE_REPUTATION)} + {first_match(p, R.APPLICATION_DATA)})"


def window(text: str, start: str, stop: str, size: int = R.CONTEXT_CHARS) -> str:
    return f"substr({text}, greatest({start} - {size}, 0) + 1, least(length({text}), {stop} + {size}) - greatest({start} - {size}, 0))"


def flattened(context: str) -> str:
    return f"regexp_replace(replace({context}, chr(10), ' '), '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"


def has_any(low: str, words: str) -> str:
    return f"(len(list_filter({words}, lambda k: contains({low}, k))) > 0)"


def mask(value: str) -> str:
    return f"(CASE WHEN length({value}) <= 6 THEN repeat('*', length({value})) ELSE left({value}, 4) || repeat('*', length({value}) - 6) || right({value}, 2) END)"


def severity(category: str) -> str:
    return "(CASE " + " ".join(f"WHEN {category} = '{c}' THEN '{s}'" for c, s in R.SEVERITY.items()) + " ELSE 'MEDIUM' END)"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def luhn(value: str) -> str:
    d = f"reverse({digits(value)})"
    total = f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({d}[i] AS INTEGER) WHEN CAST({d}[i] AS INTEGER) > 4 THEN 2 * CAST({d}[i] AS INTEGER) - 9 ELSE 2 * CAST({d}[i] AS INTEGER) END))"
    return f"(length({digits(value)}) > 0 AND coalesce({total}, 1) % 10 = 0)"


def verhoeff(value: str) -> str:
    from veilscan.functions.validators import _dihedral, _permutations

    d = "'" + "".join(str(x) for row in _dihedral() for x in row) + "'"
    p = "'" + "".join(str(x) for row in _permutations() for x in row) + "'"
    v = f"reverse({digits(value)})"
    moved = f"list_transform(range(0, 12), lambda i: {p}[CAST((i % 8) * 10 + CAST({v}[i + 1] AS INTEGER) + 1 AS INTEGER)])"
    check = f"list_reduce(list_concat(['0'], {moved}), lambda a, x: {d}[CAST(CAST(a AS INTEGER) * 10 + CAST(x AS INTEGER) + 1 AS INTEGER)])"
    return f"(CASE WHEN length({digits(value)}) = 12 THEN {check} = '0' ELSE false END)"


def pan(value: str) -> str:
    return f"(length({value}) = 10 AND contains('{R.PAN_HOLDERS}', upper(substr({value}, 4, 1))))"


def upi(value: str) -> str:
    low = f"lower({value})"
    scopes = " OR ".join(f"starts_with({low}, '{s}')" for s in R.NPM_SCOPES)
    providers = ", ".join(f"'{p}'" for p in R.UPI_PROVIDERS)
    return f"(NOT ({scopes}) AND NOT regexp_matches({low}, {string(R.NPM_PACKAGE)}) AND length({low}) - length(replace({low}, '@', '')) = 1 AND length(split_part({low}, '@', 1)) > 0 AND split_part({low}, '@', 2) IN ({providers}))"


def jwt(value: str) -> str:
    """The planted tokens' parts are JSON objects; any part that looks like one in base64 is taken for one."""

    def part(k: int) -> str:
        core = f"translate(string_split({value}, '.')[{k}], '-_', '+/')"
        padded = f"rpad({core}, CAST(ceil(length({core}) / 4.0) * 4 AS INTEGER), '=')"
        return f"(length({core}) % 4 <> 1 AND json_valid(try(decode(from_base64({padded})))))"

    return f"(len(string_split({value}, '.')) = 3 AND coalesce({part(1)}, false) AND coalesce({part(2)}, false))"


VALIDATORS = {"luhn": luhn, "verhoeff": verhoeff, "pan": pan, "upi": upi, "jwt": jwt}


def validity(idx: str, value: str) -> str:
    cases = " ".join(f"WHEN {idx} = {i} THEN {VALIDATORS[r.validator](value)}" for i, r in enumerate(R.RULES) if r.validator in VALIDATORS)
    return f"(CASE {cases} ELSE true END)"


def attribute(values, idx: str) -> str:
    return f"({listed(values)})[{idx} + 1]"


def flag(values, idx: str) -> str:
    return f"([{', '.join(str(bool(v)).lower() for v in values)}])[{idx} + 1]"


def candidates(source: str = "docs") -> str:
    """CTEs ending in ``candidates``: validated and scored matches of all rules."""
    words = "[" + ", ".join(f"CAST({listed(r.keywords)} AS VARCHAR[])" if r.keywords else "CAST([] AS VARCHAR[])" for r in R.RULES) + "]"
    checked = flag([r.validator for r in R.RULES], "rule_idx")
    return (
        spans(source, [(i, r.pattern) for i, r in enumerate(R.RULES)])
        + f", valid AS (SELECT s.*, d.path, {window('t', 'start', 'stop')} AS near FROM spans s JOIN {source} d USING (doc_id) WHERE {validity('rule_idx', 'value')}), "
        f"summed AS (SELECT *, {checked} AS checked, {reputation('path')} + {R.REGEX_SCORE} + CASE WHEN {checked} THEN {R.VALIDATOR_SCORE} ELSE 0 END "
        f"+ CASE WHEN {has_any('lower(near)', f'({words})[rule_idx + 1]')} THEN {R.KEYWORD_SCORE} ELSE 0 END + CASE WHEN regexp_matches({folded('near')}, {string(R.ASSIGNMENT)}) THEN {R.ASSIGNMENT_SCORE} ELSE 0 END AS total FROM valid), "
        f"candidates AS (SELECT doc_id, path, 'regex' AS detector, rule_idx, {attribute([r.name for r in R.RULES], 'rule_idx')} AS rule_name, {attribute([r.entity for r in R.RULES], 'rule_idx')} AS entity_type, "
        f"{attribute([r.category for r in R.RULES], 'rule_idx')} AS category, value AS raw_value, {flattened('near')} AS context, "
        f"CAST(CASE WHEN {flag([r.strong for r in R.RULES], 'rule_idx')} THEN greatest(total, {R.STRONG_SCORE}) ELSE total END AS INTEGER) AS confidence_score, checked AS requires_validation, start, stop FROM summed)"
    )


def greedy(source: str, out: str, key: str = "doc_id") -> str:
    """CTEs ending in ``out``: the rows of ``source`` without those that overlap one of higher priority that is kept."""
    order = "least(100, greatest(0, confidence_score)) DESC, stop - start DESC, CASE WHEN category = 'HIGH_SENSITIVE' THEN 0 ELSE 1 END, coalesce(rule_idx, -1), start"
    return (
        f"{out}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rank FROM {source}), "
        f"{out}_lists AS (SELECT {key}, list([{{'s': start, 'e': stop, 'r': rank}}] ORDER BY rank) AS l FROM {out}_ranked GROUP BY {key}), "
        f"{out}_kept AS (SELECT {key}, unnest(list_reduce(l, lambda k, f: CASE WHEN len(list_filter(k, lambda x: greatest(x.s, f[1].s) < least(x.e, f[1].e))) > 0 THEN k ELSE list_concat(k, f) END)).r AS rank FROM {out}_lists), "
        f"{out} AS (SELECT r.* FROM {out}_ranked r JOIN {out}_kept USING ({key}, rank))"
    )


def is_suppressed(path: str) -> str:
    low = f"lower({normal(path)})"
    return "(" + " OR ".join(f"contains({low}, '{p}')" for p in R.SUPPRESSED_PATH_PARTS) + ")"


def path_entity(path: str) -> str:
    p = normal(path)
    return "(CASE " + " ".join(f"WHEN regexp_matches({p}, {string(pattern)}) THEN '{entity}'" for pattern, entity in R.PATH_RULES) + " END)"


def basename(path: str) -> str:
    return f"string_split(lower({normal(path)}), '/')[-1]"


def components(path: str) -> str:
    return f"list_filter(string_split(lower({normal(path)}), '/'), lambda c: c <> '')"


def extension(name: str) -> str:
    return f"regexp_extract({name}, '^\\.*[^.].*(\\.[^.]*)$', 1)"


def within(value: str, values) -> str:
    return f"{value} IN ({', '.join(string(v) for v in values)})"


def is_excluded(path: str) -> str:
    name, parts, low = basename(path), components(path), f"lower({normal(path)})"
    has = " OR ".join(f"contains({low}, {string(p)})" for p in R.EXCLUDED_PATH_PARTS)
    return (
        f"(starts_with({name}, '$') OR {name} = 'system volume information' OR list_has_any({parts}, {listed(R.EXCLUDED_COMPONENTS)}) OR {within(name, R.EXCLUDED_FILES)} OR {within(name, R.EXCLUDED_APPS)} "
        f"OR len(list_filter({parts}, lambda c: ends_with(c, '.app'))) > 0 OR (list_contains({parts}, 'downloads') AND len(list_filter({parts}, lambda c: {within(extension('c'), R.DISTRIBUTION_EXTENSIONS)})) > 0) OR {has})"
    )


def is_generated(path: str) -> str:
    name = basename(path)
    has = " OR ".join(f"contains({name}, '{p}')" for p in R.GENERATED_NAME_PARTS)
    return f"({within(name, R.GENERATED_FILES)} OR list_has_any({components(path)}, {listed(R.GENERATED_DIRECTORIES)}) OR {has})"


TOKEN = r"""[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f"'=:]+"""


def token_spans(source: str, text: str = "text", key: str = "doc_id") -> str:
    """CTEs ending in ``tokens``(key, t, start, stop, value, clean)."""
    return (
        f"token_lists AS (SELECT {key}, {text} AS t, regexp_extract_all({text}, {string(TOKEN)}) AS m, string_split_regex({text}, {string(TOKEN)}) AS s FROM {source}), "
        f"token_steps AS (SELECT {key}, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS value, unnest(s[1:len(m)]) AS gap FROM token_lists WHERE len(m) > 0), "
        f"token_places AS (SELECT {key}, i, value, sum(length(gap) + length(value)) OVER (PARTITION BY {key} ORDER BY i) AS stop FROM token_steps), "
        f"tokens AS (SELECT {key}, CAST(stop - length(value) AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, value, trim(value, {string(R.TOKEN_STRIPPED)}) AS clean FROM token_places WHERE length(trim(value, {string(R.TOKEN_STRIPPED)})) BETWEEN {R.TOKEN_MIN} AND {R.TOKEN_MAX})"
    )


def class_count(token: str) -> str:
    kinds = (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[^\p{L}\p{N}]")
    return "(" + " + ".join(f"CAST(regexp_matches({token}, '{k}') AS INTEGER)" for k in kinds) + ")"


def is_false_positive(token: str) -> str:
    shapes = " OR ".join(f"regexp_matches({token}, {string(p)})" for p in R.TOKEN_EXCLUSIONS)
    return f"(length({token}) NOT BETWEEN {R.TOKEN_MIN} AND {R.TOKEN_MAX} OR {class_count(token)} < 2 OR {shapes})"


def shannon(token: str) -> str:
    share = f"((length({token}) - length(replace({token}, c, ''))) / CAST(length({token}) AS DOUBLE))"
    return f"list_sum(list_transform(list_distinct(string_split({token}, '')), lambda c: -{share} * log2({share})))"


def charset(token: str) -> str:
    return f"(CASE WHEN regexp_matches({token}, '^{R.HEX_TOKEN}$') THEN 'hex' WHEN regexp_matches({token}, '^{R.BASE64_TOKEN}$') THEN 'base64' ELSE 'alphanumeric' END)"


def is_beside_asset(token: str, context: str) -> str:
    low, space, asset = f"lower({token})", "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+", "(" + "|".join(e.replace(".", "\\.") for e in R.ASSET_EXTENSIONS) + ")"
    behind, ahead = f"regexp_replace(lower({context}), '{space}{asset}', '\\1', 'g')", f"regexp_replace(lower({context}), '{asset}{space}', '\\1', 'g')"
    return "(" + " OR ".join(f"contains({behind}, {low} || '{e}') OR contains({ahead}, '{e}' || {low})" for e in R.ASSET_EXTENSIONS) + ")"


def is_build_artifact(token: str, context: str) -> str:
    low = f"lower({token})"
    asset = " OR ".join(f"contains({low}, '{e}')" for e in R.ASSET_EXTENSIONS)
    hint = " OR ".join(f"contains(lower({context}), '{h}')" for h in R.BUILD_HINTS)
    return f"({asset} OR {is_beside_asset(token, context)} OR (({hint}) AND regexp_full_match({token}, '{R.GENERATED_ID}')))"


def entropy_findings(source: str = "docs") -> str:
    """CTEs ending in ``random``: findings of the entropy detector with the columns of ``candidates``."""
    boosted = has_any("lower(near)", listed(R.ENTROPY_KEYWORDS))
    least = "(CASE charset " + " ".join(f"WHEN '{k}' THEN CASE WHEN boosted THEN CAST({v} AS DOUBLE) - CAST({R.ENTROPY_KEYWORD_BOOST} AS DOUBLE) ELSE CAST({v} AS DOUBLE) END" for k, v in R.ENTROPY_THRESHOLDS.items()) + " END)"
    return (
        token_spans(source)
        + f", seen AS (SELECT t.doc_id, t.start, t.stop, t.clean, d.path, {flattened(window('d.text', 't.start', 't.stop'))} AS near FROM tokens t JOIN {source} d USING (doc_id) WHERE NOT {is_false_positive('t.clean')} AND NOT {is_generated('d.path')}), "
        f"boosting AS (SELECT *, {boosted} AS boosted, {charset('clean')} AS charset, {shannon('clean')} AS h FROM seen WHERE NOT {is_build_artifact('clean', 'near')}), "
        f"weighed AS (SELECT *, {reputation('path')} + {R.ENTROPY_SCORE} + CASE WHEN boosted THEN {R.KEYWORD_SCORE} ELSE 0 END + CASE WHEN regexp_matches({folded('near')}, {string(R.ASSIGNMENT)}) THEN {R.ASSIGNMENT_SCORE} ELSE 0 END AS total FROM boosting WHERE h - {least} >= {R.ENTROPY_MARGINS[-1][0]}), "
        f"firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clean ORDER BY start) AS k FROM weighed WHERE total >= {R.PUBLISH_SCORE}), "
        f"random AS (SELECT doc_id, path, 'entropy' AS detector, CAST(NULL AS INTEGER) AS rule_idx, CAST(NULL AS VARCHAR) AS rule_name, 'HIGH_ENTROPY_SECRET' AS entity_type, '{R.HIGH}' AS category, clean AS raw_value, near AS context, CAST(total AS INTEGER) AS confidence_score, false AS requires_validation, start, stop FROM firsts WHERE k = 1)"
    )


def finding_id() -> str:
    """The digest that names a finding of a document (doc_id, path and the columns of a result)."""
    parts = ["path", "detector", "coalesce(rule_name, '')", "entity_type", "raw_value", *(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("start", "stop", "doc_id"))]
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"


def synthetic_tokens(n: int, seed: int) -> str:
    """The templates of honeytokens filled from digests."""
    cases = []
    for i, kind in enumerate(tokens.TEMPLATES):
        parts = [
            f"translate(left(sha256('{seed}/{kind}/' || CAST(token_no AS VARCHAR) || '/{k}'), {x[1]}), '{tokens.HEX}', '{x[0]}')" if isinstance(x, tuple) else quoted(x) for k, x in enumerate(tokens.pieces(kind))
        ]
        cases.append(f"WHEN {i} THEN {' || '.join(parts)}")
    kinds = len(tokens.TEMPLATES)
    return f"SELECT token_no, ({listed(tokens.TEMPLATES)})[token_no % {kinds} + 1] AS token_type, CASE token_no % {kinds} {' '.join(cases)} END AS content FROM range({n}) AS t(token_no)"
