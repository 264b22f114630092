"""The same results as SQL for DuckDB, over the views of the test tables.

The SQL takes other routes than the Spark code where it can: token runs instead of word-boundary
patterns, line lists instead of counted patterns, whole-table windows instead of range partitions.
"""

from __future__ import annotations

import re

from faultgauge.plans import expected as C
from faultgauge.plans.expected import BLANK_TEXT, EXTENSION_CYCLE, THRESHOLDS


def one_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def tier(x: str) -> str:
    return f"CASE WHEN {x} >= 0.7 THEN 'HIGH' WHEN {x} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


def pct(x: str) -> str:
    return f"CAST(floor(({x}) * 100.0 + 0.5) AS BIGINT)"


def lookup(key: str, table: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {other} END"


EXT = values(EXTENSION_CYCLE)
_BLANK = "concat(" + ", ".join({" ": "' '", "\n": "chr(10)", "\t": "chr(9)"}[c] for c in BLANK_TEXT) + ")"

SRC = f"""src AS (SELECT doc_id, source AS repo,
  concat(CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('d', doc_id % 7, '/') END, 'f', doc_id, '.', {EXT}[doc_id % 13 + 1]) AS path,
  n_chars AS size, text AS content FROM documents)"""
# one more file, of white space only, for every 17th
BLANKS = f"""src0 AS (SELECT doc_id, source AS repo,
  concat(CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('d', doc_id % 7, '/') END, 'f', doc_id, '.', {EXT}[doc_id % 13 + 1]) AS path,
  text AS content FROM documents),
  v AS (SELECT -1 - doc_id AS doc_id, doc_id + 1 AS k, source AS repo FROM documents WHERE doc_id % 17 = 0),
  src AS (SELECT * FROM src0 UNION ALL SELECT doc_id, repo,
    concat('void/', CASE WHEN k % 11 = 0 THEN '' ELSE concat('d', k % 7, '/') END, 'f', k, '.', {EXT}[k % 13 + 1]), {_BLANK} FROM v)"""
HTML = "html_files AS (SELECT page_id, url AS path, html AS content FROM pages)"
COMMITS = """commits AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS doc_id,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id IS NULL THEN 'unknown' ELSE concat(user_id, '@example.org') END AS author FROM events)"""
USERS = """u AS (SELECT c_custkey AS user_id, concat(lower(c_mktsegment), '.', c_custkey % 400, '@example.com') AS email,
  c_name AS name FROM customer)"""
ANALYSES = f"""a0 AS (SELECT o_orderkey AS analysis_id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'owner/' ELSE concat(o_orderstatus, '/', o_orderpriority) END AS repository_name,
  o_orderdate AS created_at, o_totalprice % 100 / 100 AS overall_risk FROM orders),
  a AS (SELECT *, {tier('overall_risk')} AS risk_level FROM a0)"""
FILES = f"""f0 AS (SELECT l_orderkey AS analysis_id, l_partkey AS part,
  concat(CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat(l_returnflag, '/') END,
         CASE WHEN l_partkey % 5 = 0 THEN concat(l_linestatus, '/') ELSE '' END,
         'p', l_partkey, '-', l_linenumber, '-', l_suppkey, '.', {EXT}[l_partkey % 13 + 1]) AS file_path,
  l_quantity / 50 AS risk_score,
  CASE WHEN l_partkey % 9 <> 0 THEN CAST(floor(l_extendedprice / 100) AS BIGINT) END AS loc,
  CASE WHEN l_partkey % 8 <> 0 THEN 1 + l_linenumber * l_tax * 50 END AS complexity,
  CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey END AS commit_count FROM lineitem),
  f AS (SELECT *, {tier('risk_score')} AS risk_level,
    CASE WHEN part % 3 = 0 AND risk_score >= 0.4 THEN concat('risk in part ', part) END AS ai_explanation,
    CASE WHEN part % 4 = 0 THEN concat('test part ', part) WHEN part % 4 = 1 THEN '' END AS test_suggestions FROM f0)"""
SCORED = """s AS (SELECT l_linestatus AS model, l_orderkey % 5 AS fold, l_quantity / 50 AS score,
  CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""
SPLIT = "sr AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"

# --- lexical measures ------------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
NOT_W = r"(?:^|[^\p{L}\p{N}_])"
_SEP = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
_BL = r"\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
SP = f"[{_SEP}{_BL}]"
IDENT = "[a-zA-Z_][a-zA-Z0-9_]*"
OPERATORS = values(C.OPERATOR_SYMBOLS + C.OPERATOR_KEYWORDS)


def language(path: str) -> str:
    ext = rf"lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '(?s)^\.*[^.].*\.([^.]*)$', 1))"
    return lookup(ext, C.LANGUAGE_BY_EXTENSION, "'generic'")


def stripped(content: str, lang: str) -> str:
    def cut(x: str, pattern: str) -> str:
        return f"regexp_replace({x}, {quoted(pattern)}, '', 'g')"

    docstrings = r'(?s)""".*?"""' + "|'''.*?'''"
    return f"""CASE {lang} WHEN 'python' THEN {cut(cut(content, r'#[^\n]*'), docstrings)}
      WHEN 'ruby' THEN {cut(cut(content, r'#[^\n]*'), '(?s)=begin.*?=end')}
      ELSE {cut(cut(content, r'//[^\n]*'), r'(?s)/\*.*?\*/')} END"""


def masked(content: str) -> str:
    pattern = "|".join(rf"{q}(?:\\[^\n]|[^{q}\\])*{q}" for q in ('"', "'", "`"))
    return f"regexp_replace({content}, {quoted(pattern)}, ' STRING_LITERAL ', 'g')"


TOKENS = quoted(rf"\p{{Nd}}+[.]\p{{Nd}}{W}*|{W}+|{one_of(C.OPERATOR_SYMBOLS)}")


def token_lists(clean: str) -> tuple[str, str, str]:
    """Expressions for all tokens, and from a list ``toks`` of them operators and operands."""
    ops = f"list_filter(toks, lambda x: list_contains({OPERATORS}, x))"
    number = quoted(rf"\p{{Nd}}+[.]\p{{Nd}}{W}*")
    cut = (
        rf"list_transform(toks, lambda x: CASE WHEN regexp_full_match(x, {number}) AND NOT "
        rf"regexp_full_match(x, '\p{{Nd}}+[.]\p{{Nd}}+') THEN regexp_extract(x, '^\p{{Nd}}+') ELSE x END)"
    )
    opnds = (
        f"list_filter({cut}, lambda x: NOT list_contains({OPERATORS}, x) AND "
        rf"regexp_full_match(x, '{IDENT}|\p{{Nd}}+([.]\p{{Nd}}+)?'))"
    )
    return f"regexp_extract_all({clean}, {TOKENS})", ops, opnds


def decisions(clean: str, lang: str) -> str:
    def of(name: str) -> str:
        words = values(C.DECISION_WORDS[name] + C.DECISION_SYMBOLS[name])
        return (
            f"len(list_filter(regexp_extract_all({clean}, {quoted(W + '+' + r'|&&|\|\||' + chr(92) + '?')}), "
            f"lambda x: list_contains({words}, x)))"
        )

    special = " ".join(f"WHEN '{n}' THEN {of(n)}" for n in C.DECISION_WORDS if n != "generic")
    return f"CASE {lang} {special} ELSE {of('generic')} END"


def lexical(base: str, key: str) -> str:
    """CTEs ending in ``m``: the metric record of every row of ``base(key, path, content)``."""
    toks, ops, opnds = token_lists("clean")

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(spaced, {quoted(pattern)}))"

    definitions = " + ".join(
        [
            count(rf"{NOT_W}(?:{one_of(C.DEFINITION_WORDS)}){SP}+{IDENT}"),
            count(rf"{NOT_W}(?:{one_of(C.MEMBER_WORDS)}){SP}+{IDENT}{SP}*\("),
            count(rf"{NOT_W}class{SP}+{IDENT}"),
        ]
    )
    return f"""
  l1 AS (SELECT {key} AS key, content, CASE WHEN path = '' THEN 'generic' ELSE {language('path')} END AS lang,
    NOT regexp_matches(content, '[^{SP[1:-1]}]') AS blank FROM {base}),
  l2 AS (SELECT *, {masked(stripped('content', 'lang'))} AS clean, string_split_regex(content, '\\r\\n|[{_SEP}]') AS parts FROM l1),
  l3 AS (SELECT key, lang, blank, clean, replace(clean, '(', '( ') AS spaced, {toks} AS toks,
    CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM l2),
  l4 AS (SELECT key, lang, blank, {ops} AS ops, {opnds} AS opnds, {decisions('clean', 'lang')} AS decs, {definitions} AS defs,
    {count(rf"{NOT_W}{IDENT}{SP}*\(")} AS calls, len(lines) AS total,
    len(list_filter(lines, lambda x: NOT regexp_matches(x, '[^{SP[1:-1]}]'))) AS blanks,
    len(list_filter(lines, lambda x: regexp_matches(x, '^{SP}*(?:#|//|/\\*|\\*)'))) AS comments FROM l3),
  l5 AS (SELECT *, len(ops) AS n1, len(opnds) AS n2, len(list_distinct(ops)) AS e1, len(list_distinct(opnds)) AS e2 FROM l4),
  m AS (SELECT key, total, blanks, comments, CAST(greatest(1, total - blanks - comments) AS INTEGER) AS raw_sloc, decs,
    CAST(CASE WHEN blank THEN 0 ELSE total END AS INTEGER) AS loc,
    CAST(CASE WHEN blank THEN 0 ELSE greatest(1, total - blanks - comments) END AS INTEGER) AS sloc,
    CAST(CASE WHEN blank THEN 1 ELSE 1 + decs END AS DOUBLE) AS cyclomatic_complexity,
    CAST(CASE WHEN blank THEN 0 ELSE n1 + n2 END AS DOUBLE) AS length,
    CASE WHEN blank OR e1 + e2 = 0 THEN 0.0::DOUBLE ELSE (n1 + n2) * log2(CAST(e1 + e2 AS DOUBLE)) END AS volume,
    CASE WHEN blank OR e2 = 0 THEN 0.0::DOUBLE ELSE (e1 / 2.0::DOUBLE) * (n2 / e2::DOUBLE) END AS difficulty,
    CAST(CASE WHEN blank THEN 0 ELSE n1 END AS DOUBLE) AS num_operators,
    CAST(CASE WHEN blank THEN 0 ELSE n2 END AS DOUBLE) AS num_operands,
    CAST(CASE WHEN blank THEN 0 ELSE 2 * decs END AS DOUBLE) AS branch_count,
    CAST(CASE WHEN blank THEN 0 ELSE greatest(1, defs) END AS DOUBLE) AS int_fan_in,
    CAST(CASE WHEN blank THEN 0 ELSE greatest(0, calls - defs) END AS DOUBLE) AS int_fan_out,
    CASE WHEN blank THEN 'empty' ELSE lang END AS language FROM l5)"""


ALL_METRICS = """loc, sloc, cyclomatic_complexity, length, round(volume, 6) AS volume, round(difficulty, 6) AS difficulty,
  num_operators, num_operands, branch_count, int_fan_in, int_fan_out, language"""
SRC_M = f"WITH {SRC}, {lexical('src', 'doc_id')}"
HTML_M = f"WITH {HTML}, {lexical('html_files', 'page_id')}"
LABELLED = """lab AS (SELECT doc_id, '' AS path, text AS content, 1 - quality AS label FROM documents JOIN labels USING (doc_id))"""

ORACLE: dict[str, str] = {}

# --- scans, sources, sinks -------------------------------------------------------------------------

ORACLE["parse_repo_url"] = r"""
WITH t AS (SELECT page_id, page_id % 6 AS k, regexp_replace(url, '^https?://[^/]*', '') AS tail,
             regexp_extract(regexp_replace(url, '^https?://[^/]*', ''), '^[^?#]*') AS bare FROM pages),
p AS (SELECT page_id, k, list_filter(string_split(bare, '/'), lambda x: x <> '') AS parts FROM t),
n AS (SELECT page_id, k, parts[1] AS owner,
        CASE WHEN k = 2 THEN regexp_replace(concat(parts[2], CASE WHEN len(parts) = 2 THEN '.git' ELSE '' END), '\.git$', '')
             ELSE regexp_replace(parts[2], '\.git$', '') END AS repo,
        k <> 4 AND len(parts) >= 2 AS ok FROM p)
SELECT page_id, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN repo END AS repo, NOT ok AS failed FROM n"""

ORACLE["scan_tree"] = f"WITH {SRC} SELECT repo, path, size FROM src"

ORACLE["content_fallback"] = f"""WITH {SRC} SELECT repo, path,
  CASE WHEN doc_id % 3 <> 0 THEN content WHEN doc_id % 2 = 0 THEN concat('copy of ', content) ELSE '' END AS content FROM src"""

ORACLE["commit_scan"] = f"""WITH {SRC}, {COMMITS}
SELECT src.doc_id, path, event_id, author FROM src LEFT JOIN commits USING (doc_id)"""

ORACLE["read_training"] = f"""WITH {LABELLED}, {lexical('lab', 'doc_id')}
SELECT CAST(loc AS DOUBLE) AS LOC, cyclomatic_complexity AS CYCLO, length AS LENGTH, round(volume, 6) AS VOLUME,
  round(difficulty, 6) AS DIFFICULTY, int_fan_in AS INT_FAN_IN, int_fan_out AS INT_FAN_OUT, num_operators AS NUM_OPERATORS,
  num_operands AS NUM_OPERANDS, branch_count AS BRANCH_COUNT, CAST(label AS INTEGER) AS DEFECT_LABEL
FROM m JOIN lab ON m.key = lab.doc_id WHERE doc_id % 10 <> 0"""

ORACLE["feature_bounds"] = "\nUNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS feature_order, '{f}' AS feature, "
    + (
        "min(o_totalprice) AS bound_min, max(o_totalprice) AS bound_max FROM orders"
        if f == "LOC"
        else f"CAST({C.SCALING_BOUNDS[f][0]} AS DOUBLE), CAST({C.SCALING_BOUNDS[f][1]} AS DOUBLE)"
    )
    for i, f in enumerate(C.FEATURES)
)

ORACLE["persist_analysis"] = f"""WITH {ANALYSES}, {FILES}, n AS (SELECT analysis_id, count(*) AS files FROM f GROUP BY 1)
SELECT analysis_id, user_id, round(CASE WHEN analysis_id % 10 = 0 THEN 0 ELSE overall_risk END, 6) AS overall_risk,
  CASE WHEN analysis_id % 10 = 0 THEN 'LOW' ELSE risk_level END AS risk_level, files FROM a LEFT JOIN n USING (analysis_id)"""

ORACLE["lookup_owned"] = f"""WITH {ANALYSES},
o AS (SELECT analysis_id, CASE WHEN analysis_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id FROM a),
w AS (SELECT analysis_id + 5 AS analysis_id, user_id FROM o UNION ALL SELECT analysis_id, user_id FROM o)
SELECT w.analysis_id, w.user_id, CASE WHEN a.analysis_id IS NULL THEN 'not found' ELSE 'found' END AS outcome, repository_name
FROM w LEFT JOIN a ON a.analysis_id = w.analysis_id AND a.user_id = w.user_id"""

ORACLE["unique_insert"] = f"""WITH {USERS}
SELECT * FROM u WHERE user_id % 2 = 1 AND email NOT IN (SELECT email FROM u WHERE user_id % 2 = 0)
QUALIFY row_number() OVER (PARTITION BY email ORDER BY user_id) = 1"""

ORACLE["cascade_delete"] = f"""WITH {USERS}, {ANALYSES}, {FILES}, ka AS (SELECT * FROM a WHERE user_id % 7 <> 0)
SELECT 'users' AS table_name, count(*) AS rows_left, CAST(sum(user_id) AS BIGINT) AS id_sum FROM u WHERE user_id % 7 <> 0
UNION ALL SELECT 'analyses', count(*), CAST(sum(analysis_id) AS BIGINT) FROM ka
UNION ALL SELECT 'analysis_files', count(*), CAST(sum(analysis_id) AS BIGINT) FROM f WHERE analysis_id IN (SELECT analysis_id FROM ka)"""

# --- filters ---------------------------------------------------------------------------------------

_SUPPORTED = r"regexp_matches(lower(path), '\.(" + "|".join(C.SUPPORTED_EXTENSIONS) + ")$')"

ORACLE["filter_supported"] = f"""WITH {SRC}, p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(path) ELSE path END AS path FROM src)
SELECT doc_id, path FROM p WHERE {_SUPPORTED}"""

ORACLE["filter_blank"] = f"WITH {BLANKS} SELECT doc_id, path FROM src WHERE regexp_matches(content, '[^{SP[1:-1]}]')"

ORACLE["filter_elevated"] = f"""WITH {FILES} SELECT analysis_id, file_path, risk_score, risk_level FROM f
WHERE risk_score >= 0.4"""

ORACLE["drop_dirty"] = """SELECT l_orderkey, l_returnflag AS flag, l_linestatus AS status, l_quantity FROM lineitem
WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0"""

ORACLE["repo_status"] = f"""WITH {BLANKS}, p AS (
  SELECT concat('a', doc_id % 13) AS repo, path, content FROM src UNION ALL SELECT concat('b', doc_id % 17), path, content FROM src),
c AS (SELECT repo, count_if({_SUPPORTED}) AS supported_files,
        count_if({_SUPPORTED} AND regexp_matches(content, '[^{SP[1:-1]}]')) AS readable_files FROM p GROUP BY 1)
SELECT repo, CAST(supported_files AS BIGINT) AS supported_files, CAST(readable_files AS BIGINT) AS readable_files,
  CASE WHEN supported_files = 0 THEN {quoted(C.NO_SUPPORTED_FILES)} WHEN readable_files = 0 THEN {quoted(C.ALL_FILES_EMPTY)}
       ELSE 'ok' END AS status FROM c"""

# --- contract on maps of text ----------------------------------------------------------------------

_MULTIPLIERS = {"LOC": 3, "CYCLO": 7, "LENGTH": 11, "VOLUME": 13, "DIFFICULTY": 17, "INT_FAN_IN": 19,
                "INT_FAN_OUT": 23, "NUM_OPERATORS": 29, "NUM_OPERANDS": 31, "BRANCH_COUNT": 37}
_SPECIAL = {"LOC": "WHEN o_orderkey % 12 IN (1, 9) THEN 'abc' WHEN o_orderkey % 12 IN (7, 8) THEN '12.5'",
            "CYCLO": "WHEN o_orderkey % 12 = 2 THEN 'NaN'", "VOLUME": "WHEN o_orderkey % 12 = 3 THEN 'Infinity'",
            "DIFFICULTY": "WHEN o_orderkey % 12 = 4 THEN '-Infinity'", "INT_FAN_IN": "WHEN o_orderkey % 12 = 10 THEN NULL",
            "INT_FAN_OUT": "WHEN o_orderkey % 12 IN (5, 6) THEN NULL", "NUM_OPERANDS": "WHEN o_orderkey % 12 = 6 THEN NULL",
            "BRANCH_COUNT": "WHEN o_orderkey % 12 = 9 THEN 'NaN'"}
_ALIASED = ", ".join(
    f"CASE {_SPECIAL.get(f, 'WHEN false THEN NULL')} ELSE CAST(o_orderkey * {k} % 1000 AS VARCHAR) END AS {f}"
    for f, k in _MULTIPLIERS.items()
)
ORACLE["alias_features"] = f"SELECT o_orderkey AS id, {_ALIASED} FROM orders"

# Bad entries come in the order of their arrival: the first LOC, CYCLO ... BRANCH_COUNT, the second LOC.
_TEXTS = {1: "Feature 'LOC' has non-numeric value: abc", 2: "Feature 'CYCLO' is NaN. Invalid numeric input.",
          3: "Feature 'VOLUME' is Infinity. Invalid numeric input.", 4: "Feature 'DIFFICULTY' is Infinity. Invalid numeric input.",
          5: C.MISSING_FEATURES_PREFIX + "['INT_FAN_OUT']", 6: C.MISSING_FEATURES_PREFIX + "['INT_FAN_OUT', 'NUM_OPERANDS']",
          8: "Feature 'LOC' is NaN. Invalid numeric input.", 9: "Feature 'BRANCH_COUNT' is NaN. Invalid numeric input.",
          10: "Feature 'INT_FAN_IN' has non-numeric value: None"}
_CHECKED = f"""WITH x AS (SELECT o_orderkey AS id, {_ALIASED} FROM orders),
  e AS (SELECT *, CASE id % 12 {' '.join(f'WHEN {k} THEN {quoted(t)}' for k, t in _TEXTS.items())} END AS error FROM x)"""
ORACLE["validate_features"] = f"{_CHECKED} SELECT id, error FROM e"
ORACLE["contract_failures"] = f"""{_CHECKED} SELECT id, CAST(0.5 AS DOUBLE) AS risk_score, 'MEDIUM' AS risk_level,
  {quoted(C.CONTRACT_FAILURE_RECOMMENDATION)} AS recommendation, error, CAST(0 AS INTEGER) AS factors FROM e WHERE error IS NOT NULL"""


def _scaled(f: str) -> str:
    low, high, _ = C.SCALING_BOUNDS[f]
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({C.METRIC_OF_FEATURE[f]} - {low}::DOUBLE) / {high - low}::DOUBLE))"


ORACLE["scale_features"] = f"{SRC_M} SELECT key AS doc_id, " + ", ".join(f"round({_scaled(f)}, 6) AS {f}" for f in C.FEATURES) + " FROM m"
ORACLE["assemble"] = f"{SRC_M} SELECT key AS doc_id, " + ", ".join(
    f"CAST(CAST({_scaled(f)} AS FLOAT) AS DOUBLE) AS {f}" for f in C.FEATURES) + " FROM m"

# --- projections -----------------------------------------------------------------------------------

ORACLE["short_repo_name"] = """SELECT o_orderkey AS analysis_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'Unknown' ELSE o_orderpriority END AS name FROM orders"""

ORACLE["metrics_payload"] = f"""{SRC_M} SELECT key AS doc_id, loc, language, num_operands,
  CAST(1 AS BIGINT) AS commit_count, CAST(1 AS BIGINT) AS contributor_count FROM m"""

# --- static code metrics ---------------------------------------------------------------------------

ORACLE["detect_language"] = f"""WITH {SRC}, p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '.env/.' || regexp_extract(path, '[^.]*$')
  WHEN doc_id % 5 = 1 THEN upper(path) ELSE path END AS path FROM src) SELECT doc_id, {language('path')} AS language FROM p"""

_DISPLAY = r"lower(regexp_extract(path, '[^.]*$'))"
ORACLE["display_language"] = rf"""WITH {SRC}, p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(path, '\.[^.]*$', '')
  ELSE path END AS path FROM src) SELECT doc_id, {lookup(_DISPLAY, C.DISPLAY_LANGUAGE, f'upper({_DISPLAY})')} AS language FROM p"""

for _name, _head, _key in (("line_counts", SRC_M, "doc_id"), ("html_line_counts", HTML_M, "page_id")):
    ORACLE[_name] = f"""{_head} SELECT key AS {_key}, CAST(total AS INTEGER) AS total, CAST(blanks AS INTEGER) AS blank,
      CAST(comments AS INTEGER) AS comment, raw_sloc AS sloc FROM m"""

ORACLE["strip_comments"] = f"""SELECT page_id, md5({stripped('html', "['python', 'ruby', 'java'][page_id % 3 + 1]")}) AS text_md5 FROM pages"""
ORACLE["mask_strings"] = f"SELECT page_id, md5({masked('html')}) AS text_md5 FROM pages"

_TOKS, _OPS, _OPNDS = token_lists(masked(stripped("content", language("path"))))
ORACLE["operator_tokens"] = f"""WITH {HTML}, t AS (SELECT page_id, {_TOKS} AS toks FROM html_files),
x AS (SELECT page_id, unnest({_OPS}) AS token FROM t) SELECT page_id, token, count(*) AS n FROM x GROUP BY ALL"""
ORACLE["operand_tokens"] = f"""WITH {SRC}, t AS (SELECT doc_id, {_TOKS} AS toks FROM src),
x AS (SELECT doc_id, unnest({_OPNDS}) AS token FROM t) SELECT doc_id, token, count(*) AS n FROM x GROUP BY ALL"""

ORACLE["halstead"] = f"""{HTML_M} SELECT key AS page_id, num_operators, num_operands, length, round(volume, 6) AS volume,
  round(difficulty, 6) AS difficulty FROM m"""

_CLEAN = masked(stripped("content", "language"))
ORACLE["cyclomatic_lexical"] = f"""WITH {SRC}, x AS (SELECT doc_id, content, unnest(['java', 'c', 'go', 'php', 'ruby']) AS language FROM src),
c AS (SELECT doc_id, language, {_CLEAN} AS clean FROM x)
SELECT doc_id, language, CAST(1 + {decisions('clean', 'language')} AS INTEGER) AS cyclo FROM c"""

ORACLE["branch_count"] = f"{HTML_M} SELECT key AS page_id, cyclomatic_complexity, branch_count FROM m"
ORACLE["fan_in_out"] = f"{HTML_M} SELECT key AS page_id, int_fan_in, int_fan_out FROM m"
ORACLE["file_metrics"] = f"{SRC_M} SELECT key AS doc_id, {ALL_METRICS} FROM m"
ORACLE["html_metrics"] = f"{HTML_M} SELECT key AS page_id, {ALL_METRICS} FROM m"
ORACLE["blank_metrics"] = f"WITH {BLANKS}, {lexical('src', 'doc_id')} SELECT key AS doc_id, {ALL_METRICS} FROM m WHERE language = 'empty'"

# The generated Python files: nine operands and six operators per word, from the shape of its lines.
_WORDS = rf"regexp_extract_all(text, '{W}+')"
_LINE = ("concat('    if ''', w, ''' in rows and seen >= 0:', chr(10), '        seen = seen + len(''', w, ''')', chr(10))")
_PY = f"""g0 AS (SELECT doc_id, {_WORDS} AS words FROM documents),
  gen AS (SELECT doc_id, len(words) AS n, len(list_distinct(words)) AS dw, 'gen/x.py' AS path,
    concat('def scan_', doc_id, '(rows):', chr(10), '    seen = 0', chr(10),
      array_to_string(list_transform(words, lambda w: {_LINE}), ''), '    return seen', chr(10),
      CASE WHEN doc_id % 3 = 0 THEN concat('rest = (', chr(10)) ELSE '' END) AS content FROM g0)"""
_AST = """SELECT doc_id, CAST(3 + 2 * n AS INTEGER) AS loc, CAST(3 + 2 * n AS INTEGER) AS sloc,
  CAST(1 + 2 * n AS DOUBLE) AS cyclomatic_complexity, CAST(4 + 15 * n AS DOUBLE) AS length,
  round((4 + 15 * n) * log2(CAST(CASE WHEN n > 0 THEN 11 + dw ELSE 3 END AS DOUBLE)), 6) AS volume,
  round(CASE WHEN n > 0 THEN 3.0::DOUBLE * ((4 + 9 * n) / (5 + dw)::DOUBLE) ELSE 0 END, 6) AS difficulty,
  CAST(6 * n AS DOUBLE) AS num_operators, CAST(4 + 9 * n AS DOUBLE) AS num_operands, CAST(2 * n AS DOUBLE) AS branch_count,
  1.0::DOUBLE AS int_fan_in, CAST(greatest(0, n - 1) AS DOUBLE) AS int_fan_out, 'python' AS language FROM gen"""
ORACLE["py_ast_facts"] = f"WITH {_PY} {_AST}"
ORACLE["ast_fallback"] = f"""WITH {_PY}, bad AS (SELECT * FROM gen WHERE doc_id % 3 = 0), {lexical('bad', 'doc_id')}
{_AST} WHERE doc_id % 3 <> 0 UNION ALL SELECT key, {ALL_METRICS} FROM m"""

# --- scoring and explanation -----------------------------------------------------------------------

# The forest of 25 trees over a table ``m`` of metrics: its splits (0; 1 on its left, 2 on its right) and leaves (3 to 6).
FOREST = """nodes AS (SELECT n_nationkey AS tree, n_nationkey AS k, n_regionkey AS r FROM nation),
  split AS (SELECT tree, n, (k * 3 + n * (r + 2)) % 10 + 1 AS feature, ((k * 7 + n * 9) % 20 + 1) / 64 AS threshold,
    CAST((k * 5 + n) % 7 + 1 AS DOUBLE) AS gain FROM nodes, (SELECT unnest([0, 1, 2]) AS n)),
  leaf AS (SELECT tree, n, ((k * 11 + r * 3 + n * 5) % 13 - 6) / 16 * 0.125::DOUBLE AS v, n IN (3, 4) AS l0, n IN (3, 5) AS l1,
    CASE WHEN n IN (3, 4) THEN 1 ELSE 2 END AS second, CASE WHEN n IN (3, 4) THEN 0.25::DOUBLE ELSE 0.75 END AS z0,
    CASE WHEN n IN (3, 5) THEN 0.25::DOUBLE ELSE 0.75 END AS z1 FROM nodes, (SELECT unnest([3, 4, 5, 6]) AS n))"""


def explained(source: str = "m", value=None) -> str:
    """CTEs ``margin(key, base, raw)`` and ``phi(key, feature, c)``: leaf by leaf, each with at most two features."""
    x = "[" + ", ".join(f"CAST(CAST({(value or _scaled)(f)} AS FLOAT) AS DOUBLE)" for f in C.FEATURES) + "]"
    return f"""{FOREST}, xs AS (SELECT key, {x} AS x FROM {source}),
  path AS (SELECT key, v, a.feature AS f0, b.feature AS f1, CAST((x[a.feature] <= a.threshold) = l0 AS INTEGER) AS o0,
    CAST((x[b.feature] <= b.threshold) = l1 AS INTEGER) AS o1, z0, z1
    FROM xs, leaf JOIN split a ON a.tree = leaf.tree AND a.n = 0 JOIN split b ON b.tree = leaf.tree AND b.n = second),
  margin AS (SELECT key, 2 * sum(v * o0 * o1) AS raw, 2 * sum(v * z0 * z1) AS base FROM path GROUP BY key),
  parts AS (SELECT key, f0 AS feature, CASE WHEN f0 = f1 THEN v * (o0 * o1 - z0 * z1) ELSE v * (o0 - z0) * (z1 + o1) / 2 END AS c FROM path
    UNION ALL SELECT key, f1, v * (o1 - z1) * (z0 + o0) / 2 FROM path WHERE f0 <> f1),
  phi AS (SELECT key, feature, 2 * sum(c) AS c FROM parts GROUP BY ALL)"""


_RISK = "1 / (1 + exp(-raw))"
_COLUMNS = ", ".join(f"round(coalesce(sum(c) FILTER (feature = {i + 1}), 0), 6) AS {f}" for i, f in enumerate(C.FEATURES))
ORACLE["score_files"] = f"""{SRC_M}, {explained()} SELECT doc_id, path, round({_RISK}, 6) AS risk_score, {tier(_RISK)} AS risk_level
FROM margin JOIN src ON doc_id = key"""
ORACLE["tree_shap"] = f"""{SRC_M}, {explained()}, w AS (SELECT key, {_COLUMNS} FROM phi GROUP BY key)
SELECT w.* RENAME (key AS doc_id), round(base, 6) AS base_value, true AS adds_up FROM w JOIN margin USING (key)"""
_EACH_FEATURE = f"(SELECT unnest({values(C.FEATURES)}) AS feature, unnest(range(1, 11)) AS i)"
ORACLE["shap_global"] = f"""WITH {LABELLED}, {lexical('lab', 'doc_id')}, {explained()}, n AS (SELECT count(*) AS rows FROM m),
means AS (SELECT d.feature, coalesce(sum(abs(c)), 0) / any_value(rows) AS mean_abs FROM {_EACH_FEATURE} d CROSS JOIN n LEFT JOIN phi ON phi.feature = i GROUP BY 1)
SELECT feature, round(mean_abs, 6) AS mean_abs_shap, round(mean_abs / sum(mean_abs) OVER (), 6) AS shap_share FROM means"""
ORACLE["gain_importance"] = f"""WITH {FOREST}, means AS (SELECT d.feature, coalesce(avg(gain), 0) AS g FROM {_EACH_FEATURE} d LEFT JOIN split ON split.feature = i GROUP BY 1)
SELECT feature, round(g, 6) AS mean_gain, round(g / sum(g) OVER (), 6) AS gain_share FROM means"""

ORACLE["score_default"] = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 25 - 0.5::DOUBLE)) END AS score FROM lineitem"""
ORACLE["risk_tiers"] = f"WITH {FILES} SELECT analysis_id, file_path, risk_score, risk_level FROM f"

_PHI = "\n UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS position, '{f}' AS feature, CAST((o_orderkey * {i + 3} + o_custkey * {i * i}) % 9 - 4 AS DOUBLE) / 10 AS contribution FROM orders"
    for i, f in enumerate(C.FEATURES)
)
ORACLE["shap_topk"] = f"""WITH p AS ({_PHI}), d AS (SELECT *, CASE WHEN contribution > 0 THEN 'INCREASES_RISK' ELSE 'DECREASES_RISK' END AS direction FROM p)
SELECT o_orderkey, feature, contribution, direction FROM d
QUALIFY row_number() OVER (PARTITION BY o_orderkey, direction ORDER BY abs(contribution) DESC, position) <= 3"""


def advice() -> str:
    return f"""list_filter([
    CASE WHEN cyclomatic_complexity > 15 THEN format('Refactor deeply nested conditional branches (Cyclomatic Complexity is {{:.1f}}, exceeding safe threshold of 10).', cyclomatic_complexity)
         WHEN cyclomatic_complexity > 8 THEN format('Consider breaking complex logic into smaller helper functions (Complexity: {{:.1f}}).', cyclomatic_complexity) END,
    CASE WHEN loc > 400 THEN format('Split this file into smaller, modular components (Current size is {{}} lines).', loc)
         WHEN loc > 200 THEN format('Review module responsibilities to prevent file bloat (Current size: {{}} lines).', loc) END,
    CASE WHEN branch_count > 20 THEN format('Implement branch-coverage unit tests to verify all {{}} decision paths.', CAST(branch_count AS BIGINT)) END,
    CASE WHEN difficulty > 30 THEN format('Simplify operator-to-operand ratios (Halstead Difficulty is {{:.1f}}).', difficulty) END,
    CASE WHEN int_fan_out > 15 THEN format('Reduce external coupling and dependency calls (Fan-Out is {{}}).', CAST(int_fan_out AS BIGINT)) END],
    lambda x: x IS NOT NULL)"""


_ADVICE = f"CASE WHEN len({advice()}) = 0 THEN [{quoted(C.DEFAULT_RECOMMENDATION)}] ELSE list_slice({advice()}, 1, 3) END"
ORACLE["recommendations"] = f"""WITH {HTML}, {SRC}, both_files AS (SELECT struct_pack(id := page_id, path := path) AS id, path, content FROM html_files
  UNION ALL SELECT struct_pack(id := doc_id, path := path), path, content FROM src), {lexical('both_files', 'id')}
SELECT key.id AS page_id, key.path AS path, array_to_string({_ADVICE}, ' | ') AS recommendations FROM m"""

_FEATURE_LIST = values(C.FEATURES)
_PHRASE = """CASE WHEN x = 'CYCLO' THEN format('high cyclomatic complexity ({:.1f})', cyclomatic_complexity)
  WHEN x = 'LOC' THEN format('file size ({} lines)', loc)
  WHEN x = 'BRANCH_COUNT' THEN format('a high branch count ({} paths)', CAST(branch_count AS BIGINT))
  WHEN x IN ('VOLUME', 'LENGTH') THEN format('high code volume ({:.0f} Halstead volume)', volume)
  WHEN x IN ('NUM_OPERATORS', 'NUM_OPERANDS') THEN 'high operator and operand density' END"""
ORACLE["explain_text"] = f"""WITH h AS (SELECT page_id, concat('site/p', page_id, '.js') AS path, html AS content FROM pages), {lexical('h', 'page_id')},
e AS (SELECT *, CASE key % 4 WHEN 0 THEN [] WHEN 1 THEN [{_FEATURE_LIST}[key % 10 + 1]]
    ELSE [{_FEATURE_LIST}[key % 10 + 1], {_FEATURE_LIST}[(key + 3) % 10 + 1]] END AS names FROM m),
v AS (SELECT *, list_filter(list_transform(names, lambda x: {_PHRASE}), lambda x: x IS NOT NULL) AS phrases,
   list_filter([CASE WHEN cyclomatic_complexity > 10 THEN format('high cyclomatic complexity ({{:.1f}}) with deeply nested branches', cyclomatic_complexity) END,
     CASE WHEN loc > 300 THEN format('large file size ({{}} lines)', loc) END], lambda x: x IS NOT NULL) AS fallback FROM e)
SELECT key AS page_id, concat('The XGBoost model assigned p', key, '.js a ', CAST(round_even((key % 101) / 200 * 100, 0) AS BIGINT),
  '% defect risk score primarily driven by ', array_to_string(CASE WHEN len(phrases) > 0 THEN phrases WHEN len(fallback) > 0 THEN fallback
  ELSE [{quoted(C.GENERIC_EVIDENCE)}] END, ', and '), '. ', {quoted(C.EXPLANATION_CLOSE)}) AS why,
  CASE WHEN key % 5 <> 0 THEN array_to_string({_ADVICE}, '; ') ELSE concat('Add unit tests covering the primary execution branches in `p', key,
  '.js`; refactor complex methods to reduce nesting; verify error-handling paths.') END AS suggestions FROM v"""

ORACLE["explain_gate"] = f"""WITH {FILES}, r AS (SELECT analysis_id, file_path, risk_score, risk_level,
  CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY risk_score DESC, file_path) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE rank <= 3 AND risk_level <> 'LOW'"""

FACTORS = f"""every AS (SELECT k.key, d.i, coalesce(phi.c, 0) AS c FROM margin k CROSS JOIN (SELECT unnest(range(1, 11)) AS i) d
    LEFT JOIN phi ON phi.key = k.key AND phi.feature = d.i),
  factors AS (SELECT key, list({values(C.FEATURES)}[i] ORDER BY abs(c) DESC, i) FILTER (c > 0) AS raising,
    list({values(C.FEATURES)}[i] ORDER BY abs(c) DESC, i) FILTER (c <= 0) AS lowering FROM every GROUP BY key)"""


def _from_text(f: str) -> str:
    low, high, _ = C.SCALING_BOUNDS[f]
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST({f} AS DOUBLE) - {low}::DOUBLE) / {high - low}::DOUBLE))"


# the plain spelling comes first where a map has both
_FIRST_LOC = "CASE WHEN id % 12 = 7 THEN CAST(id * 3 % 1000 AS DOUBLE) ELSE CAST(LOC AS DOUBLE) END"
ORACLE["predict_from_metrics"] = f"""{_CHECKED}, good AS (SELECT *, id AS key FROM e WHERE error IS NULL), {explained('good', _from_text)}, {FACTORS},
  given AS (SELECT id, CAST({_FIRST_LOC} AS BIGINT) AS loc, CAST(CYCLO AS DOUBLE) AS cyclomatic_complexity, CAST(BRANCH_COUNT AS DOUBLE) AS branch_count,
    CAST(DIFFICULTY AS DOUBLE) AS difficulty, CAST(INT_FAN_OUT AS DOUBLE) AS int_fan_out FROM good),
  all_rows AS (SELECT id, error FROM e)
SELECT e.id, coalesce(round({_RISK}, 6), 0.5) AS risk_score, CASE WHEN raw IS NULL THEN 'MEDIUM' ELSE {tier(_RISK)} END AS risk_level, error,
  CASE WHEN raw IS NULL THEN {quoted(C.CONTRACT_FAILURE_RECOMMENDATION)} ELSE array_to_string({_ADVICE}, ' | ') END AS recommendations,
  raising[1] AS raises, lowering[1] AS lowers
FROM all_rows e LEFT JOIN margin ON margin.key = e.id LEFT JOIN factors ON factors.key = e.id LEFT JOIN given ON given.id = e.id"""


def _spanned(f: str) -> str:
    m = C.METRIC_OF_FEATURE[f]
    return f"CASE WHEN {m}_high > {m}_low THEN ({m} - {m}_low) / ({m}_high - {m}_low) ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {m})) END"


_SPANS = ", ".join(f"CAST(min({m}) OVER () AS DOUBLE) AS {m}_low, CAST(max({m}) OVER () AS DOUBLE) AS {m}_high" for m in C.METRIC_OF_FEATURE.values())
ORACLE["score_with_bounds"] = f"""{HTML_M}, spanned AS (SELECT *, {_SPANS} FROM m), {explained('spanned', _spanned)}
SELECT key AS page_id, {_spanned('LOC')} AS LOC, round({_spanned('VOLUME')}, 6) AS VOLUME, round({_spanned('BRANCH_COUNT')}, 6) AS BRANCH_COUNT,
  round({_RISK}, 6) AS risk_score, {tier(_RISK)} AS risk_level FROM spanned JOIN margin USING (key)"""

# --- joins and roll-ups ----------------------------------------------------------------------------

ORACLE["files_with_content"] = f"""WITH {SRC} SELECT repo, path, size FROM src
WHERE doc_id % 4 <> 0 AND regexp_matches(content, '[^{SP[1:-1]}]')"""

ORACLE["churn_counts"] = f"""WITH {SRC}, {COMMITS} SELECT repo, path, count(*) AS commit_count, greatest(1, count(DISTINCT author)) AS contributor_count
FROM commits JOIN src USING (doc_id) GROUP BY 1, 2"""

ORACLE["churn_enrich"] = f"""WITH {SRC}, {COMMITS}, n AS (SELECT doc_id, count(*) AS cc, greatest(1, count(DISTINCT author)) AS dc FROM commits GROUP BY 1),
r AS (SELECT repo, path, doc_id, row_number() OVER (PARTITION BY repo ORDER BY doc_id * 37 % 100 / 100 DESC, path) AS rank FROM src)
SELECT repo, path, rank, CAST(CASE WHEN rank <= 5 THEN coalesce(cc, 1) ELSE 1 END AS BIGINT) AS commit_count,
  CAST(CASE WHEN rank <= 5 THEN coalesce(dc, 1) ELSE 1 END AS BIGINT) AS contributor_count FROM r LEFT JOIN n USING (doc_id)"""

ORACLE["analysis_with_files"] = f"""WITH {ANALYSES}, {FILES}, k AS (SELECT * FROM f WHERE analysis_id % 9 <> 0)
SELECT a.analysis_id, user_id, a.risk_level, file_path, risk_score FROM a LEFT JOIN k USING (analysis_id)"""

ORACLE["analysis_nested"] = f"""WITH {ANALYSES}, {FILES}, k AS (SELECT * FROM f WHERE analysis_id % 9 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY risk_score DESC, file_path) AS rank,
  count(*) OVER (PARTITION BY analysis_id) AS file_count FROM k),
g AS (SELECT analysis_id, any_value(file_count) AS file_count, string_agg(concat(file_path, ' ', risk_level), '; ' ORDER BY rank) FILTER (rank <= 25) AS files FROM n GROUP BY 1)
SELECT a.analysis_id, user_id, CAST(coalesce(file_count, 0) AS BIGINT) AS file_count, coalesce(files, '') AS files FROM a LEFT JOIN g USING (analysis_id)"""

ORACLE["user_analyses"] = f"WITH {ANALYSES}, {USERS} SELECT analysis_id, user_id, risk_level, name FROM a JOIN u USING (user_id)"

ORACLE["orphans"] = f"""WITH {FILES} SELECT analysis_id, file_path FROM f
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = analysis_id AND o_orderkey % 2 = 0)"""

ORACLE["repo_risk"] = f"""WITH {FILES}, g AS (SELECT analysis_id, count(*) AS files, round(avg(risk_score), 12) AS overall_risk FROM f GROUP BY 1)
SELECT analysis_id, files, round(overall_risk, 6) AS overall_risk, {tier('overall_risk')} AS risk_level FROM g"""

_SUMS = f"""g AS (SELECT analysis_id, count(*) AS n, count_if(risk_level = 'HIGH') AS high, count_if(risk_level = 'MEDIUM') AS medium,
    count_if(risk_level = 'LOW') AS low, sum(coalesce(loc, 0)) AS loc, round(avg(coalesce(complexity, 1)), 12) AS cx FROM f GROUP BY 1),
  j AS (SELECT a.*, CAST(coalesce(n, 0) AS BIGINT) AS file_count, CAST(coalesce(high, 0) AS BIGINT) AS high_count,
    CAST(coalesce(medium, 0) AS BIGINT) AS medium_count, CAST(coalesce(low, 0) AS BIGINT) AS low_count,
    CAST(coalesce(loc, 0) AS BIGINT) AS total_loc, coalesce(cx, 1) AS avg_complexity FROM a LEFT JOIN g USING (analysis_id))"""
_JOINED = f"WITH {ANALYSES}, {FILES}, {_SUMS}"
_HEALTH = pct("1 - overall_risk")
_ARCH = "greatest(0, CAST(floor(100 - (avg_complexity - 1) * 4 + 0.5) AS BIGINT))"


def _band(x: str) -> str:
    return f"CASE WHEN {x} >= 70 THEN 'good' WHEN {x} >= 40 THEN 'fair' ELSE 'poor' END"


ORACLE["tier_counts"] = f"{_JOINED} SELECT analysis_id, file_count, high_count, medium_count, low_count FROM j"
ORACLE["repo_scorecard"] = f"""{_JOINED} SELECT analysis_id, file_count, total_loc, round(avg_complexity, 6) AS avg_complexity,
  {_HEALTH} AS health, {_band(_HEALTH)} AS health_band, {_ARCH} AS architecture, {_band(_ARCH)} AS architecture_band,
  CASE WHEN total_loc * avg_complexity > 50000 THEN 'High' WHEN total_loc * avg_complexity > 15000 THEN 'Moderate' ELSE 'Low' END AS technical_debt,
  CASE WHEN avg_complexity > 10 THEN 'poor' WHEN avg_complexity > 5 THEN 'fair' ELSE 'good' END AS complexity_band FROM j"""

ORACLE["language_mix"] = f"""WITH {FILES}, p AS (SELECT analysis_id, file_path AS path FROM f),
l AS (SELECT analysis_id, {lookup(_DISPLAY, C.DISPLAY_LANGUAGE, f'upper({_DISPLAY})')} AS language FROM p),
c AS (SELECT analysis_id, language, count(*) AS files FROM l GROUP BY ALL),
t AS (SELECT *, sum(files) OVER (PARTITION BY analysis_id) AS total,
  CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY files DESC, language) AS INTEGER) AS rank FROM c)
SELECT analysis_id, rank, language, files, {pct('files / total::DOUBLE')} AS share_pct FROM t WHERE rank <= 5"""

ORACLE["hot_dirs"] = rf"""WITH {FILES}, d AS (SELECT analysis_id, risk_score,
  CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '(root)' END AS directory FROM f),
c AS (SELECT analysis_id, directory, count(*) AS files, round(avg(risk_score), 12) AS m FROM d GROUP BY ALL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY m DESC, directory) AS INTEGER) AS rank FROM c)
SELECT analysis_id, directory, files, round(m, 6) AS avg_risk, rank FROM t WHERE rank <= 4"""

_LATEST = f"""WITH {ANALYSES}, {FILES}, l AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id) AS INTEGER) AS rank FROM a),
t AS (SELECT * FROM l WHERE rank <= 10)"""
ORACLE["dashboard_totals"] = f"""{_LATEST} SELECT user_id, count(*) AS total_scans, CAST(count_if(risk_level = 'HIGH') AS BIGINT) AS critical_risks,
  round(avg(overall_risk), 9) AS avg_risk FROM t GROUP BY 1"""
ORACLE["health_buckets"] = f"""{_LATEST}, c AS (SELECT user_id, count(*) AS n, count_if(risk_level = 'HIGH') AS h, count_if(risk_level = 'MEDIUM') AS m FROM t GROUP BY 1)
SELECT user_id, 'Healthy' AS bucket, CAST(n - h - m AS BIGINT) AS analyses FROM c
UNION ALL SELECT user_id, 'Monitor', CAST(m AS BIGINT) FROM c UNION ALL SELECT user_id, 'At Risk', CAST(h AS BIGINT) FROM c"""
ORACLE["latest_analyses"] = f"{_LATEST} SELECT user_id, rank, analysis_id, strftime(created_at, '%Y-%m-%d') AS created_at FROM t"
ORACLE["risk_by_component"] = f"""{_LATEST} SELECT user_id, rank, analysis_id,
  coalesce(nullif(regexp_extract(repository_name, '[^/]*$'), ''), 'Unknown') AS name, {pct('overall_risk')} AS risk_pct FROM t WHERE rank <= 5"""
ORACLE["recent_risky_files"] = f"""{_LATEST}, r AS (SELECT f.analysis_id, f.file_path, f.risk_score, f.risk_level, user_id, repository_name,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY f.risk_score DESC, f.analysis_id, f.file_path) AS INTEGER) AS rank
  FROM f JOIN t USING (analysis_id)) SELECT * FROM r WHERE rank <= 5"""
ORACLE["history"] = f"""{_JOINED} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, analysis_id) AS position,
  analysis_id, strftime(created_at, '%Y-%m-%d') AS created_at, {pct('overall_risk')} AS risk_pct, high_count, medium_count, low_count FROM j"""

_REPORT = [
    ("Overall Risk Score", pct("overall_risk"), "risk_level"),
    ("Project Health", _HEALTH, f"CASE WHEN {_HEALTH} >= 70 THEN 'Healthy' WHEN {_HEALTH} >= 40 THEN 'Moderate' ELSE 'At Risk' END"),
    ("High Risk Files", "high_count", "'Requires Attention'"),
    ("Medium Risk Files", "medium_count", "'Monitor'"),
    ("Low Risk Files", "low_count", "'Stable'"),
]
ORACLE["report_summary"] = f"{_JOINED} " + " UNION ALL ".join(
    f"SELECT analysis_id, '{m}' AS metric, {v} AS value, {s} AS status FROM j" for m, v, s in _REPORT)
ORACLE["report_fix_first"] = f"""WITH {FILES} SELECT analysis_id, file_path, {pct('risk_score')} AS risk_pct,
  coalesce(nullif(ai_explanation, ''), {quoted(C.NO_EXPLANATION)}) AS why, coalesce(nullif(test_suggestions, ''), {quoted(C.NO_ACTION)}) AS action
  FROM f WHERE risk_level = 'HIGH'"""
ORACLE["action_texts"] = f"""WITH {FILES} SELECT analysis_id, file_path, coalesce(nullif(ai_explanation, ''), {quoted(C.HEALTHY_FILE)}) AS why,
  CASE WHEN ai_explanation <> '' THEN coalesce(nullif(test_suggestions, ''), {quoted(C.REVIEW_NEXT_SPRINT)}) END AS action FROM f"""
ORACLE["report_all_files"] = f"""WITH {FILES} SELECT analysis_id, file_path, risk_level, {pct('risk_score')} AS risk_pct, coalesce(loc, 0) AS loc,
  coalesce(floor(complexity * 10 + 0.5) / 10, 0) AS complexity, coalesce(commit_count, 0) AS commits FROM f"""
ORACLE["file_report"] = f"""WITH {SRC}, {COMMITS}, pick AS (SELECT * FROM src WHERE {_SUPPORTED}),
  full_files AS (SELECT * FROM pick WHERE regexp_matches(content, '[^{SP[1:-1]}]')), {lexical('full_files', 'doc_id')},
  n AS (SELECT doc_id, count(*) AS cc, greatest(1, count(DISTINCT author)) AS dc FROM commits GROUP BY 1),
  r AS (SELECT m.*, repo, path, cc, dc, row_number() OVER (PARTITION BY repo ORDER BY path) AS rank
    FROM m JOIN full_files ON key = full_files.doc_id LEFT JOIN n ON n.doc_id = key),
  e AS (SELECT *, list_filter([
     CASE WHEN cyclomatic_complexity > 10 THEN format('high cyclomatic complexity ({{:.1f}}) with deeply nested branches', cyclomatic_complexity) END,
     CASE WHEN loc > 300 THEN format('large file size ({{}} lines)', loc) END], lambda x: x IS NOT NULL) AS evidence FROM r)
SELECT repo, path, rank, 0.5::DOUBLE AS risk_score, 'MEDIUM' AS risk_level, loc, cyclomatic_complexity,
  CAST(coalesce(cc, 1) AS BIGINT) AS commit_count,
  CAST(coalesce(dc, 1) AS BIGINT) AS contributor_count,
  concat('The XGBoost model assigned ', regexp_extract(path, '[^/]*$'),
    ' a 50% defect risk score primarily driven by ', CASE WHEN len(evidence) > 0 THEN array_to_string(evidence, ', and ')
    ELSE {quoted(C.GENERIC_EVIDENCE)} END, '. ', {quoted(C.EXPLANATION_CLOSE)}) AS ai_explanation,
  array_to_string({_ADVICE}, '; ') AS test_suggestions FROM e"""
_TOLD = """CASE WHEN len(phrases) > 0 THEN array_to_string(phrases, ', and ') WHEN len(evidence) > 0 THEN array_to_string(evidence, ', and ')
    ELSE GENERIC END""".replace("GENERIC", quoted(C.GENERIC_EVIDENCE))
#: All analysed files, by falling risk in their repository: from ``src`` and ``commits`` with their repositories and paths.
ANALYSED = f"""pick AS (SELECT * FROM src WHERE {_SUPPORTED}),
  full_files AS (SELECT * FROM pick WHERE regexp_matches(content, '[^{SP[1:-1]}]')), {lexical('full_files', 'doc_id')}, {explained()}, {FACTORS},
  n AS (SELECT doc_id, count(*) AS cc, greatest(1, count(DISTINCT author)) AS dc FROM commits GROUP BY 1),
  r AS (SELECT m.*, repo, path, cc, dc, {_RISK} AS risk, {tier(_RISK)} AS risk_level, raising,
      row_number() OVER (PARTITION BY repo ORDER BY {_RISK} DESC, path) AS rank
    FROM m JOIN full_files ON m.key = full_files.doc_id JOIN margin ON margin.key = m.key JOIN factors ON factors.key = m.key
    LEFT JOIN n ON n.doc_id = m.key),
  p AS (SELECT *, list_filter(list_transform(list_slice(raising, 1, 2), lambda x: {_PHRASE}), lambda x: x IS NOT NULL) AS phrases, list_filter([
     CASE WHEN cyclomatic_complexity > 10 THEN format('high cyclomatic complexity ({{:.1f}}) with deeply nested branches', cyclomatic_complexity) END,
     CASE WHEN loc > 300 THEN format('large file size ({{}} lines)', loc) END], lambda x: x IS NOT NULL) AS evidence FROM r),
  analysed AS (SELECT *, CAST(greatest(1, coalesce(cc, 1)) AS BIGINT) AS commit_count, CAST(greatest(1, coalesce(dc, 1)) AS BIGINT) AS contributor_count,
    CASE WHEN risk_level = 'LOW' THEN '' ELSE concat('The XGBoost model assigned ', regexp_extract(path, '[^/]*$'), ' a ',
      CAST(round_even(risk * 100, 0) AS BIGINT), '% defect risk score primarily driven by ', {_TOLD}, '. ', {quoted(C.EXPLANATION_CLOSE)}) END AS ai_explanation,
    CASE WHEN risk_level = 'LOW' THEN '' ELSE array_to_string({_ADVICE}, '; ') END AS test_suggestions FROM p)"""
ORACLE["flagship"] = f"""WITH {SRC}, {COMMITS}, {ANALYSED}
SELECT repo, path, rank, round(risk, 6) AS risk_score, risk_level, loc, cyclomatic_complexity, round(volume, 6) AS volume, language,
  commit_count, contributor_count, raising[1] AS factor_1, raising[2] AS factor_2, raising[3] AS factor_3, ai_explanation, test_suggestions FROM analysed"""
_REQUESTS = f"""rq AS (SELECT n_nationkey AS analysis_id, n_regionkey AS user_id, CASE WHEN n_nationkey = 21 THEN 'src0' ELSE concat('src', n_nationkey) END AS name,
    CASE WHEN n_nationkey % 6 = 0 THEN concat('https://github.com/own/src', n_nationkey) WHEN n_nationkey % 6 = 1 THEN concat('own/src', n_nationkey, '.git')
      WHEN n_nationkey % 6 = 2 THEN concat('github.com/own/src', n_nationkey) WHEN n_nationkey = 15 THEN 'nothing' WHEN n_nationkey = 21 THEN 'own/src0'
      ELSE concat('own/src', n_nationkey) END AS url FROM nation),
  whole AS (SELECT doc_id, repo, CASE WHEN repo = 'src9' THEN path || '.xyz' ELSE path END AS path,
    CASE WHEN repo = 'src7' THEN {_BLANK} ELSE content END AS content FROM src_all),
  src AS (SELECT * FROM whole WHERE repo IN (SELECT name FROM rq WHERE analysis_id <> 15)),
  {COMMITS}, {ANALYSED},
  g AS (SELECT repo, count(*) AS files, round(avg(risk), 12) AS overall_risk FROM analysed GROUP BY 1),
  listed AS (SELECT repo, count_if({_SUPPORTED}) AS supported FROM src GROUP BY 1),
  results AS (SELECT analysis_id, user_id, url, CASE WHEN analysis_id <> 15 THEN concat('own/', name) END AS repository_name,
    round(CASE WHEN analysis_id <> 15 THEN overall_risk END, 6) AS overall_risk, CASE WHEN analysis_id <> 15 AND overall_risk IS NOT NULL THEN {tier('overall_risk')} END AS risk_level,
    CAST(CASE WHEN analysis_id <> 15 THEN coalesce(files, 0) ELSE 0 END AS BIGINT) AS files,
    CASE WHEN analysis_id = 15 THEN 'Invalid repository address: nothing' WHEN coalesce(supported, 0) = 0 THEN {quoted(C.NO_SUPPORTED_FILES)}
      WHEN files IS NULL THEN {quoted(C.ALL_FILES_EMPTY)} END AS error
    FROM rq LEFT JOIN g ON g.repo = name LEFT JOIN listed ON listed.repo = name)"""
_SERVED = f"WITH {SRC.replace('src AS', 'src_all AS', 1)}, {_REQUESTS}"
ORACLE["repository_results"] = f"{_SERVED} SELECT * FROM results"
ORACLE["analyze_and_store"] = f"""{_SERVED} SELECT analysis_id, repository_name, overall_risk, results.risk_level AS repository_level, path AS file_path, rank,
  round(risk, 6) AS risk_score, analysed.risk_level, commit_count, contributor_count, ai_explanation, test_suggestions
FROM results JOIN analysed ON concat('own/', repo) = repository_name WHERE error IS NULL"""
ORACLE["repository_report"] = f"""WITH {SRC}, g AS (SELECT repo, count(*) AS files,
    round(avg(CAST(doc_id * 37 % 100 AS DOUBLE) / 100), 12) AS overall_risk FROM src GROUP BY 1)
SELECT repo, files, round(overall_risk, 6) AS overall_risk, {tier('overall_risk')} AS risk_level FROM g"""

ORACLE["top_files_by_size"] = f"""WITH {SRC}, s AS (SELECT repo, path, CASE WHEN doc_id % 6 <> 0 THEN size END AS size FROM src WHERE {_SUPPORTED})
SELECT repo, path, size, CAST(row_number() OVER (PARTITION BY repo ORDER BY coalesce(size, 0) DESC, path) AS INTEGER) AS size_rank FROM s
QUALIFY size_rank <= 25"""
ORACLE["rank_by_risk"] = f"""WITH {FILES} SELECT analysis_id, file_path, risk_score,
  row_number() OVER (PARTITION BY analysis_id ORDER BY risk_score DESC, file_path) AS rank FROM f"""

# --- evaluation ------------------------------------------------------------------------------------

_PLACED = f"""WITH {SPLIT}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('SEED:', id))) AS rank,
  count(*) OVER (PARTITION BY label) AS n FROM sr)"""
ORACLE["stratified_split"] = _PLACED.replace("SEED", str(C.SEED)) + f""" SELECT id, label,
  CASE WHEN rank <= floor(n * {C.TEST_SHARE} + 0.5) THEN 'test' ELSE 'dev' END AS part FROM r"""
ORACLE["stratified_folds"] = _PLACED.replace("SEED", str(C.SEED + 1)) + f""" SELECT id, label,
  CAST((rank - 1) % {C.N_FOLDS} AS INTEGER) AS fold FROM r"""

ORACLE["class_distribution"] = f"WITH {SCORED} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM s) * 100, 6) AS pct FROM s GROUP BY label"

ORACLE["feature_stats"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(median({c}), 4) AS median FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)

_THRESHOLDS = "th AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold)"


def _counts(t: str) -> str:
    return f"""CAST(count_if(NOT score >= {t} AND label = 0) AS BIGINT) AS tn, CAST(count_if(score >= {t} AND label = 0) AS BIGINT) AS fp,
  CAST(count_if(NOT score >= {t} AND label = 1) AS BIGINT) AS fn, CAST(count_if(score >= {t} AND label = 1) AS BIGINT) AS tp"""


_RATES = """(tp + tn) / (tn + fp + fn + tp) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1"))


def _sweep(by: str) -> str:
    return f"""WITH {SCORED}, {_THRESHOLDS}, c AS (SELECT {by}, threshold, {_counts('threshold')} FROM s, th GROUP BY ALL),
x AS (SELECT *, {_RATES} FROM c)"""


ORACLE["threshold_sweep"] = f"{_sweep('model')} SELECT model, round(threshold, 6) AS threshold, tn, fp, fn, tp, {_ROUNDED} FROM x"
ORACLE["best_threshold"] = f"""{_sweep('model, fold')} SELECT model, fold, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM x
QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY round(f1, 12) DESC, threshold) = 1"""
ORACLE["classification_metrics"] = f"""WITH {SCORED}, c AS (SELECT model, fold, {_counts('0.5')} FROM s GROUP BY ALL),
x AS (SELECT *, {_RATES} FROM c) SELECT model, fold, {_ROUNDED} FROM x"""
ORACLE["confusion_matrix"] = f"WITH {SCORED} SELECT model, fold, {_counts('0.7')} FROM s GROUP BY ALL"


def _ranking(by: str, source: str) -> str:
    """AUC from average ranks of the positives; average precision from whole-table running counts."""
    return f"""k AS (SELECT {by}, score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY ALL),
  w AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY score) - (n - 1) / 2 AS mean_rank,
    sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS pos_above, sum(n) OVER (PARTITION BY {by} ORDER BY score DESC) AS n_above FROM k),
  q AS (SELECT {by}, (sum(pos * mean_rank) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))) AS roc_auc,
    sum(pos * pos_above / n_above) / sum(pos) AS pr_auc FROM w GROUP BY ALL)"""


ORACLE["roc_auc"] = f"WITH {SCORED}, {_ranking('model, fold', 's')} SELECT model, fold, round(roc_auc, 6) AS roc_auc FROM q"
ORACLE["average_precision"] = f"WITH {SCORED}, {_ranking('model, fold', 's')} SELECT model, fold, round(pr_auc, 6) AS pr_auc FROM q"
ORACLE["brier"] = f"WITH {SCORED} SELECT model, fold, round(avg((score - label) * (score - label)), 6) AS brier FROM s GROUP BY ALL"
ORACLE["cv_summary"] = f"""WITH {SCORED}, {_ranking('model, fold', 's')}, c AS (SELECT model, fold, {_counts('0.5')},
  avg((score - label) * (score - label)) AS brier FROM s GROUP BY ALL), x AS (SELECT *, {_RATES} FROM c)
SELECT model, """ + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")
) + " FROM x JOIN q USING (model, fold) GROUP BY model"
ORACLE["calibration_bins"] = f"""WITH {SCORED} SELECT model, least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n,
  round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS observed_rate FROM s GROUP BY ALL"""

ORACLE["baseline_majority"] = f"""WITH {SPLIT}, b AS (SELECT avg(label) AS share FROM sr),
s AS (SELECT 'majority' AS model, label, CASE WHEN share > 0.5 THEN 1.0::DOUBLE ELSE 0 END AS score FROM sr, b
  UNION ALL SELECT 'random', label, CASE WHEN CAST(('0x' || substr(md5(concat('{C.SEED}:', id)), 1, 8)) AS BIGINT) / 4294967296::DOUBLE < share
    THEN 1 ELSE 0 END FROM sr, b),
{_ranking('model', 's')}, c AS (SELECT model, {_counts('0.5')}, avg((score - label) * (score - label)) AS brier FROM s GROUP BY ALL),
x AS (SELECT *, {_RATES} FROM c)
SELECT model, tn, fp, fn, tp, {_ROUNDED}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier
FROM x JOIN q USING (model)"""

# --- training: what SQL knows of it, the rows, their parts and folds, statistics and counts of entries -----------------

_DEV = f"""{LABELLED}, {lexical('lab', 'doc_id')},
rows AS (SELECT doc_id, CAST(label AS INTEGER) AS label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('{C.SEED}:', doc_id))) AS rank,
  count(*) OVER (PARTITION BY label) AS n FROM lab),
dev AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('{C.SEED + 1}:', doc_id))) AS rank FROM rows
  WHERE rank > floor(n * 0.2 + 0.5)),
test AS (SELECT doc_id, label FROM rows WHERE rank <= floor(n * 0.2 + 0.5))"""
ORACLE["model_roundtrip"] = f"WITH {LABELLED} SELECT doc_id, true AS same_score, 0.5::DOUBLE AS default_score FROM lab"
ORACLE["oof_scores"] = f"WITH {_DEV} SELECT doc_id, label, CAST((rank - 1) % 5 AS INTEGER) AS fold, true AS scored FROM dev"
ORACLE["holdout_eval"] = f"""WITH {_DEV}, c AS (SELECT CAST(count_if(label = 0) AS BIGINT) AS negatives, CAST(count_if(label = 1) AS BIGINT) AS positives FROM test)
SELECT 'standard' AS at, negatives, positives, 0.5::DOUBLE AS given_threshold, true AS in_range FROM c
UNION ALL SELECT 'best', negatives, positives, NULL, true FROM c"""
_STATS = " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS feature_order, '{f}' AS name, {quoted(C.SCALING_BOUNDS[f][2])} AS description,
  {C.SCALING_BOUNDS[f][0]}::DOUBLE AS bound_min, {C.SCALING_BOUNDS[f][1]}::DOUBLE AS bound_max, round(min(x), 6) AS min, round(max(x), 6) AS max,
  round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(median(x), 6) AS median, true AS shares FROM (SELECT {_scaled(f)} AS x FROM m)"""
    for i, f in enumerate(C.FEATURES)
)
ORACLE["feature_schema"] = ORACLE["write_artifacts"] = f"WITH {LABELLED}, {lexical('lab', 'doc_id')} {_STATS}"
ORACLE["model_info"] = f"""WITH {_DEV}
SELECT 'metadata' AS part, CAST(1 AS INTEGER) AS entries, (SELECT count(*) FROM dev) AS training_rows, (SELECT count(*) FROM test) AS test_rows,
  (SELECT count(*) FROM rows) AS total_rows, CAST(100 AS INTEGER) AS trees
UNION ALL SELECT 'metrics', 16, NULL, NULL, NULL, NULL UNION ALL SELECT 'holdout', 2, NULL, NULL, NULL, NULL"""
ORACLE["artifact_checks"] = f"""WITH stats AS ({ORACLE["feature_schema"]})
SELECT unnest(['ten features in order', 'median between minimum and maximum', 'values within 0 and 1', 'bounds in order',
  'metadata names the same features', 'threshold within 5 and 95 hundredths', 'rows add up', 'every measure is there',
  'measures within 0 and 1', 'thresholds are distinct']) AS "check", true AS holds
UNION ALL SELECT 'deviations above 0', bool_and(std > 0) FROM stats"""

_VARIANT = ", ".join(f"CASE WHEN feature = '{f}' THEN s{i}.{f} ELSE o.{f} END AS {f}" for i, f in enumerate(C.FEATURES))
_SENT = " ".join(f"JOIN placed s{i} ON (s{i}.at * (SELECT a FROM keyed WHERE i = {i}) + (SELECT b FROM keyed WHERE i = {i})) % n.n = o.at" for i in range(len(C.FEATURES)))
ORACLE["permutation_importance"] = f"""WITH {LABELLED}, {lexical('lab', 'doc_id')},
placed AS (SELECT row_number() OVER (ORDER BY md5(concat('{C.SEED}:', key))) - 1 AS at, CAST(label AS INTEGER) AS label,
  {", ".join(f"{_scaled(f)} AS {f}" for f in C.FEATURES)} FROM m JOIN lab ON doc_id = key),
n AS (SELECT count(*) AS n FROM lab),
tried AS (SELECT i, k, (greatest(1, (2 * i + 3) * (n // 7 + 1) % n) - 1 + k) % n + 1 AS a, greatest(1, ({C.SEED} + 101 * (i + 1)) % n) AS b, n
  FROM n, (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 1000)) AS k)),
keyed AS (SELECT i, arg_min(a, k) AS a, any_value(b) AS b FROM tried WHERE gcd(a, n) = 1 GROUP BY i),
variants AS (SELECT concat(feature, ':', o.at) AS key, feature AS of, o.label, {_VARIANT}
  FROM placed o CROSS JOIN n {_SENT} CROSS JOIN (SELECT unnest({values(["none", *C.FEATURES])}) AS feature)),
{explained('variants', lambda f: f)}, s AS (SELECT of, label, raw AS score FROM variants JOIN margin USING (key)),
{_ranking('of', 's')}, intact AS (SELECT roc_auc AS auc FROM q WHERE of = 'none')
SELECT of AS feature, round(auc, 6) AS intact_auc, round(roc_auc, 6) AS roc_auc, round(auc - roc_auc, 6) AS importance FROM q, intact WHERE of <> 'none'"""
