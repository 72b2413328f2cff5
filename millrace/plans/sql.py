"""DuckDB SQL for the registered queries, written apart from the Spark expressions."""

from __future__ import annotations

from ..functions import text
from ..operators import extract, rules
from .fixtures import SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(items: list[str]) -> str:
    return "(" + ", ".join(map(_q, items)) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def simple(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'), ' .;:')"


def cleaned(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' OR {simple(s)} IN {_in(text.EMPTY_WORDS)} OR " + " OR ".join(f"starts_with({simple(s)}, {_q(p)})" for p in text.MISSING_PREFIXES) + f" THEN NULL ELSE {s} END)"


def norm(x: str) -> str:
    return f"coalesce({simple(cleaned(x))}, '')"


def shown(x: str) -> str:
    """'' where scoring counts a value as missing."""
    return f"(CASE WHEN {x} IS NULL OR {simple(strip(x))} IN {_in(text.MISSING_PHRASES)} THEN '' ELSE {strip(x)} END)"


def comparable(x: str) -> str:
    """Marks become spaces after their letters, as decomposition and the pattern have it."""
    y = f"lower({shown(x)})"
    for marked, plain in zip("àâäáãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc", strict=True):
        y = f"replace({y}, '{marked}', '{plain} ')"
    y = f"replace(replace(replace({y}, '–', '-'), '—', '-'), '&', ' and ')"
    return f"trim(regexp_replace(regexp_replace({y}, 'https?://', '', 'g'), '[^a-z0-9@.$%:/+-]+', ' ', 'g'), ' ')"


def with_(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL.get(n, n) for n in names) + "\n"


def rounded(x: str, digits: int) -> str:
    """By the binary value, halves to even."""
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def pct(part: str, whole: str, default: str) -> str:
    return rounded(f"coalesce({part} / nullif({whole}, 0) * 100, {default})", 2)


_F1 = """CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) = 0 THEN 0.0
  ELSE 2 * (len(list_intersect(a, b)) / len(b)) * (len(list_intersect(a, b)) / len(a)) / (len(list_intersect(a, b)) / len(b) + len(list_intersect(a, b)) / len(a)) END"""
_LONG = _in([n for n, long in rules.FIELDS if long])
NORMALS = f"normals AS (SELECT *, {comparable('expected')} AS e, {comparable('predicted')} AS p FROM cells)"
TOKENS = "toks AS (SELECT *, list_distinct(regexp_extract_all(e, '[a-z0-9@.$%+-]+')) AS a, list_distinct(regexp_extract_all(p, '[a-z0-9@.$%+-]+')) AS b FROM normals)"
F1 = f"f1 AS (SELECT *, {_F1} AS token_f1 FROM toks)"
_NUMBER = r"'\b\d+(?:\.\d+)?\b'"
SIMILAR = f"""similar_ AS (SELECT *, CASE WHEN e = '' AND {shown('expected')} = '' THEN CASE WHEN {shown('predicted')} = '' THEN 1.0 ELSE 0.0 END
  WHEN {shown('predicted')} = '' THEN 0.0 WHEN e = p THEN 1.0
  WHEN field = {_q(rules.CONTACT)} AND len(regexp_extract_all(expected, {_q(text.EMAIL)})) > 0
   AND list_has_all(regexp_extract_all(predicted, {_q(text.EMAIL)}), regexp_extract_all(expected, {_q(text.EMAIL)})) THEN 1.0
  WHEN field = {_q(rules.REFERENCES)} AND regexp_extract_all(e, {_NUMBER})[1] = regexp_extract_all(p, {_NUMBER})[1] THEN 1.0
  ELSE token_f1 END AS similarity FROM f1)"""
RUNS = f"""scored AS (SELECT *, similarity >= CASE WHEN field IN {_LONG} THEN 0.45 ELSE 0.70 END AS is_correct, {shown('expected')} = '' AS no_e, {shown('predicted')} = '' AS no_p FROM similar_),
runs AS (SELECT rfp_no, model, count(*) AS fields_total, count(*) FILTER (is_correct) AS fields_correct, count(*) FILTER (no_e) AS gt_null_fields,
  count(*) FILTER (no_e AND NOT no_p) AS hallucinated_null_fields, count(*) FILTER (NOT no_e) AS expected_nonmissing_fields,
  count(*) FILTER (NOT no_e AND NOT no_p) AS expected_found_fields, count(*) FILTER (NOT no_e AND no_p) AS omitted_expected_fields,
  count(*) FILTER (NOT no_e AND NOT no_p AND NOT is_correct) AS wrong_value_fields, avg(similarity) AS mean FROM scored GROUP BY rfp_no, model),
rated AS (SELECT rfp_no, model, {pct('fields_correct', 'fields_total', '0.0')} AS field_accuracy_pct, {rounded('mean * 100', 2)} AS avg_field_similarity_pct,
  {pct('expected_found_fields', 'expected_nonmissing_fields', '100.0')} AS completeness_pct, {pct('hallucinated_null_fields', 'gt_null_fields', '0.0')} AS hallucination_rate_pct,
  {pct('wrong_value_fields', 'expected_nonmissing_fields', '0.0')} AS wrong_value_rate_pct, fields_total, fields_correct, gt_null_fields, hallucinated_null_fields,
  expected_nonmissing_fields, expected_found_fields, omitted_expected_fields, wrong_value_fields FROM runs)"""
ALL_RUNS = ("lines", "cells", NORMALS, TOKENS, F1, SIMILAR, RUNS)
_MEANS = ["field_accuracy_pct", "avg_field_similarity_pct", "completeness_pct", "hallucination_rate_pct", "wrong_value_rate_pct"]
SUMMARY = "summary AS (SELECT model, count(*) AS rfps_evaluated, " + ", ".join(f"{rounded(f'avg({m})', 2)} AS {m}" for m in _MEANS) + " FROM rated GROUP BY model)"
CHUNKS = rf"""whole AS (SELECT doc_id, {strip("coalesce(text, '')")} AS t FROM documents),
step(doc_id, t, st, en) AS (
  SELECT doc_id, t, 0, CASE WHEN length(t) <= 8000 THEN length(t) ELSE cut END FROM (SELECT doc_id, t, {{cut0}} AS cut FROM whole WHERE t <> '')
  UNION ALL
  SELECT doc_id, t, nx, CASE WHEN nx + 8000 >= length(t) THEN length(t) ELSE {{cut1}} END FROM (SELECT doc_id, t, en - 150 AS nx FROM step WHERE en < length(t))),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS chunk_no, st, en, {strip('substring(t, st + 1, en - st)')} AS chunk_text FROM step
  WHERE {strip('substring(t, st + 1, en - st)')} <> '')"""


def _cut(at: str) -> str:
    window = f"substring(t, {at} + 6801, 1200)"
    last = lambda mark, n: f"length(regexp_extract({window}, '(?s)^(.*){mark}', 1))"
    return rf"CASE WHEN contains({window}, chr(10) || chr(10)) THEN {at} + 6800 + {last(chr(92) + 'n' + chr(92) + 'n', 2)} WHEN contains({window}, chr(10)) THEN {at} + 6800 + {last(chr(92) + 'n', 1)} ELSE {at} + 8000 END"


CHUNKS = CHUNKS.replace("{cut0}", _cut("0")).replace("{cut1}", _cut("nx"))


def halves(x: str, source: str, keys: str) -> str:
    """CTEs that give halved(keys, part_no, half)."""
    return rf"""measured AS (SELECT {keys}, {x} AS c, length({x}) AS n, length({x}) // 2 AS mid FROM {source}),
reach AS (SELECT *, least(800, mid) AS r FROM measured),
sides AS (SELECT *, substring(c, mid - r + 1, r) AS before, substring(c, mid + 1, least(r, n - mid)) AS after FROM reach),
cuts AS (SELECT *, CASE WHEN contains(before, chr(10)) THEN mid - r + length(regexp_extract(before, '(?s)^(.*)\n', 1))
  WHEN contains(after, chr(10)) THEN mid + strpos(after, chr(10)) - 1 ELSE mid END AS cut FROM sides),
halved AS (SELECT {keys}, unnest(range(len(h))) AS part_no, unnest(h) AS half FROM (SELECT {keys}, CASE WHEN n < 2000 THEN [c] ELSE
  list_filter([{strip('substring(c, 1, cut)')}, {strip('substring(c, greatest(0, cut - 100) + 1)')}], lambda p: p <> '') END AS h FROM cuts))"""


def heading(value: str) -> str:
    v = norm(value)
    return f"({v} = '' OR (length({v}) <= 90 AND ({' OR '.join(f'contains({v}, {_q(t)})' for t in text.HEADINGS)}) AND NOT regexp_matches({v}, {_q(text.HEADING_DETAIL)})))"


def reference(value: str) -> str:
    v = norm(value)
    words = " ".join(rf"WHEN regexp_matches({v}, '\b{w}\b') THEN '{i}'" for i, w in enumerate(text.NUMBER_WORDS, 1))
    return rf"coalesce(nullif(regexp_extract({v}, '\b(\d+)\b', 1), ''), CASE {words} END)"


def score_sql(rule_set: str) -> str:
    """CASE over fields of columns value, v, comb."""
    sets, least = rules.RULE_SETS[rule_set]
    some = lambda on, terms: "(" + " OR ".join(f"contains({on}, {_q(t)})" for t in terms) + ")"
    tests = {
        rules.PERCENT: r"regexp_matches(value, '[0-9]\s*%') AND regexp_matches(value, '(^|[^a-zA-Z0-9_])[0-9]+([.][0-9]+)?\s*%')",
        rules.POINTS: r"regexp_matches(lower(value), '(^|[^a-z0-9_])[0-9]+([.][0-9]+)?\s*(point|points|pt|pts)($|[^a-z0-9_])')",
        rules.AMOUNT: r"regexp_matches(value, '[$]\s*[0-9,]')",
        rules.TWO_NUMBERS: r"len(regexp_extract_all(value, '\b[0-9]+([.][0-9]+)?\b')) > 1",
        text.EMAIL: r"regexp_matches(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z][A-Za-z]+')",
    }
    match = lambda ps: "(" + " OR ".join(f"({tests[p]})" for p in ps) + ")"
    branches = []
    for name, rule in sets.items():
        score, no = ["1.0"], []
        for step in rule:
            k, a = step[0], step[1:]
            if k == "any":
                score.append(f"CASE WHEN {some('v' if len(a) > 2 else 'comb', a[0])} THEN {a[1]} ELSE 0 END")
            elif k == "each":
                score += [f"CASE WHEN contains(comb, {_q(t)}) THEN {a[1]} ELSE 0 END" for t in a[0]]
            elif k == "plus":
                score.append(str(a[0]))
            elif k == "match":
                score.append(f"CASE WHEN {match(a[0])} THEN {a[1]} ELSE 0 END")
            elif k == "short":
                score.append(f"CASE WHEN length(v) <= {a[0]} THEN {a[1]} ELSE 0 END")
            elif k == "either":
                score.append(f"CASE WHEN {some('comb', a[0])} THEN {a[1]} ELSE {a[3]} END")
                no.append(f"NOT {some('comb', a[0])} AND v NOT IN {_in(a[2])}")
            elif k == "need":
                no.append(f"NOT {some('comb', a[0])}")
            elif k == "heading":
                no.append(heading("value"))
            elif k == "above":
                no.append(f"{' + '.join(score)} <= {a[0]}")
            elif k == "need_match":
                no.append(f"NOT {match(a[0])}")
            elif k == "long":
                no.append(f"length(v) < {a[0]}")
            elif k == "count":
                no.append(f"{reference('value')} IS NULL")
            elif k == "unless":
                no.append(f"{some('comb', a[0])} AND NOT contains(comb, {_q(a[1])})")
        branches.append(f"WHEN {_q(name)} THEN " + (f"CASE WHEN {' OR '.join(f'({n})' for n in no)} THEN NULL ELSE {' + '.join(score)} END" if no else " + ".join(score)))
    return f"CASE WHEN length(v) < {least} THEN NULL ELSE (CASE field {' '.join(branches)} ELSE 1.0 END) + CASE WHEN length(v) <= 500 THEN 0.5 ELSE 0 END END"


TOP = f"""normed AS (SELECT *, {norm('value')} AS v FROM candidates),
firsts AS (SELECT * FROM normed WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY rfp_no, field, v ORDER BY line_no) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY rfp_no, field ORDER BY line_no) AS idx FROM firsts QUALIFY idx <= 4)"""


def scored_top(rule_set: str) -> str:
    return f"{TOP},\nready AS (SELECT * REPLACE ({cleaned('value')} AS value), v || ' ' || {norm('excerpt')} AS comb FROM top),\nmarked AS (SELECT *, CAST({score_sql(rule_set)} AS DOUBLE) AS score FROM ready)"


LEVELS = f"""sums AS (SELECT model, concurrency, count(*) AS requests_total, count(*) FILTER (success) AS requests_successful, count(*) FILTER (NOT success) AS requests_failed,
  coalesce(avg(latency_s) FILTER (success), 0) AS mean, coalesce(quantile_cont(latency_s, 0.95) FILTER (success), 0) AS p95,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall FROM jobs GROUP BY model, concurrency),
full_levels AS (SELECT model, concurrency, requests_total, requests_successful, requests_failed, {rounded('mean', 4)} AS avg_latency_s, {rounded('p95', 4)} AS p95_latency_s,
  {rounded('wall', 4)} AS total_test_time_s, {pct('requests_successful', 'requests_total', '0')} AS success_rate_pct,
  {rounded('coalesce(requests_successful / nullif(wall, 0) * 60, 0)', 2)} AS throughput_requests_per_min FROM sums)"""
_LEVEL_COLUMNS = ["model", "concurrency", "requests_total", "requests_successful", "requests_failed", "success_rate_pct", "avg_latency_s", "p95_latency_s", "total_test_time_s", "throughput_requests_per_min"]
#: Expected values against runs: cells under the names that the scores read.
_CELLS = "cells AS (SELECT t.rfp AS rfp_no, a.model, t.field, t.expected, CASE WHEN given THEN value END AS predicted FROM truth t JOIN answers a ON a.rfp = t.rfp AND a.field = t.field)"
_TAKEN = "coalesce(time_seconds, 0) AS latency_seconds, prompt_tokens, completion_tokens, total_tokens, chunks_total, chunks_successful, coalesce(raw_json_valid_rate, 0) AS raw_json_valid_pct, json_valid_after_cleanup_rate AS json_after_cleanup_pct"
ROWS = f"run_rows AS (SELECT r.rfp_no AS rfp, r.* EXCLUDE (rfp_no), {_TAKEN} FROM rated r JOIN runs_ u ON u.rfp = r.rfp_no AND u.model = r.model)"
ALL_ROWS = ("truth", "runs", "runs_ AS (SELECT * FROM runs)", _CELLS, NORMALS, TOKENS, F1, SIMILAR, RUNS.replace("runs AS (SELECT", "counts AS (SELECT").replace("FROM runs)", "FROM counts)"), ROWS)
MEANS = "means AS (SELECT model, count(*) AS rfps_evaluated, " + ", ".join(f"{rounded(f'avg({m})', 2)} AS {n}" for m, n in [*((m, m) for m in _MEANS), ("latency_seconds", "avg_latency_seconds"), ("raw_json_valid_pct", "raw_json_valid_pct"), ("json_after_cleanup_pct", "json_after_cleanup_pct")]) + f", CAST({rounded('avg(total_tokens)', 0)} AS BIGINT) AS avg_total_tokens FROM run_rows GROUP BY model)"
#: Of each chunk's and half's last and first word as answers: the first of each distinct one, up to four, and the excerpt's end.
COLLECTED = (
    "parts AS (SELECT doc_id, chunk_no, 0 AS part_no, chunk_text AS t FROM chunks WHERE (doc_id + chunk_no) % 3 <> 0 UNION ALL SELECT doc_id, chunk_no, part_no + 1, half FROM halved)",
    "said AS (SELECT doc_id, chunk_no, part_no, t, unnest([0, 2]) AS pos, unnest([string_split(t, ' ')[-1], string_split(t, ' ')[1]]) AS said FROM parts)",
    f"normed AS (SELECT *, {cleaned('said')} AS value, {norm('said')} AS v FROM said)",
    "firsts AS (SELECT * FROM normed WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, v ORDER BY chunk_no, part_no, pos) = 1)",
    "four AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, part_no, pos) AS idx, length(t) AS n FROM firsts QUALIFY idx <= 4)",
    "words AS (SELECT *, regexp_extract_all(lower(value), '[a-z0-9@.$%+-]{4,}') AS w0 FROM four)",
    "places AS (SELECT *, coalesce(list_min(list_filter(list_transform(list_filter(w0, lambda x, i: list_position(w0, x) = i)[1:10], lambda x: strpos(lower(t), x)), lambda p: p > 0)) - 1, nullif(strpos(lower(t), 'summary'), 0) - 1, n // 2) AS centre FROM words)",
    "reach2 AS (SELECT *, least(n, greatest(0, centre - 450) + 900) AS e FROM places)",
)
_KEEP = "regexp_replace({}, '[^0-9]', '', 'g')"

#: The offline backend's answer to a chunk is its first line, as the summary.
_LINE = r"""candidates AS (SELECT doc_id AS rfp_no, chunk_no AS line_no, 'Summary' AS field, '' AS excerpt,
  regexp_replace(replace(replace(string_split(chunk_text, chr(10))[1], chr(92), ' '), '"', ''''), '[\x00-\x1F]', '', 'g') AS value FROM chunks)"""
_STUB = (
    with_(CHUNKS, _LINE, scored_top("v5"), recursive=True)
    + f"""SELECT d.doc_id AS rfp, 'stub' AS model, '{{' || string_agg(to_json(f.field) || ':' || to_json(coalesce(b.value, 'Not Specified')), ',' ORDER BY f.n) || '}}' AS json
FROM documents d CROSS JOIN (SELECT unnest([{', '.join(map(_q, rules.NAMES))}]) AS field, unnest(range({len(rules.NAMES)})) AS n) f
LEFT JOIN (SELECT * FROM marked WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rfp_no ORDER BY score DESC, idx) = 1) b ON b.rfp_no = d.doc_id AND b.field = f.field GROUP BY d.doc_id"""
)

ORACLES = {
    "q_extract_stub": _STUB,
    "q_extract_logged": _STUB,
    "q_model_quality": with_(*ALL_RUNS, SUMMARY) + "SELECT * FROM summary",
    "q_run_scores": with_(*ALL_RUNS) + "SELECT * FROM rated",
    "q_model_summary_ordered": with_(*ALL_RUNS, SUMMARY) + "SELECT model, rfps_evaluated, field_accuracy_pct, CAST(row_number() OVER (ORDER BY model) AS INTEGER) AS place FROM summary",
    "q_missing": with_("lines", "cells") + f"SELECT model, count(*) AS cells, count(*) FILTER ({cleaned('predicted')} IS NULL) AS missing_extract, count(*) FILTER ({shown('predicted')} = '') AS missing_score, count(*) FILTER ({shown('expected')} = '') AS missing_expected FROM cells GROUP BY model",
    "q_clean_values": with_("lines", "cells") + f"SELECT rfp_no, line_no, {cleaned('predicted')} AS cleaned, {norm('predicted')} AS normal FROM cells",
    "q_normalize": with_("lines") + f"SELECT doc_id, line_no, {comparable('line')} AS normal FROM lines",
    "q_token_f1": with_("lines", "cells", NORMALS, TOKENS, F1) + "SELECT rfp_no, line_no, round(token_f1, 4) AS token_f1 FROM f1",
    "q_emails": f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_q(text.EMAIL)}))), ' ') AS emails FROM documents",
    "q_numbers": f"SELECT doc_id, len(n) AS n_numbers, n[1] AS first_number FROM (SELECT doc_id, regexp_extract_all({comparable('text')}, {_NUMBER}) AS n FROM documents)",
    "q_keyword_tokens": "SELECT doc_id, len(k) AS n_keywords, md5(array_to_string(list_sort(k), ' ')) AS keywords FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9@.$%+-]{4,}')) AS k FROM documents)",
    "q_chunks": with_(CHUNKS, recursive=True) + "SELECT doc_id, chunk_no, length(chunk_text) AS n_chars, md5(chunk_text) AS digest FROM chunks",
    "q_chunk_stats": with_(CHUNKS, recursive=True) + "SELECT d.source, count(*) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chars FROM chunks c JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.source",
    "q_split_failed": with_(halves("text", "documents", "doc_id")) + "SELECT doc_id, part_no, md5(half) AS digest FROM halved",
    "q_recovery": with_(CHUNKS, "failed AS (SELECT * FROM chunks WHERE (doc_id + chunk_no) % 3 = 0 AND length(chunk_text) >= 2000)", halves("chunk_text", "failed", "doc_id, chunk_no"), recursive=True)
    + "SELECT doc_id, chunk_no, 0 AS part_no, length(chunk_text) AS n_chars FROM chunks UNION ALL SELECT doc_id, chunk_no, part_no + 1, length(half) FROM halved",
    "q_excerpts": with_(f"""parts AS (SELECT doc_id, text AS t, lower(text) AS lt, length(text) AS n, string_split(text, chr(10))[-1] AS value, [{', '.join(map(_q, rules.NAMES))}][doc_id % 24 + 1] AS field FROM documents),
words AS (SELECT *, regexp_extract_all(lower(value), '[a-z0-9@.$%+-]{{4,}}') AS w0, regexp_extract_all(lower(field), '[a-z0-9@.$%+-]{{4,}}') AS f0 FROM parts),
firsts AS (SELECT *, list_filter(w0, lambda x, i: list_position(w0, x) = i)[1:10] AS w, list_filter(f0, lambda x, i: list_position(f0, x) = i)[1:5] AS f FROM words),
places AS (SELECT *, coalesce(list_min(list_filter(list_transform(w, lambda x: strpos(lt, x)), lambda p: p > 0)) - 1, list_min(list_filter(list_transform(f, lambda x: strpos(lt, x)), lambda p: p > 0)) - 1, n // 2) AS centre FROM firsts),
ends AS (SELECT *, least(n, greatest(0, centre - 450) + 900) AS e FROM places)""")
    + f"SELECT doc_id, md5(CASE WHEN n <= 900 THEN {strip('t')} ELSE {strip('substring(t, greatest(0, e - 900) + 1, 900)')} END) AS digest FROM ends",
    "q_heading_reference": with_("lines") + f"SELECT doc_id, line_no, {heading('line')} AS heading_only, {reference('line')} AS reference_count FROM lines",
    "q_json_valid": with_("responses") + "SELECT event_id, coalesce(CASE WHEN json_valid(trim(raw)) THEN json_type(trim(raw)) = 'OBJECT' ELSE false END, false) AS raw_ok, event_id % 6 <> 3 AS cleaned_ok FROM responses",
    "q_json_entries": "SELECT event_id, 0 AS pos, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 6 <> 3",
    "q_run_metrics": """WITH a AS (SELECT event_id // 30 AS rfp, 'm' || (event_id // 30 % 3) AS model, event_id // 3 AS chunk_no, event_id % 3 AS part_no, (event_id + event_id // 4) % 6 AS k, length(props) AS p, event_id % 100 AS c FROM events),
chunks AS (SELECT rfp, model, chunk_no, coalesce(bool_or(k <> 3) FILTER (part_no = 0), false) OR coalesce(bool_and(k <> 3) FILTER (part_no > 0), false) AS good, count(*) FILTER (part_no = 0) AS n,
  count(*) FILTER (part_no = 0 AND k = 0) AS raw, count(*) FILTER (part_no = 0 AND k <> 3) AS ok, sum(p) AS p, sum(c) AS c FROM a GROUP BY ALL)
SELECT rfp, model, count(*) FILTER (good) > 0 AS success, CAST(sum(n) AS BIGINT) AS chunks_total, count(*) FILTER (good) AS chunks_successful, """ + pct("sum(raw)", "sum(n)", "0") + " AS raw_json_valid_rate, " + pct("sum(ok)", "sum(n)", "0") + """ AS json_valid_after_cleanup_rate,
  CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p) + sum(c) AS BIGINT) AS total_tokens FROM chunks GROUP BY rfp, model HAVING sum(n) > 0""",
    "q_candidates_top4": with_("lines", "candidates", TOP) + "SELECT rfp_no, field, idx, value FROM top",
    "q_rule_score_v5": with_("lines", "candidates", scored_top("v5")) + "SELECT rfp_no, field, idx, score FROM marked",
    "q_rule_score_capacity": with_("lines", "candidates", scored_top("capacity")) + "SELECT rfp_no, field, idx, score FROM marked",
    "q_select_final": with_("lines", "candidates", scored_top("v5"))
    + f"""SELECT d.doc_id AS rfp_no, f.field, coalesce(CASE WHEN f.field = {_q(rules.REFERENCES)} THEN coalesce({reference('b.value')}, b.value) ELSE b.value END, 'Not Specified') AS value
FROM documents d CROSS JOIN (SELECT unnest([{', '.join(map(_q, rules.NAMES))}]) AS field) f LEFT JOIN (SELECT * FROM marked WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rfp_no, field ORDER BY score DESC, idx) = 1) b
ON b.rfp_no = d.doc_id AND b.field = f.field""",
    "q_upsert": """SELECT source, coalesce(b.n, a.n) AS n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) a
LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) b USING (source)""",
    "q_run_matrix": "SELECT d.source, m.model, count(*) AS runs FROM documents d CROSS JOIN (SELECT DISTINCT event_type AS model FROM events) m GROUP BY d.source, m.model",
    "q_capacity_levels": with_("jobs", LEVELS) + "SELECT * FROM full_levels",
    "q_capacity_overview": with_("jobs", LEVELS) + "SELECT " + pct("sum(requests_successful)", "sum(requests_total)", "0") + " AS overall_success_pct, CAST(sum(requests_total) AS BIGINT) AS requests, max(throughput_requests_per_min) AS max_throughput, min(avg_latency_s) AS min_avg_latency, max(p95_latency_s) AS max_p95, max(concurrency) AS max_concurrency FROM full_levels",
    "q_peak_per_model": with_("jobs", LEVELS) + "SELECT model, concurrency, throughput_requests_per_min FROM full_levels QUALIFY row_number() OVER (PARTITION BY model ORDER BY throughput_requests_per_min DESC, concurrency) = 1",
    "q_extreme_levels": with_("jobs", LEVELS) + "SELECT * FROM (SELECT 'max' AS kind, model, concurrency, throughput_requests_per_min AS value FROM full_levels ORDER BY value DESC, model, concurrency LIMIT 1) UNION ALL (SELECT 'min', model, concurrency, throughput_requests_per_min AS value FROM full_levels ORDER BY value, model, concurrency LIMIT 1)",
    "q_resume_plan": with_("jobs", LEVELS) + "SELECT model, concurrency FROM full_levels WHERE NOT success_rate_pct >= 90",
    "q_completed_levels": with_("jobs", LEVELS) + "SELECT model, array_to_string(list_sort(list_distinct(list(concurrency))), ',') AS completed FROM full_levels WHERE success_rate_pct >= 90 GROUP BY model",
    "q_job_plan": with_("jobs", LEVELS) + "SELECT model, concurrency, job_id, job_id % (SELECT count(*) FROM documents) AS doc_no FROM (SELECT model, concurrency, unnest(range(concurrency)) AS job_id FROM full_levels)",
    "q_gauges": with_(*ALL_RUNS, "last AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY model ORDER BY rfp_no DESC) = 1)") + " UNION ALL ".join(f"SELECT '{m}' AS metric, model, {m} AS value FROM last" for m in _MEANS),
    "q_melt_quality": with_(*ALL_RUNS, SUMMARY) + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {m} AS percent FROM summary" for m, n in (("field_accuracy_pct", "Field Accuracy"), ("avg_field_similarity_pct", "Field Similarity"), ("completeness_pct", "Completeness"))),
    "q_detail_by_rfp": with_(*ALL_RUNS) + "SELECT r.model, d.source, r.rfp_no, r.completeness_pct FROM rated r JOIN documents d ON d.doc_id = r.rfp_no WHERE r.model IN ('model0', 'model2') AND d.lang = 'en'",
    "q_natural_order": f"SELECT source AS name, coalesce(TRY_CAST(nullif({_KEEP.format('source')}, '') AS BIGINT), 999999) AS number FROM documents WHERE source IS NOT NULL GROUP BY source",
    "q_model_union": "SELECT DISTINCT event_type AS model FROM events UNION SELECT source FROM documents",
    "q_colours": "SELECT model, CAST((row_number() OVER (ORDER BY model) - 1) % 4 AS INTEGER) AS colour FROM (SELECT DISTINCT event_type AS model FROM events)",
    "q_chat_prompts": "SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) || '<|im_start|>assistant' || chr(10)) AS digest FROM conversations GROUP BY conv_id",
    "q_prompts": with_(CHUNKS, recursive=True) + f"SELECT doc_id, chunk_no, md5({_q(extract.PROMPT)} || chunk_text) AS digest FROM chunks",
    "q_windowed_throughput": "SELECT event_type AS model, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS jobs, round(avg(value), 4) AS mean_latency FROM events GROUP BY ALL",
    "q_text_files": "SELECT 'rfp' || doc_id || '.txt' AS rfp, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text ELSE '' END AS t FROM documents)",
    "q_results_file": with_("runs") + f"SELECT a.rfp, a.model, success, total_tokens + a.m AS total_tokens, time_seconds, i AS field_id, field, value FROM answers a JOIN runs r ON r.rfp = a.rfp AND r.model = a.model WHERE given",
    "q_runs_table": with_("runs") + "SELECT rfp, model, CASE WHEN model = 'model1' THEN 0 ELSE prompt_tokens END AS prompt_tokens, completion_tokens, success FROM runs",
    "q_truth_file": with_("truth") + "SELECT rfp, field, expected FROM truth",
    "q_expected_cells": with_("truth", "runs") + "SELECT t.rfp, a.model, t.field, t.expected, CASE WHEN given THEN value END AS predicted FROM truth t JOIN answers a ON a.rfp = t.rfp AND a.field = t.field",
    "q_run_rows": with_(*ALL_ROWS) + "SELECT * FROM run_rows",
    "q_model_means": with_(*ALL_ROWS, MEANS) + "SELECT * FROM means",
    "q_scores_csv": with_(*ALL_ROWS) + "SELECT rfp, model, field_accuracy_pct, avg_field_similarity_pct, completeness_pct, hallucination_rate_pct, wrong_value_rate_pct, CAST(fields_correct AS INTEGER) AS fields_correct, latency_seconds, total_tokens FROM run_rows",
    "q_capacity_files": with_("jobs", LEVELS) + f"SELECT kind, {', '.join(_LEVEL_COLUMNS)} FROM full_levels, (VALUES ('json'), ('csv')) k(kind)",
    "q_report_tables": with_("jobs", LEVELS) + "SELECT 'scores' AS name, 2 * count(*) AS n, 2 AS models FROM documents UNION ALL SELECT 'summary', 2, 2 UNION ALL SELECT 'capacity', count(*), count(DISTINCT model) FROM full_levels",
    "q_number_texts": "SELECT event_id, printf('%.2f', event_id / 8) AS percent, format('{:,}', event_id * 12345) AS thousands FROM events",
    "q_nested_values": """SELECT event_id, CAST(e.pos AS BIGINT) AS pos, e.key, e.value FROM (SELECT event_id, unnest([
  {'pos': 0, 'key': 'Budget', 'value': '{"a":[1,{"k":' || json_extract_string(props, '$.k') || '}]}'}, {'pos': 1, 'key': 'Summary', 'value': 'True'}, {'pos': 2, 'key': 'Issue Date', 'value': '[]'},
  {'pos': 3, 'key': 'Other', 'value': event_id || '.5'}, {'pos': 4, 'key': 'Start Date', 'value': NULL}]) AS e FROM events)""",
    "q_field_table": with_("runs") + "SELECT rfp, model, i AS field_id, field, value FROM answers WHERE given",
    "q_enabled_models": "SELECT source || '-' || lang AS model, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 GROUP BY ALL",
    "q_unknown_names": "SELECT doc_id FROM labels EXCEPT SELECT conv_id FROM conversations",
    "q_sorted_levels": with_("jobs", LEVELS) + "SELECT model, concurrency, row_number() OVER (ORDER BY model, concurrency) AS place FROM full_levels",
    "q_final_json": with_("lines", "candidates", scored_top("v5"))
    + f"""SELECT d.doc_id AS rfp_no, '{{' || string_agg(to_json(f.field) || ':' || to_json(coalesce(CASE WHEN f.field = {_q(rules.REFERENCES)} THEN coalesce({reference('b.value')}, b.value) ELSE b.value END, 'Not Specified')), ',' ORDER BY f.n) || '}}' AS json
FROM documents d CROSS JOIN (SELECT unnest([{', '.join(map(_q, rules.NAMES))}]) AS field, unnest(range({len(rules.NAMES)})) AS n) f LEFT JOIN (SELECT * FROM marked WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rfp_no, field ORDER BY score DESC, idx) = 1) b
ON b.rfp_no = d.doc_id AND b.field = f.field GROUP BY d.doc_id""",
    "q_gauge_lines": with_(*ALL_ROWS, "last AS (SELECT * FROM run_rows QUALIFY row_number() OVER (PARTITION BY model ORDER BY rfp DESC) = 1)")
    + " UNION ALL ".join(f"""SELECT '{m}{{model="' || model || '"}} ' || CAST({m} AS DOUBLE) AS line FROM last""" for m in ("field_accuracy_pct", "latency_seconds", "total_tokens")),
    "q_report_lines": with_(*ALL_ROWS, MEANS) + "SELECT row_number() OVER (ORDER BY model) AS place, model || ': accuracy=' || field_accuracy_pct || '% | completeness=' || completeness_pct || '% | hallucination=' || hallucination_rate_pct || '%' AS line FROM means",
    "q_run_report": with_(*ALL_ROWS) + "SELECT rfp, model || ': accuracy=' || field_accuracy_pct || '% | similarity=' || avg_field_similarity_pct || '% | completeness=' || completeness_pct || '% | hallucination=' || hallucination_rate_pct || '% | wrong-value=' || wrong_value_rate_pct || '%' AS line FROM run_rows",
    "q_level_report": with_("jobs", LEVELS) + "SELECT model, concurrency, 'success=' || success_rate_pct || '% | avg full-RFP latency=' || avg_latency_s || 's | p95=' || p95_latency_s || 's | throughput=' || throughput_requests_per_min || ' RFP/min' AS line FROM full_levels",
    "q_score_documents": with_(*ALL_ROWS) + "SELECT * FROM run_rows",
    "q_json_payload": with_("jobs", LEVELS)
    + """SELECT '{"configuration":{"test_type":"log"},"completed_concurrency_levels":[' || (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT concurrency AS c FROM full_levels)) || '],"summary":[' ||
  string_agg('{"model":"' || model || '","concurrency":' || concurrency || ',"requests_total":' || requests_total || ',"requests_successful":' || requests_successful || ',"requests_failed":' || requests_failed ||
  ',"avg_latency_s":' || avg_latency_s || ',"p95_latency_s":' || p95_latency_s || ',"total_test_time_s":' || total_test_time_s || ',"success_rate_pct":' || success_rate_pct ||
  ',"throughput_requests_per_min":' || throughput_requests_per_min || '}', ',' ORDER BY model, concurrency) || ']}' AS json FROM full_levels""",
    "q_upsert_repeats": "SELECT user_id, event_type, coalesce(max(event_id) FILTER (event_id % 2 = 0), max(event_id)) AS event_id, coalesce(arg_max(value, event_id) FILTER (event_id % 2 = 0), arg_max(value, event_id)) AS value FROM events GROUP BY user_id, event_type",
    "q_committed_levels": with_("jobs", LEVELS) + f"SELECT {', '.join(_LEVEL_COLUMNS)} FROM full_levels",
    "q_latest_gauges": with_("jobs") + "SELECT model, concurrency, job_id, latency_s AS value FROM jobs WHERE success QUALIFY row_number() OVER (PARTITION BY model, concurrency ORDER BY ts DESC, job_id DESC) = 1",
    "q_collected_candidates": with_(CHUNKS, "failed AS (SELECT * FROM chunks WHERE (doc_id + chunk_no) % 3 = 0 AND length(chunk_text) >= 2000)", halves("chunk_text", "failed", "doc_id, chunk_no"), *COLLECTED, recursive=True)
    + f"SELECT doc_id, 'Summary' AS field, idx, 'chunk ' || chunk_no || CASE WHEN part_no > 0 THEN '.' || part_no ELSE '' END AS source, value, md5(CASE WHEN n <= 900 THEN {strip('t')} ELSE {strip('substring(t, greatest(0, e - 900) + 1, 900)')} END) AS digest FROM reach2",
}
