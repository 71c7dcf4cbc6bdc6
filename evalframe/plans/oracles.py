"""The registered queries as SQL over the given tables, for checking."""

from __future__ import annotations

# Fixed values, written out again so that a slip in the operators' table shows.
SAFETY_CAPS = {"commits_total": 1_000_000, "commits_30d": 100_000, "lines_of_code": 10_000_000, "repo_stars": 1_000_000}
SOURCE_SUFFIXES = (".py", ".html", ".css", ".js", ".ts", ".tsx", ".jsx", ".md", ".json")
EXCLUDED_FOLDERS = (
    ".git", ".vercel", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", "dist", "build", ".idea",
)
LAST_PAGE_PATTERN = r'<[^>]*[?&]page=(\d+)[^>]*>;\s*rel="last"'

_ASOF = "TIMESTAMP '2001-08-01 00:00:00'"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"

_OBSERVED = """observed AS (
  SELECT CAST(user_id % 20 AS BIGINT) AS system, ts AS "at", event_id AS id, event_type <> 'error' AS ok, value
  FROM events)"""

_LOG = """log AS (
  SELECT CAST(user_id % 20 AS BIGINT) AS system, user_id AS actor, event_type AS kind, value AS latency_ms,
         ts AS "at", event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def _files(system: str) -> str:
    return f"""files AS (
  SELECT {system} AS system,
         CASE source WHEN 'src3' THEN 'build' WHEN 'src11' THEN 'node_modules/lib' ELSE source END
           || '/' || CAST(doc_id AS VARCHAR)
           || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.md' WHEN 'es' THEN '.txt' ELSE '' END AS path,
         CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'TypeScript' WHEN 'de' THEN 'Markdown' END AS language,
         CAST(length(text) - length(replace(text, chr(10), ''))
              + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines
  FROM documents),
counted AS (
  SELECT *, regexp_extract(path, '[^/](\\.[^./]+)$', 1) AS suffix FROM files
  WHERE regexp_extract(path, '[^/](\\.[^./]+)$', 1) IN ({", ".join(f"'{s}'" for s in SOURCE_SUFFIXES)})
    AND NOT list_has_any(string_split(path, '/'), [{", ".join(f"'{s}'" for s in EXCLUDED_FOLDERS)}]))"""


_SOURCE_FILES = _files("CAST(substr(source, 4) AS BIGINT)")


def _capped(name: str, value: str) -> str:
    arms = " ".join(f"WHEN {name} = '{m}' AND {value} > {cap} THEN {cap}" for m, cap in SAFETY_CAPS.items())
    return f"CAST(CASE {arms} ELSE {value} END AS BIGINT)"


_PAGES = f"""totals AS (
  SELECT o_custkey AS system, count(*) AS total,
         count(*) FILTER (WHERE o_orderdate >= {_ASOF} - INTERVAL 30 DAY) AS recent,
         max(o_orderdate) AS newest, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
  FROM orders GROUP BY o_custkey),
texts AS (
  SELECT *, '<https://host/systems/' || system || '/commits?per_page=1&page=' AS url,
         '[{{"commit":{{"author":{{"date":"' || strftime(newest, {_ISO}) || '"}}}}}}]' AS commit_body
  FROM totals),
pages AS (
  SELECT system, 'repo' AS kind, CAST(NULL AS VARCHAR) AS link,
         CASE WHEN total = 13 THEN '{{"stargazers_count":' ELSE
           '{{"stargazers_count":' || CASE WHEN urgent = 0 THEN 'null' ELSE CAST(urgent AS VARCHAR) END || ',"language":'
           || CASE urgent WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN '"Go"' ELSE '"Python"' END || '}}' END AS body
  FROM texts
  UNION ALL
  SELECT system, 'latest', CASE WHEN total > 1 THEN url || '2>; rel="next", ' || url || total || '>; rel="last"' END, commit_body
  FROM texts
  UNION ALL
  SELECT system, 'recent', CASE WHEN recent > 1 THEN url || '2>; rel="next", ' || url || recent || '>; rel="last"' END,
         CASE WHEN recent > 0 THEN commit_body ELSE '[]' END
  FROM texts),
listed AS (
  SELECT *, coalesce(
           TRY_CAST(nullif(regexp_extract(link, '{LAST_PAGE_PATTERN}', 1), '') AS BIGINT),
           CAST(CASE WHEN kind <> 'repo' THEN json_array_length(body) END AS BIGINT)) AS total
  FROM pages)"""

_HARVEST = f"""{_PAGES},
joined AS (
  SELECT l.system, l.total AS total, r.total AS recent, json_valid(p.body) AS ok,
         CASE WHEN json_valid(p.body) THEN p.body ELSE '{{}}' END AS repo,
         json_extract_string(l.body, '$[0].commit.author.date') AS newest
  FROM listed l JOIN listed r ON l.system = r.system AND r.kind = 'recent'
       JOIN listed p ON l.system = p.system AND p.kind = 'repo'
  WHERE l.kind = 'latest'),
{_SOURCE_FILES},
loc AS (SELECT system, CAST(sum(lines) AS BIGINT) AS lines_of_code FROM counted GROUP BY system HAVING sum(lines) > 0),
harvested AS (
  SELECT j.system, CASE WHEN ok THEN 'operational' ELSE 'degraded' END AS status,
         CASE WHEN ok THEN {_capped("'commits_30d'", "recent")} ELSE 0 END AS commits_30d,
         CASE WHEN ok THEN {_capped("'commits_total'", "total")} ELSE 0 END AS commits_total,
         CASE WHEN ok THEN coalesce(CAST(json_extract_string(repo, '$.stargazers_count') AS BIGINT), 0) ELSE 0 END AS repo_stars,
         CASE WHEN ok THEN coalesce(nullif(json_extract_string(repo, '$.language'), ''), 'Unknown') ELSE 'Unknown' END AS primary_language,
         CASE WHEN ok THEN newest END AS last_commit_at,
         {_capped("'lines_of_code'", "lines_of_code")} AS lines_of_code
  FROM joined j LEFT JOIN loc ON j.system = loc.system)"""

_CARRIED = """last_value(CASE WHEN ok THEN {'at': harvested_at, 'd': commits_30d, 't': commits_total, 's': repo_stars,
                                'l': primary_language, 'c': last_commit_at} END IGNORE NULLS) OVER (
           PARTITION BY system ORDER BY harvested_at, harvest_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_SHOWN = """CASE WHEN ok THEN 'operational' ELSE 'degraded' END AS status, coalesce(g.d, 0) AS commits_30d, coalesce(g.t, 0) AS commits_total,
         coalesce(g.s, 0) AS repo_stars, coalesce(g.l, 'Unknown') AS primary_language, g.c AS last_commit_at, g.at AS last_good_at"""
_LANGUAGE = "CASE WHEN k < 20 THEN 'Unknown' WHEN k < 60 THEN 'Go' ELSE 'Python' END"

# Three pages per event; each repository page begins a harvest and takes what follows it within 12 s.
_SERVED_METRICS = f"""ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(user_id % 20 AS BIGINT) AS system FROM events),
fetched AS (
  SELECT system, event_id * 3 AS id, 'repo' AS kind, ts AS "at", event_type <> 'error' AS good,
         CAST(floor(value * 1000) AS BIGINT) AS stars, {_LANGUAGE} AS language, CAST(NULL AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS newest
  FROM ev
  UNION ALL SELECT system, event_id * 3 + 1, 'latest', ts + INTERVAL 2 SECOND, FALSE, NULL, NULL, event_id + 2, strftime(ts, {_ISO}) FROM ev
  UNION ALL SELECT system, event_id * 3 + 2, 'recent', ts + INTERVAL 4 SECOND, FALSE, NULL, NULL, k, NULL FROM ev WHERE event_type <> 'signup'),
begun AS (
  SELECT *, last_value(CASE WHEN kind = 'repo' THEN {{'at': "at", 'id': id}} END IGNORE NULLS) OVER (
           PARTITION BY system ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
  FROM fetched),
put AS (
  SELECT system, h.at AS harvested_at, h.id AS harvest_id, bool_or(good) AS repo_ok, max(stars) AS stars, max(language) AS language,
         max_by(total, ("at", id)) FILTER (kind = 'latest') AS total, max_by(newest, ("at", id)) FILTER (kind = 'latest') AS newest,
         max_by(total, ("at", id)) FILTER (kind = 'recent') AS recent
  FROM begun WHERE h IS NOT NULL AND epoch_us("at") - epoch_us(h.at) <= 12000000 GROUP BY 1, 2, 3),
judged AS (
  SELECT system, harvested_at, harvest_id, repo_ok AND total IS NOT NULL AND recent IS NOT NULL AS ok,
         {_capped("'commits_30d'", "recent")} AS commits_30d, {_capped("'commits_total'", "total")} AS commits_total,
         {_capped("'repo_stars'", "stars")} AS repo_stars, language AS primary_language, newest AS last_commit_at
  FROM put),
carried AS (SELECT system, harvested_at, harvest_id, ok, {_CARRIED} AS g FROM judged)"""

_CASES = """cases AS (
  SELECT 'chat' AS dataset_id, a.conv_id * 4294967296 + a.turn AS case_id,
         CASE WHEN a.turn <= 1 THEN 'opening' ELSE 'follow_up' END AS slice, a.text AS input, b.text AS expected
  FROM conversations a
  LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
  WHERE a.role = 'user')"""

_MATRIX = f"""{_CASES},
matrix AS (
  SELECT dataset_id, case_id, slice, 'plain' AS variant_id, input AS prompt FROM cases
  UNION ALL
  SELECT dataset_id, case_id, slice, 'polite', 'Please answer briefly.' || chr(10) || input || chr(10) || 'Thank you.' FROM cases
  UNION ALL
  SELECT dataset_id, case_id, slice, 'tagged', '[' || slice || '] ' || input || ' (case ' || case_id || ')' FROM cases)"""


def _normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[ \\t\\r\\n]+', ' ', 'g'))"


def _verdict(expected: str, passed: str) -> str:
    return f"CASE WHEN {expected} IS NOT NULL THEN CAST(coalesce({passed}, FALSE) AS DOUBLE) END"


def _words(text: str) -> str:
    return f"list_filter(list_distinct(string_split({_normal(text)}, ' ')), lambda w: w <> '')"


_TEXT_SCORES = f"""{_CASES},
answers AS (
  SELECT case_id, expected, 'echo' AS variant, expected AS output FROM cases
  UNION ALL SELECT case_id, expected, 'loose', '  ' || lower(expected) || chr(10) FROM cases
  UNION ALL SELECT case_id, expected, 'quote', input FROM cases),
sets AS (
  SELECT *, {_words("coalesce(output, '')")} AS got, {_words("coalesce(expected, '')")} AS want FROM answers),
wide AS (
  SELECT case_id, variant,
    {_verdict("expected", "output = expected")} AS s_exact,
    {_verdict("expected", f"{_normal('output')} = {_normal('expected')}")} AS s_normalised,
    {_verdict("expected", "contains(output, expected)")} AS s_contains,
    CAST(coalesce(regexp_matches(output, '(tion|ment)[ .]'), FALSE) AS DOUBLE) AS s_pattern,
    CAST(coalesce(length(output) BETWEEN 100 AND 600, FALSE) AS DOUBLE) AS s_length,
    CASE WHEN expected IS NOT NULL THEN
      floor(CASE WHEN len(got) + len(want) > 0
            THEN CAST(len(list_intersect(got, want)) AS DOUBLE) * 2.0::DOUBLE / CAST(len(got) + len(want) AS DOUBLE)
            ELSE 1.0::DOUBLE END * 10000::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS s_token_f1
  FROM sets),
scores AS (
  SELECT case_id, variant, 'exact' AS rubric, s_exact AS score, s_exact >= 1 AS passed FROM wide
  UNION ALL SELECT case_id, variant, 'normalised', s_normalised, s_normalised >= 1 FROM wide
  UNION ALL SELECT case_id, variant, 'contains', s_contains, s_contains >= 1 FROM wide
  UNION ALL SELECT case_id, variant, 'pattern', s_pattern, s_pattern >= 1 FROM wide
  UNION ALL SELECT case_id, variant, 'length', s_length, s_length >= 1 FROM wide
  UNION ALL SELECT case_id, variant, 'token_f1', s_token_f1, s_token_f1 >= 0.5 FROM wide)"""

_RUNS = """runs AS (
  SELECT l_linenumber AS run, l_returnflag AS slice, l_partkey AS case_id, l_orderkey AS trial,
         CAST(1 - l_discount AS DECIMAL(6,4)) AS score,
         CAST(round((1 - l_discount) * 10000) AS BIGINT) AS units,
         CASE WHEN l_tax = 0 AND l_linestatus = 'F' THEN 'timeout' END AS error, l_shipdate AS "at"
  FROM lineitem)"""


def _mean(total: str, n: str) -> str:
    return f"((CAST({total} AS BIGINT) * 2 + {n}) // nullif({n} * 2, 0))"


_COMPARED = f"""{_RUNS},
sides AS (
  SELECT run, case_id, {_mean("sum(units)", "count(units)")} AS u FROM runs WHERE run IN (1, 2) GROUP BY run, case_id),
compared AS (
  SELECT coalesce(b.case_id, c.case_id) AS case_id,
         CAST(b.u AS DOUBLE) / 10000 AS base_score, CAST(c.u AS DOUBLE) / 10000 AS cand_score,
         CAST(c.u - b.u AS DOUBLE) / 10000 AS delta,
         CASE WHEN b.case_id IS NULL THEN 'added' WHEN c.case_id IS NULL THEN 'removed' WHEN c.u < b.u THEN 'regressed'
              WHEN c.u > b.u THEN 'improved' ELSE 'unchanged' END AS change_class,
         coalesce(b.u >= 9500 AND c.u < 9500, FALSE) AS pass_to_fail
  FROM (SELECT * FROM sides WHERE run = 1) b FULL OUTER JOIN (SELECT * FROM sides WHERE run = 2) c
       ON b.case_id = c.case_id)"""


def _windows(starts: str, hours: int) -> str:
    return f"""SELECT window_start, window_start + INTERVAL {hours} HOUR AS window_end, event_type AS kind,
       count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
       CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS latency_ms
FROM ({starts}) GROUP BY window_start, event_type"""


def _sessions(closed_only: bool) -> str:
    keep = """WHERE epoch_us(window_end) <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)""" if closed_only else ""
    return f"""WITH marked AS (
  SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS s FROM marked),
grouped AS (
  SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, user_id AS actor, event_type AS kind,
         count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
         CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS latency_ms
  FROM numbered GROUP BY user_id, event_type, s)
SELECT * FROM grouped {keep}"""


_RESOLVED = f"""{_OBSERVED},
resolved AS (
  SELECT *, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER w AS good_value,
         last_value(CASE WHEN ok THEN "at" END IGNORE NULLS) OVER w AS last_good_at
  FROM observed
  WINDOW w AS (PARTITION BY system ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
served AS (
  SELECT system, "at", id, CASE WHEN ok THEN 'operational' ELSE 'degraded' END AS status,
         coalesce(good_value, 0.0::DOUBLE) AS served_value, last_good_at
  FROM resolved)"""


def _age(seconds: str) -> tuple[str, str]:
    unit = f"""CASE WHEN {seconds} IS NULL THEN 'never' WHEN {seconds} < 0 THEN 'future' WHEN {seconds} < 60 THEN 's'
      WHEN {seconds} < 3600 THEN 'm' WHEN {seconds} < 86400 THEN 'h' WHEN {seconds} < 2592000 THEN 'd'
      WHEN {seconds} < 31104000 THEN 'mo' ELSE 'y' END"""
    count = f"""CASE WHEN {seconds} IS NULL OR {seconds} < 0 THEN NULL WHEN {seconds} < 60 THEN {seconds}
      WHEN {seconds} < 3600 THEN {seconds} // 60 WHEN {seconds} < 86400 THEN {seconds} // 3600
      WHEN {seconds} < 2592000 THEN {seconds} // 86400 WHEN {seconds} < 31104000 THEN {seconds} // 2592000
      ELSE ({seconds} // 2592000) // 12 END"""
    return unit, count


_UNIT, _COUNT = _age("age")


def _band(us: str) -> str:
    return f"""CASE WHEN {us} IS NULL OR {us} < 0 THEN 'invalid' WHEN {us} < 1000000 THEN 'sub_ms'
      WHEN {us} < 1000000000 THEN 'ms' WHEN {us} < 60000000000 THEN 's' ELSE 'min' END"""


def _duration(us: str) -> str:
    """Label of a duration in millionths of a millisecond."""
    hundredths = f"(({us} + 5000000) // 10000000)"
    return f"""CASE {_band(us)} WHEN 'invalid' THEN '—' WHEN 'sub_ms' THEN '<1ms'
      WHEN 'ms' THEN CAST(({us} + 500000) // 1000000 AS VARCHAR) || 'ms'
      WHEN 's' THEN CAST({hundredths} // 100 AS VARCHAR) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0') || 's'
      ELSE CAST(({us} + 30000000000) // 60000000000 AS VARCHAR) || 'm' END"""


def _millionths(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(24,6)) * 1000000 AS BIGINT)"


# Masks as spans: one pattern finds all, each span is told by the first kind that it is as a whole.
_TOKEN, _HEX = "[A-Za-z0-9_-]", "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN_KINDS = {
    "secret": rf"\beyJ{_TOKEN}+\.{_TOKEN}+(?:\.{_TOKEN}*)?|\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b"
    rf"|\b(?:ghp|gho|ghs|sk|pk|xoxa|xoxb|xoxp)[_-]{_TOKEN}+|(?i:\bbearer +[a-z0-9._~+/=-]+)"
    r"""|(?i:(?:token|secret|password|passwd|api_?key|access_?key)["'']?[ \t]*[=:][ \t]*(?:"[^"]*"|''[^'']*''|[^ \t\n"'',;]+))""",
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}\p{L}+",
    "address": rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b|\b(?:{_HEX}:){{7}}{_HEX}\b|\b(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}\b|::{_HEX}(?::{_HEX}){{0,6}}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
}
_PHONE = (
    r"\+[0-9][0-9 ().-]*[0-9]|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b"
    r"|\b0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}\b|\(0[0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}\b"
)
_SPAN = "|".join(f"(?:{pattern})" for pattern in _SPAN_KINDS.values())
_DIGIT = "CAST(substr(reverse(regexp_replace(s, '[ -]', '', 'g')), i, 1) AS INTEGER)"
_LUHN = f"""list_sum(list_transform(range(1, length(regexp_replace(s, '[ -]', '', 'g')) + 1),
      lambda i: {_DIGIT} * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) - CASE WHEN i % 2 = 0 AND {_DIGIT} > 4 THEN 9 ELSE 0 END)) % 10 = 0"""
_WHOLE = " ".join(
    rf"WHEN regexp_matches(s, '\A(?:{_SPAN_KINDS[name]})\z') THEN {told}"
    for name, told in (("secret", "'secret'"), ("email", "'email'"), ("address", "'address'"), ("card", f"CASE WHEN {_LUHN} THEN 'card' ELSE 'run' END"))
)
_SPANS = rf"""found AS (
  SELECT doc_id, text, regexp_split_to_array(text, '{_SPAN}') AS gaps,
         list_transform(regexp_extract_all(text, '{_SPAN}'), lambda s: {{'kind': CASE {_WHOLE} END, 's': s}}) AS spans
  FROM documents),
marked AS (
  SELECT *, list_transform(spans, lambda x: CASE x.kind WHEN 'run' THEN x.s ELSE '[' || x.kind || ']' END) AS marks FROM found),
cut AS (
  SELECT *, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(marks[i], '')), '') AS t FROM marked)"""


def _spans_of(kind: str) -> str:
    return f"CAST(len(list_filter(spans, lambda x: x.kind = '{kind}')) AS BIGINT)"


def _silent(seconds: int) -> str:
    return f"""WITH {_OBSERVED},
ahead AS (SELECT system, "at", lead("at") OVER (PARTITION BY system ORDER BY "at", id) AS next_at FROM observed),
gaps AS (SELECT *, epoch_us(coalesce(next_at, TIMESTAMP '2024-02-01 00:00:00')) - epoch_us("at") AS us FROM ahead)
SELECT system, "at" AS last_seen, next_at AS back_at, us // 1000000 AS silent_s FROM gaps WHERE us > {seconds} * 1000000::BIGINT"""


_INNER = (b"evalframe-demonstration-key".ljust(64, b"\0")).translate(bytes(x ^ 0x36 for x in range(256))).hex()
_OUTER = (b"evalframe-demonstration-key".ljust(64, b"\0")).translate(bytes(x ^ 0x5C for x in range(256))).hex()


_WORKLOAD = f"""WITH {_LOG}
SELECT system, strftime("at", '%Y-%m-%d') AS day, count(*) AS requests,
       count(*) FILTER (WHERE kind = 'error') AS errors,
       CAST(count(*) FILTER (WHERE kind = 'error') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS error_rate,
       CAST(CAST(quantile_cont(latency_ms, 0.5) AS DECIMAL(24,6)) AS DOUBLE) AS p50_ms,
       CAST(CAST(quantile_cont(latency_ms, 0.95) AS DECIMAL(24,6)) AS DOUBLE) AS p95_ms
FROM log GROUP BY system, strftime("at", '%Y-%m-%d')"""

_LABELLED = """SELECT d.lang AS slice,
         length(d.text) BETWEEN 200 AND 4000 AND NOT regexp_matches(d.text, '[#$%&*]{3}') AS passed, l.quality = 1 AS good,
         l.quality IS NULL AS unlabelled
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


SQL: dict[str, str] = {
    "t1_activity_snapshot": f"""SELECT o_custkey AS system, count(*) AS commits_total,
       count(*) FILTER (WHERE o_orderdate >= {_ASOF} - INTERVAL 30 DAY) AS commits_30d, max(o_orderdate) AS last_commit_at
FROM orders WHERE o_orderdate <= {_ASOF} GROUP BY o_custkey""",
    "t2_safety_clamp": f"""WITH wide AS (
  SELECT o_custkey AS system, count(*) * 100000 AS commits_total, (count(*) - 8) * 20000 AS commits_30d,
         nullif(count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) * 300000 AS repo_stars,
         CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) * 4 AS lines_of_code,
         count(*) FILTER (WHERE o_orderstatus = 'O') * 1000000 AS open_issues
  FROM orders GROUP BY o_custkey),
long AS (
  SELECT system, 'commits_total' AS metric, commits_total AS value FROM wide
  UNION ALL SELECT system, 'commits_30d', commits_30d FROM wide
  UNION ALL SELECT system, 'repo_stars', repo_stars FROM wide
  UNION ALL SELECT system, 'lines_of_code', lines_of_code FROM wide
  UNION ALL SELECT system, 'open_issues', open_issues FROM wide)
SELECT system, metric, CAST(value AS BIGINT) AS value, {_capped("metric", "value")} AS capped FROM long""",
    "t3_pagination_total": f"WITH {_PAGES} SELECT system, kind, total FROM listed WHERE kind <> 'repo'",
    "t4_harvest_envelope": f"WITH {_HARVEST} SELECT * FROM harvested",
    "t4_harvest_json": f"""WITH {_HARVEST}
SELECT system, '{{"system":"' || system || '","mode":"showcase","status":"' || status || '","last_deployed_at":null,"last_commit_at":'
  || coalesce('"' || last_commit_at || '"', 'null') || ',"metrics":{{"commits_30d":' || commits_30d || ',"commits_total":' || commits_total
  || coalesce(',"lines_of_code":' || lines_of_code, '') || ',"primary_language":"' || primary_language || '","repo_stars":' || repo_stars
  || '}},"schema_version":1,"generated_at":"2001-08-01T00:00:00Z"}}' AS envelope
FROM harvested""",
    "t5_status_resolution": f"""WITH {_RESOLVED}, {_SOURCE_FILES},
loc AS (SELECT system, CAST(sum(lines) AS BIGINT) AS lines_of_code FROM counted GROUP BY system HAVING sum(lines) > 0)
SELECT served.*, {_capped("'lines_of_code'", "lines_of_code")} AS lines_of_code
FROM served LEFT JOIN loc ON served.system = loc.system""",
    "t5_served_metrics": f"""WITH {_SERVED_METRICS}, {_SOURCE_FILES},
loc AS (SELECT system, CAST(sum(lines) AS BIGINT) AS lines_of_code FROM counted GROUP BY system HAVING sum(lines) > 0)
SELECT c.system, harvested_at, harvest_id, {_SHOWN}, {_capped("'lines_of_code'", "lines_of_code")} AS lines_of_code
FROM carried c LEFT JOIN loc ON c.system = loc.system""",
    "t6_cache_freshness": f"""WITH RECURSIVE {_OBSERVED},
good AS (SELECT system, "at", min(id) AS id FROM observed WHERE ok GROUP BY system, "at"),
fetched AS (
  SELECT system, min("at") AS "at" FROM good GROUP BY system
  UNION ALL
  SELECT f.system, min(g."at") FROM fetched f JOIN good g ON g.system = f.system AND g."at" >= f."at" + INTERVAL 300 SECOND GROUP BY f.system),
marked AS (
  SELECT o.system, o."at", o.id, f."at" AS fetch_at
  FROM observed o LEFT JOIN good g ON g.system = o.system AND g."at" = o."at" AND g.id = o.id
       LEFT JOIN fetched f ON f.system = g.system AND f."at" = g."at"),
aged AS (
  SELECT system, fetch_at, epoch_us("at") - epoch_us(last_value(fetch_at IGNORE NULLS) OVER (
           PARTITION BY system ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS age_us
  FROM marked)
SELECT system, CASE WHEN fetch_at IS NOT NULL THEN 'refetch' WHEN age_us IS NULL THEN 'empty'
                    WHEN age_us < 300000000 THEN 'hit' ELSE 'stale' END AS cache_class,
       count(*) AS n, max(age_us // 1000000) AS max_data_age_s
FROM aged GROUP BY 1, 2""",
    "t7_contract_violations": f"""WITH base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, {_ISO}) AS stamp FROM events),
env AS (
  SELECT event_id AS id, CASE WHEN k <> 13 THEN 'sys-' || (user_id % 20) END AS system,
         CASE WHEN k < 10 THEN 'demo' WHEN k < 50 THEN NULL WHEN k < 75 THEN 'live' ELSE 'showcase' END AS mode,
         CASE event_type WHEN 'error' THEN 'degraded' WHEN 'signup' THEN 'offline' WHEN 'purchase' THEN 'down' ELSE 'operational' END AS status,
         CASE WHEN k = 70 THEN 'garbage' WHEN k <> 71 THEN stamp END AS last_commit_at,
         CASE WHEN k = 80 THEN 'soon' ELSE stamp END AS last_deployed_at,
         floor(value * 1000) AS commits_30d, floor(value * 1000 * k) AS commits_total,
         CASE WHEN event_type = 'view' THEN -k ELSE k END AS repo_stars,
         CASE WHEN k <= 90 THEN floor(value * 100000) END AS lines_of_code,
         CASE WHEN k = 42 THEN 2 ELSE 1 END AS schema_version,
         CASE WHEN k BETWEEN 60 AND 64 THEN left(stamp, 19) WHEN k = 66 THEN 'yesterdayZ' ELSE stamp END AS generated_at
  FROM base)
SELECT id, system, 'system_missing' AS rule FROM env WHERE system IS NULL
UNION ALL SELECT id, system, 'status_enum' FROM env WHERE status NOT IN ('operational', 'degraded', 'down')
UNION ALL SELECT id, system, 'mode_enum' FROM env WHERE mode NOT IN ('live', 'showcase')
UNION ALL SELECT id, system, 'schema_version' FROM env WHERE schema_version <> 1
UNION ALL SELECT id, system, 'generated_at_zone' FROM env WHERE NOT ends_with(generated_at, 'Z')
""" + "".join(
        f"UNION ALL SELECT id, system, '{c}_unreadable' FROM env WHERE {c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL\n"
        for c in ("generated_at", "last_commit_at", "last_deployed_at")
    ) + "".join(
        f"UNION ALL SELECT id, system, '{c}_above_cap' FROM env WHERE {c} > {cap}\n"
        f"UNION ALL SELECT id, system, '{c}_negative' FROM env WHERE {c} < 0\n"
        for c, cap in SAFETY_CAPS.items()
    ),
    "t8_lines_of_code": f"""WITH {_SOURCE_FILES}
SELECT coalesce(suffix, '(all)') AS suffix, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines
FROM counted GROUP BY ROLLUP (suffix)""",
    "t9_primary_language": f"""WITH {_SOURCE_FILES},
kept AS (SELECT system, path, language, lines FROM counted UNION ALL
         SELECT system, path, NULL, 0 FROM files WHERE path NOT IN (SELECT path FROM counted)),
by_language AS (SELECT system, language, CAST(sum(lines) AS BIGINT) AS lines FROM kept GROUP BY system, language),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY system ORDER BY language IS NULL, lines DESC, language DESC) AS r FROM by_language)
SELECT system, coalesce(language, 'Unknown') AS primary_language,
       CASE WHEN language IS NULL THEN 0 ELSE lines END AS language_lines
FROM ranked WHERE r = 1""",
    "t9_status_board": """WITH latest AS (
  SELECT CASE event_type WHEN 'error' THEN 'degraded' WHEN 'signup' THEN 'down' WHEN 'view' THEN 'operational'
              WHEN 'click' THEN 'operational' END AS status,
         event_type <> 'purchase' OR value > 30 AS reachable,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events),
shown AS (
  SELECT 'header' AS place, CASE WHEN status = 'operational' THEN 'success' WHEN status = 'degraded' THEN 'warning'
         WHEN status = 'down' OR NOT reachable THEN 'danger' ELSE 'muted' END AS tone,
         CASE WHEN status = 'operational' THEN 'Operational' WHEN status = 'degraded' THEN 'Degraded'
         WHEN status = 'down' OR NOT reachable THEN 'Offline' ELSE 'Connecting' END AS label FROM latest WHERE r = 1
  UNION ALL SELECT 'overview', CASE WHEN status = 'operational' THEN 'success' ELSE 'warning' END, NULL FROM latest WHERE r = 1
  UNION ALL SELECT 'telemetry', CASE WHEN status = 'operational' THEN 'success' WHEN status = 'degraded' THEN 'warning'
         ELSE 'muted' END, NULL FROM latest WHERE r = 1)
SELECT place, tone, label, count(*) AS systems FROM shown GROUP BY place, tone, label""",
    "f1_utilisation": """WITH used AS (
  SELECT o_custkey AS system, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS used FROM orders GROUP BY o_custkey),
joined AS (
  SELECT c_custkey AS system, coalesce(CAST(used AS DOUBLE), 0.0::DOUBLE) AS used, c_acctbal * 1000.0::DOUBLE AS "limit"
  FROM customer LEFT JOIN used ON system = c_custkey)
SELECT system, used, "limit", CASE WHEN "limit" IS NULL OR "limit" <= 0 THEN 0.0::DOUBLE
       ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, used / "limit" * 100::DOUBLE)) END AS percent
FROM joined""",
    "f2_age_histogram": f"""WITH texts AS (
  SELECT 'orders' AS feed,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'garbage'
              WHEN o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate, {_ISO}) END AS at_text,
         TIMESTAMP '2001-01-01 00:00:00' AS as_of
  FROM orders
  UNION ALL SELECT 'events', strftime(ts, {_ISO}), TIMESTAMP '2024-01-30 12:00:00' FROM events),
aged AS (
  SELECT feed, (epoch_us(as_of) - epoch_us(TRY_CAST(at_text AS TIMESTAMP))) AS us FROM texts),
seconds AS (SELECT feed, CASE WHEN us < 0 THEN -1 ELSE us // 1000000 END AS age FROM aged),
units AS (SELECT feed, {_UNIT} AS unit, {_COUNT} AS n FROM seconds)
SELECT feed, unit, CAST(n AS BIGINT) AS n, count(*) AS rows,
       CASE unit WHEN 'never' THEN 'never' WHEN 'future' THEN 'in the future' ELSE CAST(n AS VARCHAR) || unit || ' ago' END AS label
FROM units GROUP BY feed, unit, n""",
    "f3_latency_bands": f"""WITH {_LOG},
scaled AS (SELECT system, CAST(CAST(latency_ms AS DECIMAL(12,2)) * (id % 100) * (id % 100) AS DOUBLE) AS ms FROM log),
found AS (
  SELECT system, CAST(quantile_cont(ms, 0.5) AS DECIMAL(24,6)) AS a, CAST(quantile_cont(ms, 0.95) AS DECIMAL(24,6)) AS b
  FROM scaled GROUP BY system),
whole AS (SELECT *, {_millionths("a")} AS ua, {_millionths("b")} AS ub FROM found)
SELECT system, CAST(a AS DOUBLE) AS p50, {_band("ua")} AS p50_band, {_duration("ua")} AS p50_text,
       CAST(b AS DOUBLE) AS p95, {_band("ub")} AS p95_band, {_duration("ub")} AS p95_text
FROM whole""",
    "f3_band_histogram": f"""WITH {_LOG},
scaled AS (SELECT {_millionths("CAST(latency_ms AS DECIMAL(12,2)) * (id % 100) * (id % 100)")} AS us FROM log)
SELECT {_band("us")} AS band, {_duration("us")} AS label, count(*) AS rows FROM scaled GROUP BY 1, 2""",
    "f4_metric_cards": f"""WITH {_files("doc_id")},
loc AS (SELECT system, CAST(sum(lines) AS BIGINT) AS lines_of_code, max(language) AS primary_language FROM counted GROUP BY system),
metrics AS (
  SELECT o_custkey AS system, count(*) AS commits_total,
         count(*) FILTER (WHERE o_orderdate >= {_ASOF} - INTERVAL 30 DAY) AS commits_30d,
         max(o_orderdate) AS last_commit_at,
         nullif(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 1000, 0) AS repo_stars
  FROM orders GROUP BY o_custkey),
joined AS (SELECT metrics.*, lines_of_code, primary_language FROM metrics LEFT JOIN loc ON metrics.system = loc.system),
cards AS (
  SELECT system, 1 AS position, 'Commits · total' AS title, commits_total AS raw, NULL AS shown, 'History' AS subtitle FROM joined
  UNION ALL SELECT system, 2, 'Commits · 30d', commits_30d, NULL, 'Trailing 30 days' FROM joined
  UNION ALL SELECT system, 3, 'Repo stars', repo_stars, NULL, 'Stars' FROM joined
  UNION ALL SELECT system, 4, 'Lines of code', lines_of_code, NULL, coalesce('Mostly ' || primary_language, 'All sources') FROM joined
  UNION ALL SELECT system, 5, 'Primary language', NULL, coalesce(primary_language, '—'), '' FROM joined
  UNION ALL SELECT system, 6, 'Last commit', NULL, strftime(last_commit_at, '%b %-d, %Y'), '' FROM joined)
SELECT system, position, title, raw, coalesce(shown, format('{{:,}}', raw), '—') AS display, subtitle FROM cards""",
    "f5_series_normalised": f"""WITH {_LOG},
daily AS (
  SELECT kind AS series, strftime("at", '%Y-%m-%d') AS "at", CAST(sum(CAST(latency_ms AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM log GROUP BY 1, 2),
placed AS (
  SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY series ORDER BY "at") - 1 AS i,
         min(value) OVER p AS low, max(value) OVER p AS high
  FROM daily WINDOW p AS (PARTITION BY series))
SELECT series, "at", value, CAST(i AS DOUBLE) / CAST(n - 1 AS DOUBLE) AS x,
       (value - low) / coalesce(nullif(high - low, 0), 1) AS y
FROM placed WHERE n >= 2""",
    "f6_daily_trend": f"""WITH systems AS (SELECT DISTINCT o_custkey AS system FROM orders WHERE o_orderdate <= {_ASOF}),
days AS (SELECT CAST({_ASOF} AS DATE) - CAST(range AS INTEGER) AS day FROM range(10)),
counts AS (
  SELECT o_custkey AS system, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders
  WHERE o_orderdate <= {_ASOF} GROUP BY 1, 2)
SELECT systems.system, strftime(days.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS commits
FROM systems CROSS JOIN days LEFT JOIN counts ON counts.system = systems.system AND counts.day = days.day""",
    "f7_trend_direction": f"""WITH counted AS (
  SELECT o_custkey AS system, count(*) FILTER (WHERE o_orderdate >= {_ASOF} - INTERVAL 30 DAY) AS current,
         count(*) FILTER (WHERE o_orderdate < {_ASOF} - INTERVAL 30 DAY AND o_orderdate >= {_ASOF} - INTERVAL 60 DAY) AS previous
  FROM orders WHERE o_orderdate <= {_ASOF} GROUP BY o_custkey)
SELECT system, current, previous, current - previous AS change,
       CASE WHEN current > previous THEN 'up' WHEN current < previous THEN 'down' ELSE 'flat' END AS direction,
       CAST(current - previous AS DOUBLE) * 100::DOUBLE / nullif(CAST(previous AS DOUBLE), 0) AS change_percent
FROM counted""",
    "s1_stream_ingest": f"WITH {_OBSERVED} SELECT * FROM observed",
    "s2_last_known_good": f"WITH {_RESOLVED} SELECT * FROM served",
    "s2_served_metrics": f"""WITH harvests AS (
  SELECT CAST(user_id % 20 AS BIGINT) AS system, ts AS harvested_at, event_id AS harvest_id, event_type NOT IN ('error', 'signup') AS ok,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS commits_30d, event_id + 2 AS commits_total,
         CAST(floor(value * 1000) AS BIGINT) AS repo_stars, event_type AS primary_language, strftime(ts, {_ISO}) AS last_commit_at
  FROM events),
carried AS (SELECT system, harvested_at, harvest_id, ok, {_CARRIED} AS g FROM harvests)
SELECT system, harvested_at AS "at", harvest_id AS id, {_SHOWN} FROM carried""",
    "s3_silent_now": f"""WITH {_OBSERVED}, newest AS (SELECT system, max("at") AS last_seen FROM observed GROUP BY system)
SELECT system, last_seen, (SELECT max("at") FROM observed) AS raised_at FROM newest
WHERE epoch_us((SELECT max("at") FROM observed)) - epoch_us(last_seen) > 600 * 1000000::BIGINT""",
    "s3_offline_gaps": _silent(7_200),
    "s3_offline_alerts": _silent(600),
    "s4_latest_per_system": f"""WITH {_OBSERVED},
polls AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY "at" DESC, id DESC) AS r FROM observed),
goods AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY "at" DESC, id DESC) AS r FROM observed WHERE ok)
SELECT polls.system, polls."at" AS last_poll_at, polls.ok AS last_ok, goods."at" AS data_at, goods.id AS data_id, goods.value AS data_value
FROM polls LEFT JOIN goods ON goods.system = polls.system AND goods.r = 1 WHERE polls.r = 1""",
    "s5_tumbling_counters": _windows("SELECT *, date_trunc('day', ts) AS window_start FROM events", 24),
    "s5_sliding_counters": _windows(
        "SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start FROM events UNION ALL "
        "SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') - INTERVAL 12 HOUR FROM events", 24),
    "s5_session_counters": _sessions(False),
    "s5_session_stream": _sessions(True),
    "s5_session_updates": _sessions(False),
    "e1_load_cases": f"""WITH {_CASES},
formats AS (SELECT 'json' AS format UNION ALL SELECT 'csv')
SELECT format, FALSE AS quarantined, dataset_id, case_id, slice, input, expected, NULL AS raw FROM cases CROSS JOIN formats
UNION ALL
SELECT format, TRUE, NULL, NULL, NULL, NULL, NULL,
       CASE format WHEN 'json' THEN '{{"case_id": ' || (conv_id * 4294967296 + turn) || ', "input"' ELSE 'chat,' || (conv_id * 4294967296 + turn) END
FROM conversations CROSS JOIN formats WHERE role = 'system'""",
    "e1_load_large_files": f"""WITH {_CASES},
formats AS (SELECT 'array' AS format UNION ALL SELECT 'csv')
SELECT format, FALSE AS quarantined, dataset_id, case_id, slice, input, expected, CAST(case_id % 4294967296 AS VARCHAR) AS turn, NULL AS raw
FROM cases CROSS JOIN formats
UNION ALL
SELECT 'array', TRUE, NULL, NULL, NULL, NULL, NULL, NULL, '{{"dataset_id":"chat","case_id":"id ' || (conv_id * 4294967296 + turn) || '"}}'
FROM conversations WHERE role = 'system'""",
    "e2_case_violations": f"""WITH {_CASES},
both_sets AS (
  SELECT dataset_id, case_id, input, expected, slice = 'opening' AS noted FROM cases
  UNION ALL
  SELECT 'conversation', case_id // 4294967296, CASE WHEN slice = 'opening' THEN input ELSE '  ' END, expected, FALSE FROM cases),
counted AS (
  SELECT dataset_id, case_id, count(*) AS n, count(*) FILTER (WHERE trim(input) = '') AS empty,
         count(*) FILTER (WHERE expected IS NULL) AS unanswered, count(*) FILTER (WHERE noted) AS strange
  FROM both_sets GROUP BY dataset_id, case_id)
SELECT dataset_id, case_id, 'duplicate_case_id' AS violation, n FROM counted WHERE n > 1
UNION ALL SELECT dataset_id, case_id, 'empty_input', empty FROM counted WHERE empty > 0
UNION ALL SELECT dataset_id, case_id, 'missing_expected', unanswered FROM counted WHERE unanswered > 0
UNION ALL SELECT dataset_id, case_id, 'unknown_field', strange FROM counted WHERE strange > 0""",
    "e3_variant_matrix": f"WITH {_MATRIX} SELECT * FROM matrix",
    "e4_run_outputs": f"""WITH {_MATRIX}
SELECT 'run-1' AS run_id, dataset_id, case_id, variant_id,
       CASE WHEN NOT contains(prompt, 'ing') THEN 'answer: ' || replace(trim(prompt), chr(10), ' / ') END AS output,
       CASE WHEN contains(prompt, 'ing') THEN 'ValueError: prompt not allowed' END AS error
FROM matrix""",
    "e5_rubric_scores": f"WITH {_TEXT_SCORES} SELECT * FROM scores",
    "e5_value_rubrics": f"""WITH base AS (
  SELECT event_id, event_type AS kind, value, json_extract_string(props, '$.k') AS k,
         CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS whole,
         CASE WHEN event_type = 'view' THEN ' VIEW ' ELSE event_type END AS said,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'view'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 90 THEN 'click' END AS want
  FROM events),
wide AS (
  SELECT event_id, {_verdict("k", "abs(value - CAST(k AS DOUBLE)) <= 5")} AS s_numeric,
         {_verdict("whole", "k = whole")} AS s_json_field, {_verdict("want", "lower(trim(said)) = want")} AS s_label,
         CASE WHEN want IS NOT NULL THEN
           floor((1::DOUBLE - CAST(levenshtein(kind, want) AS DOUBLE) / CAST(greatest(length(kind), length(want)) AS DOUBLE)) * 10000::DOUBLE + 0.5::DOUBLE)
           / 10000.0::DOUBLE END AS s_edit
  FROM base)
SELECT event_id, 'numeric' AS rubric, s_numeric AS score, s_numeric >= 1 AS passed FROM wide
UNION ALL SELECT event_id, 'json_field', s_json_field, s_json_field >= 1 FROM wide
UNION ALL SELECT event_id, 'label', s_label, s_label >= 1 FROM wide
UNION ALL SELECT event_id, 'edit', s_edit, s_edit >= 0.5 FROM wide""",
    "e5_custom_rubric": f"""WITH {_TEXT_SCORES}
SELECT case_id, variant, 'length_ratio' AS rubric, score, score >= 0.5::DOUBLE AS passed FROM (
  SELECT case_id, variant, CASE WHEN output IS NOT NULL AND expected IS NOT NULL THEN
         least(1.0::DOUBLE, CAST(length(output) AS DOUBLE) / CAST(length(expected) AS DOUBLE)) END AS score FROM answers)""",
    "e6_composite_gate": f"""WITH {_TEXT_SCORES},
weighed AS (
  SELECT *, CAST(score AS DECIMAL(9,4)) AS s,
         CASE WHEN score IS NOT NULL THEN CASE rubric WHEN 'exact' THEN 3 WHEN 'normalised' THEN 2 WHEN 'contains' THEN 1 WHEN 'pattern' THEN 1 WHEN 'length' THEN 1 WHEN 'token_f1' THEN 2 END END AS w,
         CASE rubric WHEN 'contains' THEN 1.0::DOUBLE WHEN 'token_f1' THEN 0.2::DOUBLE END AS bar
  FROM scores),
summed AS (
  SELECT case_id, variant, CAST(sum(s * w) AS DOUBLE) / nullif(CAST(sum(w) AS DOUBLE), 0) AS composite,
         CAST(sum(w) AS BIGINT) AS weight, count(*) FILTER (WHERE score < bar) AS failed_rubrics,
         count(*) FILTER (WHERE score IS NULL) AS unscored
  FROM weighed GROUP BY case_id, variant)
SELECT case_id, variant, weight, failed_rubrics, unscored, composite,
       coalesce(composite >= 0.6::DOUBLE AND failed_rubrics = 0, FALSE) AS passed
FROM summed""",
    "e7_run_summary": f"""WITH {_RUNS}
SELECT CASE grouping(run, slice) WHEN 0 THEN 'run_slice' WHEN 1 THEN 'run' ELSE 'all' END AS level, run, slice,
       count(*) AS n, count(error) AS errors, count(*) FILTER (WHERE score >= 0.95) AS passed,
       CAST(sum(score) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_score,
       CAST(count(*) FILTER (WHERE score >= 0.95) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pass_rate,
       CAST(CAST(quantile_cont(CAST(score AS DOUBLE), 0.5) AS DECIMAL(24,6)) AS DOUBLE) AS p50,
       CAST(CAST(quantile_cont(CAST(score AS DOUBLE), 0.95) AS DECIMAL(24,6)) AS DOUBLE) AS p95
FROM runs GROUP BY ROLLUP (run, slice)""",
    "e8_compare_runs": f"WITH {_COMPARED} SELECT * FROM compared",
    "e8_class_counts": f"""WITH {_COMPARED}
SELECT change_class, count(*) AS cases, count(*) FILTER (WHERE pass_to_fail) AS pass_to_fail
FROM compared GROUP BY change_class""",
    "e9_export_regressions": f"""WITH {_COMPARED},
ranked AS (
  SELECT p_brand AS slice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY delta, case_id) AS INTEGER) AS rank,
         case_id, base_score, cand_score, delta
  FROM compared LEFT JOIN part ON p_partkey = case_id WHERE change_class = 'regressed')
SELECT 2 AS candidate_run, * FROM ranked WHERE rank <= 5""",
    "e10_run_history": f"""WITH {_RUNS},
monthly AS (
  SELECT run AS variant, strftime("at", '%Y-%m') AS run_at, {_mean("sum(units)", "count(units)")} AS u FROM runs GROUP BY 1, 2)
SELECT variant, run_at, CAST(u AS DOUBLE) / 10000 AS score,
       CAST(u - lag(u) OVER o AS DOUBLE) / 10000 AS change,
       CAST(max(u) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / 10000 AS best_before,
       last_value(CASE WHEN u >= 9500 THEN run_at END IGNORE NULLS)
         OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_passing_run
FROM monthly WINDOW o AS (PARTITION BY variant ORDER BY run_at)""",
    "e11_leaderboard": f"""WITH {_RUNS},
per_case AS (SELECT run, case_id, {_mean("sum(units)", "count(units)")} AS u FROM runs GROUP BY run, case_id),
means AS (SELECT run AS variant, count(u) AS cases, {_mean("sum(u)", "count(u)")} AS m FROM per_case GROUP BY run)
SELECT variant, cases, CAST(m AS DOUBLE) / 10000 AS mean_score, CAST(dense_rank() OVER (ORDER BY m DESC) AS INTEGER) AS place
FROM means""",
    "e11_pairwise_win_rate": f"""WITH {_RUNS},
per_case AS (SELECT run, case_id, {_mean("sum(units)", "count(units)")} AS u FROM runs GROUP BY run, case_id)
SELECT a.run AS variant_a, b.run AS variant_b, count(*) FILTER (WHERE a.u > b.u) AS wins,
       count(*) FILTER (WHERE a.u = b.u) AS ties, count(*) FILTER (WHERE a.u < b.u) AS losses, count(*) AS shared,
       CAST(count(*) FILTER (WHERE a.u > b.u) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS win_rate
FROM per_case a JOIN per_case b ON a.case_id = b.case_id AND a.run < b.run GROUP BY a.run, b.run""",
    "e12_label_agreement": f"""WITH judged AS ({_LABELLED}),
counted AS (
  SELECT slice, count(*) FILTER (WHERE passed AND good) AS tp, count(*) FILTER (WHERE passed AND NOT good) AS fp,
         count(*) FILTER (WHERE NOT passed AND good) AS fn, count(*) FILTER (WHERE NOT passed AND NOT good) AS tn,
         count(*) FILTER (WHERE unlabelled) AS unlabelled
  FROM judged GROUP BY slice)
SELECT *, CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision,
       CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall,
       CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1
FROM counted""",
    "e13_audit_diff": """WITH turns AS (
  SELECT conv_id * 4294967296 + turn AS id, role, text, replace(text, chr(10), ' ') AS flat FROM conversations)
SELECT id AS artifact_id, CAST(role IN ('system', 'user') AS BIGINT) AS recorded_copies,
       CAST(role IN ('user', 'assistant') AS BIGINT) AS found_copies,
       CASE WHEN role = 'system' THEN 'missing' WHEN role = 'assistant' THEN 'extra'
            WHEN text <> flat THEN 'changed' ELSE 'intact' END AS audit
FROM turns""",
    "e13_manifest": """SELECT conv_id AS artifact_id,
       sha256(length(role) || ':' || role || length(text) || ':' || text) AS sha256, count(*) AS copies
FROM conversations GROUP BY 1, 2""",
    "e14_private_log": f"""WITH {_LOG}
SELECT id, "at", system, kind, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(CAST(actor AS VARCHAR))))) AS actor_hash FROM log""",
    "e14_private_counts": f"""WITH {_LOG}
SELECT system, kind, strftime("at", '%Y-%m-%d') AS day, count(*) AS requests, count(DISTINCT actor) AS actors
FROM log GROUP BY 1, 2, 3 HAVING count(DISTINCT actor) >= 3""",
    "e14_masked_text": f"""WITH {_SPANS}
SELECT doc_id, regexp_replace(t, '{_PHONE}', '[phone]', 'g') AS masked_text,
       {_spans_of("secret")} AS secrets, {_spans_of("email")} AS emails, {_spans_of("address")} AS addresses,
       {_spans_of("card")} AS cards, CAST(len(regexp_extract_all(t, '{_PHONE}')) AS BIGINT) AS phones FROM cut""",
    "e_chain": f"""WITH {_MATRIX},
said AS (SELECT case_id, slice, variant_id, replace(trim(prompt, ' '), chr(10), ' / ') AS o FROM matrix WHERE variant_id <> 'tagged'),
scored AS (
  SELECT case_id, slice, variant_id,
         (20000 * (3 * (length(o) BETWEEN 40 AND 300)::INT + 2 * regexp_matches(o, '(tion|ment)[ .]')::INT + contains(o, 'ing')::INT) + 6) // 12 AS u
  FROM said),
compared AS (
  SELECT a.case_id, a.slice, a.u AS base, b.u AS cand FROM scored a JOIN scored b ON a.case_id = b.case_id
  WHERE a.variant_id = 'plain' AND b.variant_id = 'polite'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY slice ORDER BY cand - base, case_id) AS r FROM compared WHERE cand < base)
SELECT 'polite' AS candidate_run, slice, CAST(r AS INTEGER) AS rank, case_id, base / 10000.0::DOUBLE AS base_score,
       cand / 10000.0::DOUBLE AS cand_score, (cand - base) / 10000.0::DOUBLE AS delta
FROM ranked WHERE r <= 25""",
    "e15_workload_counters": _WORKLOAD,
    "e15_persisted_counters": _WORKLOAD,
}
