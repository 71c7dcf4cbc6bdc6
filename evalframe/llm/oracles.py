"""The same results as SQL, for the operators that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op3_url_filters"] = r"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(rh, rp, rv) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT s.page_id, s.host, s.path,
       (SELECT max_by(rh || rp, length(rh || rp)) FROM rules
        WHERE (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)) AS rule,
       coalesce((SELECT max_by(rv, length(rh || rp)) FROM rules
        WHERE (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)), 'allow') AS verdict
FROM split s
"""

SQL["op6_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), rendered AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length('<|turn|>' || regexp_replace(role, '([<\[])(~*)(\||/?s>|/?INST\])', '\1~\2\3', 'g') || '<|text|>'
             || regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\])', '\1~\2\3', 'g') || '<|end|>' || chr(10)))
           OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""

SQL["op8_quality_rules"] = r"""
WITH body AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), placed AS (
  SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM body
), windows AS (
  SELECT k, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM placed WINDOW o AS (PARTITION BY k ORDER BY i)
), twice AS (
  SELECT k, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1
), covered AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k
), line AS (
  SELECT k, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, unnest(lines) AS raw FROM body
), judged AS (
  SELECT k, s, raw, length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM line WHERE s <> ''
), told AS (
  SELECT k, count(*) - count(DISTINCT raw) AS dup,
         sum(CASE WHEN strpos('.!?…。！？:;"''”’»)]', right(s, 1)) = 0
               OR length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) * 100 >= chars * 10
               OR (upper(s) = s AND lower(s) <> s AND length(regexp_replace(s, '[^ ]', '', 'g')) >= 2)
               OR length(regexp_replace(s, '[^|»›•]', '', 'g')) >= 2
               OR regexp_matches(lower(s), 'all rights reserved|privacy policy|terms of (use|service)|cookies?( policy|s on this| to improve)|enable javascript|subscribe to our|sign up for|click here|licensed under|released under the|copyright ©|powered by|log in to')
             THEN 0 ELSE chars END) AS clean
  FROM judged GROUP BY k
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, coalesce(clean, 0) AS clean_chars
  FROM body LEFT JOIN covered USING (k) LEFT JOIN told USING (k)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(clean_chars AS BIGINT) AS clean_chars,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND clean_chars * 100 >= word_chars * 50 AS kept
FROM measured
"""

SQL["op1_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS nr,
         unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL
), normal AS (
  SELECT *, lower(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s FROM line
), wide AS (
  SELECT s, min((doc_id, nr)) AS place FROM normal WHERE s <> '' GROUP BY s HAVING count(DISTINCT coalesce(source, '')) >= 10
), told AS (
  SELECT doc_id, nr, raw, place IS NOT NULL AND place <> (doc_id, nr) AS gone FROM normal LEFT JOIN wide USING (s)
), built AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY nr) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS n FROM told GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines
FROM documents d LEFT JOIN built USING (doc_id)
"""

SQL["op2_mixing"] = r"""
WITH size AS (
  SELECT source, CAST(sum(length(text)) AS DOUBLE) AS c FROM documents GROUP BY source HAVING sum(length(text)) > 0
), rate AS (
  SELECT source, pow(c, 0.5) / (SELECT sum(pow(c, 0.5)) FROM size) * (SELECT sum(c) FROM size) / c AS r FROM size
), term AS (
  SELECT source, k, -r + sum(CASE WHEN k > 0 THEN ln(r) - ln(greatest(k, 1)) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS l
  FROM (SELECT *, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 24) AS BIGINT) + 1)) AS k FROM rate)
), cdf AS (
  SELECT source, k, sum(exp(l)) OVER (PARTITION BY source ORDER BY k) AS p FROM term
), drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT doc_id, count(*) FILTER (p <= u) AS n
  FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, n + 1)) AS copy
FROM documents d JOIN counted USING (doc_id)
"""

SQL["op12_lexical_search"] = r"""
WITH folded AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL
), doc AS (
  SELECT k, doc_id, len(words) AS n FROM folded WHERE len(words) > 0
), corpus AS (
  SELECT count(*) AS docs, sum(n) AS terms FROM doc
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(words) AS term FROM folded)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs
), gain AS (
  SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + CAST((75 * n * docs) // terms AS BIGINT)))) AS g
  FROM tf JOIN weight USING (term) JOIN doc USING (k), corpus
), scored AS (
  SELECT item_id, k, CAST(sum(g * times) AS BIGINT) AS score FROM gain JOIN asked USING (term) GROUP BY item_id, k
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score
FROM scored JOIN doc USING (k) WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 10
"""

SQL["op13_filter_audit"] = r"""
WITH body AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), least AS (
  SELECT t, min(doc_id) AS first FROM body GROUP BY t
), failed AS (
  SELECT part, doc_id,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS m
  FROM body JOIN least USING (t)
), label AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN label USING (doc_id) GROUP BY part, m
), letter(l, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), ordered AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0) AS before
  FROM ordered, (SELECT unnest(range(1, 6)) AS s)
), told AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN m & CAST(before + bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m & CAST(before AS INTEGER) <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""
