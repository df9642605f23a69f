"""DuckDB SQL for the training-data queries that SQL can express."""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id
  FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""


def _places(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their places: what stands before each match, and the match, add up."""
    return f"""
  SELECT r, '{kind}' AS kind, {rank} AS rank, stop - length(m) AS start, stop, m FROM (
    SELECT r, m, v, sum(length(gap) + length(coalesce(m, ''))) OVER (PARTITION BY r ORDER BY i)::BIGINT AS stop
    FROM (SELECT r, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(regexp_extract_all(t, '{pattern}')) AS m,
                 unnest(regexp_extract_all(t, '{pattern}', {group})) AS v, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i FROM d))
  WHERE length(v) >= {least}"""


SECRETS = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join([
    _places("assign", 0, r'''((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''', 2, 6),
    _places("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    _places("hex", 2, "[0-9a-f]+", 0, 24)])}),
candidate AS ({_places("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", 0, 20)}),
likely AS (
  SELECT *, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN 2.9 WHEN regexp_matches(m, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 3.5 ELSE 3.75 END AS least
  FROM candidate c
  WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT regexp_matches(m, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
    AND NOT regexp_matches(m, '(?i)example|sample|dummy|placeholder|changeme|your[-_]?(key|token|secret)|x{{6}}|0{{8}}|12345678|abcdefgh')
    AND NOT regexp_matches(m, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
    AND NOT (m LIKE '%/%' AND NOT regexp_matches(m, '[^/]{{16}}|[+=]|[^/][A-Z]'))
    AND NOT (regexp_matches(m, '[_-]') AND NOT regexp_matches(m, '[+=/]|[0-9][A-Za-z]'))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c.stop AND c.start < b.stop)),
chars AS (
  SELECT r, start, w, unnest(string_split(substr(m, w, 20), '')) AS x
  FROM (SELECT r, start, m, unnest(generate_series(1, length(m) - 19)) AS w FROM likely)),
counts AS (SELECT r, start, w, x, count(*) AS n FROM chars GROUP BY ALL),
bits AS (
  SELECT r, start, max(h) AS h FROM (SELECT r, start, w, -sum(n / 20 * log2(n / 20)) AS h FROM counts GROUP BY ALL) GROUP BY ALL),
added AS (SELECT r, kind, rank, likely.start, stop FROM likely JOIN bits USING (r, start) WHERE h >= least),
by_base AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS line
  FROM base GROUP BY r),
every AS (SELECT r, kind, rank, start, stop FROM base UNION ALL SELECT * FROM added),
by_all AS (
  SELECT r, count(*) FILTER (kind = 'entropy') AS n_entropy, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(line, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_base USING (r) LEFT JOIN by_all USING (r)
"""


def licenses(base, templates, k: int = 3, gap: int = 2, similarity: float = 0.8, least_votes: int = 4) -> str:
    """The license scan, for lists of (words, label)."""
    rows = [(w, x, "true") for w, x in base] + [(w, x, "false") for w, x in templates]
    given = ", ".join(f"({i}, '{x}', {b}, '{w}')" for i, (w, x, b) in enumerate(rows))
    over = "PARTITION BY r, tid, span ORDER BY pos, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return rf"""
WITH given(tid, label, base, text) AS (VALUES {given}),
gram AS (
  SELECT tid, label, base, len(w) AS size, p - 1 AS tpos, array_to_string(w[p:p + {k - 1}], ' ') AS gram
  FROM (SELECT *, string_split(text, ' ') AS w, unnest(generate_series(1, len(string_split(text, ' ')) - {k - 1})) AS p FROM given)),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM d),
own AS (
  SELECT * FROM (SELECT r, pos, x || {" || ".join(f"' ' || lead(x, {j}) OVER (PARTITION BY r ORDER BY pos)" for j in range(1, k))} AS gram FROM word)
  WHERE gram IS NOT NULL),
vote AS (SELECT r, tid, label, base, size, pos, tpos, pos - tpos AS diagonal FROM own JOIN gram USING (gram)),
opened AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, tid ORDER BY diagonal, tpos) > {gap}, true) AS opens,
         count(*) OVER (PARTITION BY r, tid, diagonal) = size - {k - 1} AS whole FROM vote),
spanned AS (SELECT *, sum(opens::INT) OVER (PARTITION BY r, tid ORDER BY diagonal, tpos) AS span FROM opened),
before AS (SELECT *, max(tpos) OVER ({over}) AS most FROM spanned),
span AS (
  SELECT r, tid, label, base, size, span, count(*) FILTER (tpos > coalesce(most, -1)) AS votes,
         sum(CASE WHEN tpos > coalesce(most, -1) THEN least({k}, coalesce(tpos - most, {k})) ELSE 0 END) AS words,
         min(pos) AS start, max(pos) + {k} AS stop, count(*) FILTER (whole AND tpos = 0) AS places,
         min(diagonal) FILTER (whole) AS first, max(diagonal) FILTER (whole) AS last
  FROM before GROUP BY ALL),
verified AS (SELECT r, label, start, stop, votes / (size - {k - 1}) AS share FROM span
  WHERE NOT base AND votes >= {least_votes} AND words >= {similarity} * size),
placed AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY r ORDER BY start, stop) AS place FROM (
    SELECT *, start >= coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opens
    FROM verified)),
labelled AS (
  SELECT r, label, places, first, last, true AS base, 1.0::DOUBLE AS share FROM span WHERE base AND places > 0
  UNION ALL SELECT r, label, NULL, NULL, NULL, false, share FROM placed QUALIFY share = max(share) OVER (PARTITION BY r, place)),
found AS (
  SELECT r, sum(places)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(share) AS score
  FROM labelled GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)
"""


URL_RULES = r"""
WITH rules(verdict, rule, host, path) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
cut AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u, CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
best AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict
  FROM parts p JOIN rules q ON (p.host = q.host OR ends_with(p.host, '.' || q.host)) AND starts_with(p.path, q.path) GROUP BY r)
SELECT page_id, host, path, rule, rule_verdict FROM parts LEFT JOIN best USING (r)
"""
