"""DuckDB twins of the queries that SQL can express."""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (sum(size) * 3)::BIGINT AS cap,
    [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source
), levels AS (  -- the level if all sources before this one, in order of cap / weight, are clamped
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sources WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT coalesce(arg_min(level, k) FILTER (cap >= level * weight), 0) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, chosen.level * weight) AS target FROM sources, chosen
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (whole * size + least(size, greatest(0, round(part - before))))::BIGINT AS taken
FROM ordered
"""

RULES_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM worded
), windows AS (
  SELECT r, pos, word || chr(10) || lead(word, 1) OVER w || chr(10) || lead(word, 2) OVER w || chr(10) || lead(word, 3) OVER w || chr(10) || lead(word, 4) OVER w AS five
  FROM placed WINDOW w AS (PARTITION BY r ORDER BY pos)
), twice AS (
  SELECT r, pos FROM windows WHERE five IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, five) > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), repeated AS (
  SELECT r, sum(n)::BIGINT AS lines, sum(n - 1)::BIGINT AS dups FROM lines GROUP BY r
), counted AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(repeated.dups, 0) AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(repeated.lines, 0) AS n_lines,
    len(regexp_extract_all(text, '[A-Z]')) AS upper_letters, len(regexp_extract_all(text, '[a-z]')) AS lower_letters
  FROM worded LEFT JOIN covered USING (r) LEFT JOIN repeated USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR upper_letters > lower_letters
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS kept
FROM judged
"""

URLS_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS address
  FROM rests
), listed AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    regexp_extract(address, '/casino/history([^a-z0-9_.%-]|\z)|/poker/rules([^a-z0-9_.%-]|\z)') AS allowed,
    regexp_matches(address, '^([^/?#]*\.)?(spam-farm|link-farm|casino|ads|tracker)\.|/casino/|/poker/|/adserver/|/wp-login\.php|/wp-admin/|/cgi-bin/'
      '|/(cart|checkout|login)([^a-z0-9_.%-]|\z)|[^a-z0-9_.%-]replytocom=|\.(exe|zip|jpg|png|mp4)\z') AS blocked
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN allowed <> '' THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM listed
"""

PHRASES_SQL = r"""
WITH lines AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), split_pieces AS (
  SELECT d, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p FROM lines
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM split_pieces
), placed AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(words)
), f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS c FROM candidates
), scored AS (
  SELECT x.*, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts x
  JOIN f l ON l.lang = x.lang AND l.k = x.c AND l.phrase = array_to_string(x.w[1 : x.c], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - x.c AND r.phrase = array_to_string(x.w[x.c + 1 :], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inner_ones AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.* FROM weakest s LEFT JOIN inner_ones i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""
