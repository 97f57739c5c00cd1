"""SQL of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

PHRASES = f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, {_SPLIT} AS words FROM documents),
starts AS (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split),
windows AS (SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM starts),
firsts AS (SELECT phrase, min(doc_id) AS least FROM windows GROUP BY phrase),
again AS (SELECT r, i FROM windows JOIN firsts USING (phrase) WHERE least < doc_id),
removed AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS place FROM again),
placed AS (SELECT r, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM split),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY place) AS left_over, count(*) AS n
  FROM placed ANTI JOIN removed USING (r, place) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_over, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


def _strength(level: str) -> str:
    """What the mean rate of a level is worth, in pages, by the method of moments."""
    return f"""
      SELECT CASE WHEN groups < 2 OR bad = 0 OR bad = n OR n - squares / n <= 0 THEN 1000.0
                  WHEN spread - (groups - 1) * m * (1 - m) <= 0 THEN 1000.0
                  ELSE least(1000.0, greatest(1.0, m * (1 - m) / ((spread - (groups - 1) * m * (1 - m)) / (n - squares / n)) - 1))
             END
      FROM (SELECT sum(n) AS n, sum(bad) AS bad, sum(n * n) AS squares, count(*) AS groups, any_value(m) AS m,
                   sum(n * (bad / n - m) * (bad / n - m)) AS spread
            FROM {level}, (SELECT sum(bad) / sum(n) AS m FROM {level}))"""


REPUTATION = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
ruled AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS own
  FROM parts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path),
hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(1 - quality) AS DOUBLE) AS bad,
         regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM parts JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
strengths AS (SELECT ({_strength('hosts')}) AS h, ({_strength('domains')}) AS d, ({_strength('suffixes')}) AS s,
                     (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS mean),
of_suffix AS (SELECT suffix, (bad + s * mean) / (n + s) AS above FROM suffixes, strengths),
of_domain AS (SELECT domain, (bad + d * above) / (n + d) AS above FROM domains JOIN of_suffix USING (suffix), strengths),
asked AS (
  SELECT DISTINCT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM parts WHERE host <> '' AND host NOT IN (SELECT host FROM hosts)),
placed AS (
  SELECT host, n, bad, above FROM hosts JOIN of_domain USING (domain)
  UNION ALL SELECT host, 0.0, 0.0, coalesce(of_domain.above, of_suffix.above, mean)
  FROM asked LEFT JOIN of_domain USING (domain) LEFT JOIN of_suffix USING (suffix), strengths),
of_host AS (SELECT host, n + h AS weight, (bad + h * above) / (n + h) AS rate FROM placed, strengths)
SELECT page_id, host, path, rule,
       coalesce(own, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5 THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN of_host USING (host)
"""


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# A checksum goes on from byte to byte by a table of 256 numbers, worked out here in eight steps.
SPELLING = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(1, 9)),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) r(i)),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWERED.format('run')} AS run, count(*) AS n FROM found GROUP BY 1, 2),
points AS (SELECT *, list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)) AS cps FROM runs WHERE length(run) >= 5),
bytes AS (
  SELECT run, n, flatten(list_transform(cps, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS b
  FROM points),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
                     lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]))) AS h
  FROM bytes, crc_table),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, left(word, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, near) FILTER (near_n = top) AS near, any_value(top) AS near_n
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
         CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
led AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL SELECT led.word, f.word, f.form FROM led JOIN formed f ON led.form = f.word)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n FROM formed f JOIN led ON led.word = f.word AND led.form IS NULL
"""

LINES = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM split),
keyed AS (SELECT *, {_LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM placed),
often AS (SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept
  FROM keyed LEFT JOIN often USING (key) WHERE largest IS NULL OR doc_id IS NULL OR doc_id = largest GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""

NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT * FROM usable WHERE vec_id % 100 = 0)),
scored AS (
  SELECT a, x.vec_id AS anchor_id, y.vec_id, x.label = y.label AS same, CAST(list_inner_product(x.v, y.v) AS BIGINT) AS score
  FROM anchors x JOIN usable y ON x.vec_id <> y.vec_id),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
placed AS (
  SELECT o.a, o.anchor_id, o.vec_id AS positive_id, o.p, n.vec_id AS negative_id, o.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY o.a, o.p ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives o JOIN scored n ON o.a = n.a AND NOT n.same AND 30 * o.score <= 100 * n.score AND 100 * n.score <= 90 * o.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM placed WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_host_reputation": REPUTATION, "op10_phrase_automata": PHRASES, "op11_spelling_variants": SPELLING,
        "op12_line_dedup": LINES, "op13_hard_negatives": NEGATIVES,
    }
