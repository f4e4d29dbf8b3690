"""The same results in DuckDB SQL, written from the contracts; texts are taken whole."""

from __future__ import annotations

from accountloom.llm.mixing import NOISE
from accountloom.llm.quality_rules import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS words FROM {table}"


MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (
      (length(text) - length(translate(text, '{NOISE}', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE)),
      1.0::DOUBLE) AS w,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h FROM documents),
k AS (SELECT *, -ln((h::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
p AS (SELECT *, sum(source_size) OVER o - source_size AS size_before,
        sum(weight) OVER () - sum(weight) OVER o + weight AS weight_from FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2.0::DOUBLE * size_before::BIGINT) / weight_from
        AS level FROM p),
free AS (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio <= level OR NOT EXISTS (FROM free) THEN 2.0::DOUBLE * source_size
        ELSE (SELECT level FROM free) * weight END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
q AS (SELECT k.*, source_size, target, epochs, round(target)::BIGINT - epochs * source_size AS rest,
        (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
                         ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM q"""

DECONTAMINATE = f"""
WITH b AS ({_words(LOWERED, ALNUM, "benchmark", "coalesce(item_id::VARCHAR, '') AS item")}),
win AS (SELECT DISTINCT item, words[i:i + 9] AS grams FROM (
  SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
d AS ({_words(LOWERED, ALNUM)}),
sizes AS (SELECT DISTINCT len(grams) AS n FROM win),
place AS (SELECT doc_id, n, i, words[i:i + n - 1] AS grams FROM (
  SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item FROM place JOIN win USING (grams)),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
          FROM hit GROUP BY doc_id),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN covered USING (doc_id)"""

PHRASES = f"""
WITH d AS ({_words("coalesce(text, '')", WORD)}),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS phrase FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d WHERE len(words) > 0),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM word
         ANTI JOIN gone USING (doc_id, j) GROUP BY word.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS ({_words(LOWERED, WORD)}),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (
  SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.gram = b.gram AND a.doc_id < b.doc_id
         GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT doc_id, b FROM reach JOIN edge ON other = a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
           FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d WHERE len(words) > 0),
per_word AS (SELECT doc_id, sum(length(word)) AS word_chars, count(*) FILTER (lower(word) IN ({_STOP})) AS n_stop
             FROM word GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS gram FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again)
        GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
per_line AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS n_distinct FROM line
             WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        coalesce(per_line.n - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(per_line.n, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop
      FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN per_line USING (doc_id)),
f AS (SELECT *, concat_ws(',',
    CASE WHEN n_words < 50 THEN 'words' END,
    CASE WHEN n_words = 0 OR 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END,
    CASE WHEN n_words = 0 OR word_chars::DOUBLE / n_words NOT BETWEEN 2 AND 15 THEN 'word_length' END,
    CASE WHEN n_words = 0 OR n_symbols::DOUBLE / n_words > 0.1::DOUBLE THEN 'symbols' END,
    CASE WHEN n_words = 0 OR n_stop::DOUBLE / n_words < 0.02::DOUBLE THEN 'stop_words' END,
    CASE WHEN n_lines = 0 OR n_dup_lines::DOUBLE / n_lines > 0.4::DOUBLE THEN 'duplicate_lines' END) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = '' AS kept, failed FROM f"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g{g} >> {35 - 5 * i}) & 31)::INT, 1)"
    for g in range(4) for i in range(8))
_FORTY_BITS = ", ".join(f"('0x' || substr(hex, {1 + 10 * g}, 10))::BIGINT AS g{g}" for g in range(4))

ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first, {_FORTY_BITS} FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 100) AS s FROM (
  SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN first USING (s) WHERE doc_id > least),
runs AS (SELECT doc_id, count(*) AS removed, count(*) FILTER (fresh) AS spans FROM (
  SELECT doc_id, j, j - 1 IS DISTINCT FROM lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS fresh FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * j + 1)::INT, 2), '' ORDER BY j) AS h FROM (
  SELECT doc_id, h, unnest(range(n)) AS j FROM d SEMI JOIN runs USING (doc_id)) x ANTI JOIN gone USING (doc_id, j)
  GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

AUDIT = f"""
WITH said AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
        100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > first] AS f,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN said USING (doc_id)),
cell AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, f),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perm AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
step AS (SELECT p, k AS step, p[k] AS own, p[1:k - 1] AS earlier FROM perm, (SELECT i AS k FROM x)),
met AS (SELECT part, p, step, own, f[own] AS fails, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone,
          len(list_filter(f, lambda b: b)) = 1 AS alone, n, good, toxic FROM step, cell),
r AS (SELECT part, p, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept,
        coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
        coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM met GROUP BY part, p, step, own)
SELECT part, array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept,
  removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""

RESAMPLED = f"""
WITH RECURSIVE bit AS (SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
lookup AS (SELECT list(c ORDER BY byte) AS t FROM bit WHERE k = 8),
d AS ({_words(LOWERED, ALNUM)}),
b AS (SELECT regexp_extract_all({LOWERED}, '{ALNUM}') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
each AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
crc AS (SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM each, lookup),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / (((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))))::BIGINT AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
v AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)),
n AS (SELECT 10 * count(*) // 100 AS drawn FROM v WHERE n_features >= 20),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM v WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank
FROM v LEFT JOIN r USING (doc_id), n"""

ORACLE = {
    "op2_mixing": MIXING, "op3_decontaminate": DECONTAMINATE, "op4_phrase_dedup": PHRASES, "op5_jaccard_join": JACCARD,
    "op6_quality_rules": QUALITY, "op8_warc": ARCHIVES, "op10_suffix_dedup": SUFFIXES,
    "op11_filter_audit": AUDIT, "op13_importance": RESAMPLED,
}
