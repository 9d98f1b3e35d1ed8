"""SQL counterparts of the queries that SQL can express."""

SPACE = r"[\x20\x09-\x0D]"
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = rf"""
words AS (SELECT doc_id, coalesce(text, '') AS text, source,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'),
                             lambda x: x <> '') AS w FROM documents)"""


def _windows(size: int) -> str:
    return f"""
windows AS (SELECT doc_id, pos, array_to_string(w[pos:pos + {size - 1}], ' ') AS gram
            FROM words, unnest(range(1, len(w) - {size - 2})) AS u(pos))"""


def _covered(size: int, source: str) -> str:
    """Number of words of a document inside the windows that start at ``source``'s positions."""
    return f"""
covered AS (SELECT doc_id, CAST(sum(least({size}, coalesce(next - pos, {size}))) AS BIGINT) AS n
            FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next
                  FROM {source}) GROUP BY doc_id)"""


QUALITY = rf"""
WITH {_WORDS},{_windows(8)},
twice AS (SELECT doc_id, pos FROM windows
          QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),{_covered(8, "twice")},
lines AS (SELECT doc_id, source, text, line,
                 regexp_replace(trim(lower(line), {TRIM}), '{SPACE}+', ' ', 'g') AS same,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
          FROM words, unnest(string_split(text, chr(10))) AS u(line)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM words GROUP BY source),
frequent AS (SELECT l.source, l.same, min(l.doc_id) AS first_doc FROM lines l JOIN hosts h
             ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.same, h.docs
             HAVING count(DISTINCT l.text) > greatest(50, 0.005 * h.docs)),
gone AS (SELECT l.doc_id, CAST(sum(l.n) AS BIGINT) AS n FROM lines l JOIN frequent f
         ON l.same = f.same AND l.source IS NOT DISTINCT FROM f.source
         WHERE l.doc_id <> f.first_doc GROUP BY l.doc_id),
counts AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM words),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
judged AS (SELECT c.*, coalesce(d.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
                  coalesce(g.n, 0) AS removed_words,
                  c.n_words < 20 OR 100 * coalesce(v.n, 0) > 30 * c.n_words AS base_failed
           FROM counts c LEFT JOIN dups d USING (doc_id) LEFT JOIN covered v USING (doc_id)
           LEFT JOIN gone g USING (doc_id))
SELECT *, NOT base_failed AND NOT (n_words - removed_words < 20
                                   OR n_words - removed_words < 0.3 * n_words) AS kept
FROM judged"""

SUBSTRINGS = f"""
WITH {_WORDS},{_windows(13)},
hits AS (SELECT doc_id, pos FROM windows
         QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hits, unnest(range(pos, pos + 13)) AS u(p)),
each AS (SELECT doc_id, w[p] AS word, p FROM words, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS text, count(*) AS n
         FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)"""

_TOKENS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

DECONTAMINATION = f"""
WITH words AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
items AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(10, len(w)) AS size,
                 array_to_string(w[pos:pos + least(10, len(w)) - 1], ' ') AS gram
          FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(pos) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM grams),
windows AS (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS gram
            FROM words, sizes, unnest(range(1, len(w) - size + 2)) AS u(pos)),
hits AS (SELECT doc_id, pos, size, item_id FROM windows JOIN grams USING (size, gram)),
found AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(pos, pos + size)) AS u(p)
           GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(i.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(i.n, 0) > 0 AS contaminated
FROM words d LEFT JOIN inside i USING (doc_id) LEFT JOIN found f USING (doc_id)"""

CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(text) + len(regexp_extract_all(text,
        '<\\*(<SYS>>|</SYS>>|/?s>)|\[\\*/?(INST|ROLE)\]|\[\\*END\]'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
                  ELSE 18 + length(role) END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))
           AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text),
                         '(system )?user( assistant user)*( assistant)?') AS valid
FROM sized GROUP BY conv_id"""


#: Words, features and their CRC-32 buckets; the checksum runs over the bytes of each distinct
#: feature, position by position, with the usual table made by rule.
RESAMPLING = rf"""
WITH RECURSIVE bits AS (SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1
  FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id, text FROM documents
          UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS MATERIALIZED (SELECT side, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
grams AS MATERIALIZED (SELECT side, doc_id, feature, count(*) AS n FROM (
    SELECT side, doc_id, unnest(w) AS feature FROM words
    UNION ALL SELECT side, doc_id, w[p] || ' ' || w[p + 1]
    FROM words, unnest(range(1, len(w))) AS u(p)
    UNION ALL SELECT side, doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]
    FROM words, unnest(range(1, len(w) - 1)) AS u(p)) GROUP BY ALL),
named AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, octet_length(encode(feature)) + 1),
                   lambda i: CAST(ascii(substr(hexed, 2 * i - 1, 1)) AS BIGINT) * 256
                             + ascii(substr(hexed, 2 * i, 1)))),
    lambda a, h: xor(a >> 8, t[1 + (xor(a, 16 * (h // 256 - CASE WHEN h // 256 > 57 THEN 55 ELSE 48 END)
                     + h % 256 - CASE WHEN h % 256 > 57 THEN 55 ELSE 48 END) & 255)])),
    4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature, hex(encode(feature)) AS hexed FROM grams), crc_table),
counts AS (SELECT g.side, bucket, sum(n) AS n FROM grams g JOIN named USING (feature) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
           FROM counts),
gains AS MATERIALIZED (SELECT b.i AS bucket, CAST(floor(1000 * ln(
    (coalesce(y.n, 0) + 1)::DOUBLE * (totals.s + 10000)::DOUBLE
    / ((coalesce(x.n, 0) + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS b(i) CROSS JOIN totals
  LEFT JOIN counts x ON x.bucket = b.i AND x.side = 0
  LEFT JOIN counts y ON y.bucket = b.i AND y.side = 1),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
            FROM grams JOIN named USING (feature) JOIN gains USING (bucket) WHERE side = 0
            GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(
        sha256('42:' || w.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights x ON x.doc_id = w.doc_id WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r,
                  count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND r <= 5 * eligible // 100 THEN r END AS rank FROM ranked"""


def _clustering(rounds: int = 10) -> str:
    """One pair of tables (assignment, moved centroids) per round over (vector, dimension) rows."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT n, arg_min(c, away * 8 + c) AS c, min(away) AS away FROM (
    SELECT n, c, sum((v.x - m.x) * (v.x - m.x)) AS away FROM comps v JOIN c{k} m USING (d)
    GROUP BY n, c) GROUP BY n)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (SELECT c, d, coalesce(CAST(floor(m.total / m.n) AS BIGINT), x) AS x
  FROM c{k} LEFT JOIN (SELECT a.c, d, sum(v.x) AS total, count(*) AS n
                       FROM a{k} a JOIN comps v USING (n) GROUP BY a.c, d) m USING (c, d))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER (
        ORDER BY sha256('3:' || vec_id), vec_id) - 1 AS n
    FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
comps AS MATERIALIZED (SELECT n, d, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, unnest(range(1, 65)) AS u(d)),
c0 AS MATERIALIZED (SELECT n AS c, d, x FROM comps WHERE n < 8),{",".join(steps)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256
          FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(away AS BIGINT) AS distance,
       CAST(sum(away) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(away) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (n) JOIN named USING (c)"""


CLUSTERING = _clustering()
