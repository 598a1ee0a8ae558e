"""The results of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The word rule of the queries.
WORDS = r"[^\x20\x09-\x0D]+"

MIX = rf"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s,
         coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents
), by_source AS (
  SELECT s, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY s
), filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
            - 2.0::DOUBLE * coalesce(sum(source_size) OVER fullest, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER fullest, 0) AS rest_weight
  FROM by_source
  WINDOW fullest AS (ORDER BY source_size::DOUBLE / weight, s
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (rest::DOUBLE / rest_weight::DOUBLE) AS level FROM filled
), stopped AS (
  SELECT *, weight * level >= 2 * source_size AS stops FROM leveled
), targets AS (
  SELECT s, source_size,
         CASE WHEN stops THEN source_size::DOUBLE * 2
              ELSE weight * (SELECT arg_min(level, source_size::DOUBLE / weight) FROM stopped
                             WHERE NOT stops AND source_size::DOUBLE / weight =
                               (SELECT min(source_size::DOUBLE / weight) FROM stopped WHERE NOT stops)
                            ) END AS target
  FROM stopped
), by_hash AS (
  SELECT s, h, sum(size) AS words FROM sized GROUP BY s, h
), placed AS (
  SELECT by_hash.*, target, source_size,
         sum(words) OVER (PARTITION BY s ORDER BY h) - words AS below
  FROM by_hash JOIN targets USING (s)
), taken_of AS (
  SELECT s, h, target, source_size,
         CASE WHEN target >= source_size THEN 1
              WHEN below + words <= target THEN 1
              WHEN below > target THEN 0
              WHEN (target - below) * 2 >= words THEN 1 ELSE 0 END
         + CASE WHEN target - source_size >= source_size THEN 1
                WHEN target <= source_size THEN 0
                WHEN below + words <= target - source_size THEN 1
                WHEN below > target - source_size THEN 0
                WHEN (target - source_size - below) * 2 >= words THEN 1 ELSE 0 END AS takings
  FROM placed
)
SELECT doc_id, size, source_size, target, size * takings::BIGINT AS taken
FROM sized JOIN taken_of USING (s, h)
"""

URLS = rf"""
WITH split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            '{UPPER}', '{UPPER.lower()}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""

JACCARD = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
  END AS shingles FROM worded
), sizes AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM sets),
exploded AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM exploded a JOIN exploded b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL
  HAVING 100 * count(*) >= 90 * (any_value(x.n_shingles) + any_value(y.n_shingles) - count(*))
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
)
SELECT s.doc_id, s.n_shingles, coalesce(min(r.root), s.doc_id) AS component_id
FROM sizes s LEFT JOIN reach r ON r.node = s.doc_id
GROUP BY s.doc_id, s.n_shingles
"""



def crc_table() -> list[int]:
    """The CRC-32 remainders of all bytes."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (value & 1) * 0xEDB88320
        out.append(value)
    return out


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, as SQL."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"lambda a, b: xor(a >> 8, ({crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), {step}), 4294967295)"


SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k,
         unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[a-zÀ-ÿ]{{7,}}')) AS run
  FROM documents
), counted AS (SELECT k, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc32("k || ':' || run")} AS h FROM counted),
words AS (
  SELECT CASE WHEN h % 31 = 0
              THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, times
  FROM hashed
), vocab AS (
  SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 7
  GROUP BY word HAVING sum(times) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n
  FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocab b ON b.word = a.head || a.tail
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocab b ON b.word = a.head || a.tail
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place,
         count(*) OVER (PARTITION BY word) AS n_near
  FROM near
), found AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 10 * v.n THEN near END AS form,
         CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), follow(word, reached) AS (
  SELECT word, word FROM found
  UNION ALL
  SELECT f.word, g.form FROM follow f JOIN found g ON g.word = f.reached WHERE g.form IS NOT NULL
), ends AS (
  SELECT f.word, f.reached AS root FROM follow f JOIN found g ON g.word = f.reached WHERE g.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)
"""

SHARDS = f"""
WITH leaves(region, rack, shard, old) AS (
  SELECT s // 4, s % 4 // 2, s::INT, true FROM range(16) t(s) UNION ALL VALUES (4, 0, 16, false)
), trees AS (
  SELECT region, rack, shard, grown FROM leaves, (VALUES (true), (false)) t(grown) WHERE old OR grown
), nodes AS (
  SELECT grown, region, NULL AS rack, NULL AS shard, region::VARCHAR AS name, count(*) AS weight
  FROM trees GROUP BY ALL
  UNION ALL
  SELECT grown, region, rack, NULL, region || '/' || rack, count(*) FROM trees GROUP BY ALL
  UNION ALL
  SELECT grown, region, rack, shard, region || '/' || rack || '/' || shard, 1 FROM trees
), keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents),
drawn AS (
  SELECT k, nodes.*, -ln((('0x' || substr(md5(name || ':' || k), 1, 13))::BIGINT::DOUBLE + 0.5)
                         / power(16::DOUBLE, 13)) / weight AS draw
  FROM keys, nodes
), in_region AS (
  SELECT k, grown, arg_min(region, draw) AS region FROM drawn WHERE rack IS NULL GROUP BY ALL
), in_rack AS (
  SELECT k, grown, region, arg_min(rack, draw) AS rack FROM drawn JOIN in_region USING (k, grown, region)
  WHERE rack IS NOT NULL AND shard IS NULL GROUP BY ALL
), in_shard AS (
  SELECT k, grown, arg_min(shard, draw) AS shard FROM drawn JOIN in_rack USING (k, grown, region, rack)
  WHERE shard IS NOT NULL GROUP BY ALL
), sized AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, (coalesce(strlen(text), 0) + 1)::BIGINT AS size,
         {crc32("coalesce(text, '')")} AS text_crc32
  FROM documents
)
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INT AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       b.shard::INT AS grown_shard
FROM sized JOIN in_shard a ON a.k = sized.k AND NOT a.grown JOIN in_shard b ON b.k = sized.k AND b.grown
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": MIX,
        "op8_url_filters": URLS,
        "op9_ngram_jaccard": JACCARD,
        "op11_spelling_variants": SPELLING,
        "op13_sharding": SHARDS,
    }
