"""The registered queries once more, as SQL over the raw tables.

Written set-wise from the rules of the merge, apart from the DataFrame code, so
that the two can be compared. Runs in DuckDB.
"""

from __future__ import annotations

from histmerge.functions.keys import VISIT_TYPES
from histmerge.sources.derived import DUCKDB, render, with_views
from histmerge.sources.schema import ORIGINS, PLACES, VISITS, Field

RUN_ID = "registered-query"
NOW_US = 1_717_200_000_000_000


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes and one 0xFF byte, bit by bit."""
    data = f"(hex(encode({text})) || 'FF')"
    bits = (
        f"list_transform(range(0, length({data}) * 4), lambda i: CAST((CAST('0x' || "
        f"substr({data}, CAST(2 * (i // 8) + 1 AS INT), 2) AS BIGINT) >> (i % 8)) & 1 AS BIGINT))"
    )
    rest = (
        f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}),"
        " lambda a, b: xor(a >> 1, (xor(a, b) & 1) * 3988292384))"
    )
    return f"xor({rest}, 4294967295)"


def _guid(*key: str) -> str:
    """A UUID-shaped id from the run id and the key."""
    digest = "md5(concat_ws(chr(31), " + ", ".join([f"'{RUN_ID}'", *key]) + "))"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-3' || "
        f"substr({digest}, 14, 3) || '-' || translate(substr({digest}, 17, 1), "
        f"'0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || "
        f"substr({digest}, 21, 12)"
    )


def _label(column: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{label}'" for n, label in VISIT_TYPES.items())
    return f"CASE {column} {cases} ELSE 'other(' || {column} || ')' END"


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR"}


def _declared(fields: list[Field], view: str, has: list[str]) -> str:
    """All declared columns of a view that holds only some."""
    columns = []
    for f in fields:
        kind = SQL_TYPES[f.type.simpleString()]
        default = "NULL" if f.default is None else repr(f.default).upper()
        source = f.name if f.name in has else default
        columns.append(f"CAST({source} AS {kind}) AS {f.name}")
    return f"SELECT {', '.join(columns)} FROM {view}"


ORIGIN_COLUMNS = ["id", "prefix", "host", "frecency"]
PLACE_COLUMNS = [
    "id", "url", "title", "rev_host", "visit_count", "hidden", "typed", "frecency",
    "last_visit_date", "guid", "foreign_count", "url_hash", "site_name", "origin_id",
    "recalc_frecency",
]
VISIT_COLUMNS = [
    "id", "from_visit", "place_id", "visit_date", "visit_type", "session", "triggering_place_id",
]

DECLARED = f"""
so AS ({_declared(ORIGINS, "src_origins", ORIGIN_COLUMNS)}),
dor AS ({_declared(ORIGINS, "dst_origins", ORIGIN_COLUMNS)}),
sp AS ({_declared(PLACES, "src_places", PLACE_COLUMNS)}),
dp AS ({_declared(PLACES, "dst_places", PLACE_COLUMNS)}),
sv AS ({_declared(VISITS, "src_visits", VISIT_COLUMNS)}),
dv AS ({_declared(VISITS, "dst_visits", VISIT_COLUMNS)}),
"""

ORIGIN_MERGE = """
origin_seen AS (SELECT prefix, host, max(id) AS dst_id FROM dor GROUP BY prefix, host),
origin_new AS (
  SELECT prefix, host, first_id,
         (SELECT coalesce(max(id), 0) FROM dor) + row_number() OVER (ORDER BY first_id) AS new_id
  FROM (SELECT prefix, host, min(id) AS first_id FROM so GROUP BY prefix, host) g
  WHERE NOT EXISTS (SELECT 1 FROM dor d WHERE d.prefix = g.prefix AND d.host = g.host)),
origin_ids AS (
  SELECT s.id AS old_id, CAST(coalesce(d.dst_id, n.new_id) AS BIGINT) AS new_id
  FROM so s LEFT JOIN origin_seen d USING (prefix, host) LEFT JOIN origin_new n USING (prefix, host)),
merged_origins AS (
  SELECT * FROM dor UNION ALL
  SELECT s.* REPLACE (CAST(n.new_id AS BIGINT) AS id)
  FROM so s JOIN origin_new n ON n.first_id = s.id),
"""

PLACE_MERGE = f"""
places_moved AS (
  SELECT p.*, m.new_id AS moved FROM sp p LEFT JOIN origin_ids m ON m.old_id = p.origin_id),
place_groups AS (
  SELECT url_hash, url, CAST(sum(visit_count) AS BIGINT) AS visits, bool_or(hidden) AS hid,
         max(typed) AS typ, CAST(sum(foreign_count) AS BIGINT) AS fc,
         max(last_visit_date) AS last_date, max_by(moved, id) FILTER (moved IS NOT NULL) AS origin,
         min(id) AS first_id, count(*) AS source_rows
  FROM places_moved GROUP BY url_hash, url),
place_seen AS (SELECT url_hash, url, max(id) AS dst_id FROM dp GROUP BY url_hash, url),
place_groups_seen AS (SELECT * FROM place_groups LEFT JOIN place_seen USING (url_hash, url)),
place_new AS (
  SELECT *, CAST((SELECT coalesce(max(id), 0) FROM dp)
                 + row_number() OVER (ORDER BY first_id) AS BIGINT) AS new_id
  FROM place_groups_seen WHERE dst_id IS NULL),
place_ids AS (
  SELECT s.id AS old_id, coalesce(d.dst_id, n.new_id) AS new_id
  FROM sp s LEFT JOIN place_seen d USING (url_hash, url)
  LEFT JOIN (SELECT url_hash, url, new_id FROM place_new) n USING (url_hash, url)),
places_kept AS (
  SELECT d.* REPLACE (
    CASE WHEN g.first_id IS NULL THEN d.visit_count ELSE d.visit_count + g.visits END AS visit_count,
    CASE WHEN g.first_id IS NULL THEN d.hidden ELSE d.hidden OR g.hid END AS hidden,
    CASE WHEN g.first_id IS NULL THEN d.typed ELSE greatest(d.typed, g.typ) END AS typed,
    CASE WHEN g.first_id IS NULL THEN d.foreign_count ELSE d.foreign_count + g.fc END
      AS foreign_count,
    CASE WHEN g.last_date IS NULL THEN d.last_visit_date
         WHEN d.last_visit_date IS NULL THEN g.last_date
         ELSE greatest(d.last_visit_date, g.last_date) END AS last_visit_date,
    coalesce(g.origin, d.origin_id) AS origin_id,
    CASE WHEN g.first_id IS NULL THEN d.recalc_frecency ELSE 1 END AS recalc_frecency)
  FROM dp d LEFT JOIN place_groups_seen g ON g.dst_id = d.id),
places_inserted AS (
  SELECT s.* REPLACE (
    n.new_id AS id, n.visits AS visit_count, n.hid AS hidden, n.typ AS typed,
    n.fc AS foreign_count, n.last_date AS last_visit_date,
    coalesce(n.origin, s.origin_id) AS origin_id,
    CASE WHEN n.source_rows > 1 THEN 1 ELSE s.recalc_frecency END AS recalc_frecency,
    {_guid("s.url_hash", "s.url")} AS guid, {_crc32("s.url")} AS url_hash)
  FROM sp s JOIN place_new n ON n.first_id = s.id),
merged_places AS (SELECT * FROM places_kept UNION ALL SELECT * FROM places_inserted),
scored_places AS (
  SELECT * REPLACE (
    CASE WHEN recalc_frecency <> 1 THEN frecency
         WHEN last_visit_date IS NULL OR visit_count = 0 THEN -1
         ELSE CAST(trunc(CAST(visit_count AS DOUBLE) * CAST(1000 AS DOUBLE)
           / (CAST({NOW_US} - last_visit_date AS DOUBLE) / CAST(86400000000 AS DOUBLE)
              + CAST(1 AS DOUBLE))) AS BIGINT) END AS frecency,
    CAST(CASE WHEN recalc_frecency = 1 THEN 0 ELSE recalc_frecency END AS BIGINT)
      AS recalc_frecency)
  FROM merged_places),
"""

VISIT_MERGE = """
visits_moved AS (
  SELECT v.* REPLACE (coalesce(m.new_id, v.place_id) AS place_id)
  FROM sv v LEFT JOIN place_ids m ON m.old_id = v.place_id),
visits_first AS (
  SELECT * FROM visits_moved
  QUALIFY row_number() OVER (PARTITION BY place_id, visit_date, visit_type ORDER BY id) = 1),
visits_inserted AS (
  SELECT * REPLACE (CAST((SELECT coalesce(max(id), 0) FROM dv)
                         + row_number() OVER (ORDER BY id) AS BIGINT) AS id)
  FROM visits_first f
  WHERE NOT EXISTS (SELECT 1 FROM dv d WHERE d.place_id = f.place_id
                    AND d.visit_date = f.visit_date AND d.visit_type = f.visit_type)),
merged_visits AS (SELECT * FROM dv UNION ALL SELECT * FROM visits_inserted),
"""

COUNTS = """
counts AS (
  SELECT (SELECT count(*) FROM so) AS origins_read,
         (SELECT count(*) FROM origin_new) AS origins_inserted,
         (SELECT count(*) FROM sp) AS places_read,
         (SELECT count(*) FROM place_new) AS places_inserted,
         (SELECT count(*) FROM sv) AS visits_read,
         (SELECT count(*) FROM visits_inserted) AS visits_inserted),
stats AS (
  SELECT origins_read, origins_inserted, origins_read - origins_inserted AS origins_merged,
         places_read, places_inserted, places_read - places_inserted AS places_merged,
         visits_read, visits_inserted, visits_read - visits_inserted AS visits_skipped,
         CAST(0 AS BIGINT) AS duration_ms
  FROM counts),
stats_text AS (
  SELECT '{"origins_read":' || origins_read || ',"origins_inserted":' || origins_inserted
    || ',"origins_merged":' || origins_merged || ',"places_read":' || places_read
    || ',"places_inserted":' || places_inserted || ',"places_merged":' || places_merged
    || ',"visits_read":' || visits_read || ',"visits_inserted":' || visits_inserted
    || ',"visits_skipped":' || visits_skipped || ',"duration_ms":0}' AS stats_json
  FROM stats),
"""

UP_TO_ORIGINS = DECLARED + ORIGIN_MERGE
UP_TO_PLACES = UP_TO_ORIGINS + PLACE_MERGE
UP_TO_VISITS = UP_TO_PLACES + VISIT_MERGE
UP_TO_STATS = UP_TO_VISITS + COUNTS
ORPHANS = (
    "SELECT count(*) AS orphans FROM {0} v WHERE NOT EXISTS"
    " (SELECT 1 FROM merged_places p WHERE p.id = v.place_id)"
)

LOOKUP = r"""
bare AS (SELECT page_id, host AS name, regexp_replace(page_url, '^[a-z]+://[^/]+/', '') AS rest
         FROM site_pages),
site AS (SELECT name, '/site/' || name || CASE WHEN page_id % 3 = 0 THEN '/./' ELSE '//' END || rest
                AS path FROM bare),
asked AS (
  SELECT name AS q FROM bare
  UNION SELECT CASE WHEN page_id % 2 = 1 THEN name || '/./' ELSE '' END || rest FROM bare
  UNION SELECT regexp_extract(name, '^([^.]+)', 1) FROM bare
  UNION SELECT name || '/none' FROM bare),
clean_site AS (SELECT name, regexp_replace(regexp_replace(path, '/(\./|/)+', '/', 'g'), '/$', '') AS path
               FROM site),
clean AS (SELECT q, regexp_replace(regexp_replace(q, '/(\./|/)+', '/', 'g'), '/$', '') AS cq FROM asked),
hits AS (
  SELECT q, 'name' AS tier, name FROM asked JOIN site ON name = q
  UNION ALL
  SELECT q, 'path', name FROM clean JOIN clean_site
    ON cq = '' OR path = cq OR ends_with(path, '/' || cq)
  UNION ALL
  SELECT q, 'part', name FROM asked JOIN site ON contains(name, q)),
tiers AS (
  SELECT q, count(*) FILTER (tier = 'name') AS name_hits,
         count(*) FILTER (tier = 'path') AS path_hits,
         count(*) FILTER (tier = 'part') AS part_hits,
         min(name) FILTER (tier = 'name') AS n1, min(name) FILTER (tier = 'path') AS n2,
         min(name) FILTER (tier = 'part') AS n3
  FROM asked LEFT JOIN hits USING (q) GROUP BY q),
answers AS (
  SELECT q, CASE WHEN 1 IN (name_hits, path_hits, part_hits) THEN 'found'
                 WHEN name_hits + path_hits + part_hits > 0 THEN 'ambiguous'
                 ELSE 'not found' END AS status,
         CASE WHEN name_hits = 1 THEN 'name' WHEN path_hits = 1 THEN 'path'
              WHEN part_hits = 1 THEN 'part' END AS tier,
         name_hits, path_hits, part_hits,
         CASE WHEN name_hits = 1 THEN n1 WHEN path_hits = 1 THEN n2
              WHEN part_hits = 1 THEN n3 END AS name
  FROM tiers),
"""

# Sides of the generic merges; the destination counts months from the 16th on.
ORDER_SIDES = """
order_src AS (
  SELECT o_orderkey AS id, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS last_order
  FROM orders),
order_dst AS (
  SELECT min(o_orderkey) AS id, o_custkey,
         CAST(date_trunc('month', o_orderdate - INTERVAL 15 DAY) AS DATE) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(max(o_orderdate) AS DATE) AS last_order
  FROM orders GROUP BY 2, 3),
"""
LINE_SIDES = """
line_src AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey, l_linenumber,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS ship_month
  FROM lineitem),
line_dst AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey, l_linenumber,
         CAST(date_trunc('month', l_shipdate - INTERVAL 15 DAY) AS DATE) AS ship_month
  FROM lineitem),
"""


def _repeated(name: str, table: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM (SELECT {key} FROM {table}"
        f" GROUP BY {key} HAVING count(*) > 1)) AS repeated"
    )


def _plain(select: str, more: str) -> str:
    return "WITH " + more.strip().rstrip(",") + "\n" + select


# A document with malformed bytes after its text, each sequence of them replaced.
REPAIRED = (
    "text || CASE WHEN doc_id IS NULL THEN '' WHEN (doc_id % 3 + 3) % 3 = 2"
    " THEN chr(65533) || chr(65533) ELSE chr(65533) END || coalesce(lang, '')"
)


def oracle_sql() -> dict[str, str]:
    """One statement per registered query."""
    origin_columns = ", ".join(f.name for f in ORIGINS)
    place_columns = ", ".join(f.name for f in PLACES)
    visit_columns = ", ".join(f.name for f in VISITS)
    sql = {
        "scan_origins": with_views("SELECT * FROM so", DECLARED),
        "scan_places": with_views("SELECT * FROM sp", DECLARED),
        "scan_visits": with_views("SELECT * FROM sv", DECLARED),
        "conform_schema": with_views("SELECT * FROM dp", DECLARED),
        "seed_keys": with_views(
            "SELECT 'origins' AS table_name, prefix || ' ' || host AS key, id FROM dor"
            " UNION ALL SELECT 'places', url_hash || ':' || url, id FROM dp"
            " UNION ALL SELECT 'visits', place_id || ':' || visit_date || ':' || visit_type, NULL"
            " FROM dv",
            DECLARED,
        ),
        "contract_violations": with_views(
            " UNION ALL ".join(
                f"SELECT '{name}' AS table_name, '{f.name}' AS column_name, {f.nullable} AS may_be_null,"
                f" count(*) FILTER ({f.name} IS NULL) AS nulls FROM {view}"
                for name, view, fields in (
                    ("origins", "so", ORIGINS), ("places", "sp", PLACES), ("visits", "sv", VISITS)
                )
                for f in fields
            ),
            DECLARED,
        ),
        "table_counts": with_views(
            "SELECT o AS origins, p AS places, v AS visits, o + p + v AS total_rows FROM (SELECT"
            " (SELECT count(*) FROM so) o, (SELECT count(*) FROM sp) p,"
            " (SELECT count(*) FROM sv) v)",
            DECLARED,
        ),
        "side_counts": with_views(
            "SELECT 'source' AS side, (SELECT count(*) FROM so) AS origins,"
            " (SELECT count(*) FROM sp) AS places, (SELECT count(*) FROM sv) AS visits"
            " UNION ALL SELECT 'destination', (SELECT count(*) FROM dor),"
            " (SELECT count(*) FROM dp), (SELECT count(*) FROM dv)",
            DECLARED,
        ),
        "origin_key": with_views(
            "SELECT id, prefix || ' ' || host AS origin_key FROM so", DECLARED
        ),
        "place_key": with_views(
            "SELECT id, url_hash || ':' || url AS place_key FROM sp", DECLARED
        ),
        "visit_key": with_views(
            "SELECT id, place_id || ':' || visit_date || ':' || visit_type AS visit_key FROM sv",
            DECLARED,
        ),
        "visit_type_label": with_views(
            f"SELECT id, visit_type, {_label('visit_type')} AS label FROM sv", DECLARED
        ),
        "origin_match": with_views(
            "SELECT s.id, prefix, host, dst_id FROM so s LEFT JOIN origin_seen USING (prefix, host)",
            UP_TO_ORIGINS,
        ),
        "merge_origins": with_views(f"SELECT {origin_columns} FROM merged_origins", UP_TO_ORIGINS),
        "origin_id_map": with_views("SELECT old_id, new_id FROM origin_ids", UP_TO_ORIGINS),
        "remap_origin_fk": with_views(
            "SELECT p.id, coalesce(m.new_id, p.origin_id) AS origin_id FROM sp p"
            " LEFT JOIN origin_ids m ON m.old_id = p.origin_id",
            UP_TO_ORIGINS,
        ),
        "place_match": with_views(
            "SELECT s.id, url_hash, url, dst_id FROM sp s LEFT JOIN place_seen USING (url_hash, url)",
            UP_TO_PLACES,
        ),
        "collapse_places": with_views(
            "SELECT url_hash, url, visits AS visit_count, hid AS hidden, typ AS typed,"
            " fc AS foreign_count, last_date AS last_visit_date, origin AS origin_id,"
            " first_id, source_rows FROM place_groups",
            UP_TO_PLACES,
        ),
        "first_per_key": with_views(
            f"SELECT {place_columns} FROM sp"
            " QUALIFY row_number() OVER (PARTITION BY url_hash, url ORDER BY id) = 1",
            DECLARED,
        ),
        "assign_ids": with_views(
            "SELECT id AS old_id, CAST((SELECT max(id) FROM dv) + row_number() OVER (ORDER BY id)"
            " AS BIGINT) AS new_id FROM sv",
            DECLARED,
        ),
        "merge_places": with_views(f"SELECT {place_columns} FROM merged_places", UP_TO_PLACES),
        "place_id_map": with_views("SELECT old_id, new_id FROM place_ids", UP_TO_PLACES),
        "guid_derived": with_views(f"SELECT id, {_guid('url_hash', 'url')} AS guid FROM sp", DECLARED),
        "remap_place_fk": with_views(
            f"SELECT {visit_columns} FROM visits_moved", UP_TO_VISITS
        ),
        "visits_new": with_views(
            f"SELECT {visit_columns} FROM visits_moved f WHERE NOT EXISTS (SELECT 1 FROM dv d"
            " WHERE d.place_id = f.place_id AND d.visit_date = f.visit_date"
            " AND d.visit_type = f.visit_type)",
            UP_TO_VISITS,
        ),
        "visits_existing": with_views(
            f"SELECT {visit_columns} FROM visits_moved f WHERE EXISTS (SELECT 1 FROM dv d"
            " WHERE d.place_id = f.place_id AND d.visit_date = f.visit_date"
            " AND d.visit_type = f.visit_type)",
            UP_TO_VISITS,
        ),
        "merge_visits": with_views(f"SELECT {visit_columns} FROM visits_inserted", UP_TO_VISITS),
        "union_tables": with_views(f"SELECT {visit_columns} FROM merged_visits", UP_TO_VISITS),
        "orphan_visits": with_views(ORPHANS.format("merged_visits"), UP_TO_VISITS),
        "dangling_origins": with_views(
            'SELECT origin_id, count(*) AS "rows" FROM merged_places p WHERE origin_id IS NOT NULL'
            " AND NOT EXISTS (SELECT 1 FROM merged_origins o WHERE o.id = p.origin_id)"
            " GROUP BY origin_id",
            UP_TO_PLACES,
        ),
        "place_origin_inner": with_views(
            "SELECT p.id, p.url, o.prefix, o.host FROM merged_places p"
            " JOIN merged_origins o ON o.id = p.origin_id",
            UP_TO_PLACES,
        ),
        "mismatched_origins": with_views(
            "SELECT p.id, p.url, o.prefix, o.host FROM merged_places p"
            " JOIN merged_origins o ON o.id = p.origin_id"
            " WHERE NOT starts_with(p.url, concat(o.prefix, o.host))",
            UP_TO_PLACES,
        ),
        "unmapped_visits": with_views(
            "SELECT count(*) AS unmapped FROM sv v WHERE v.place_id IS NOT NULL"
            " AND NOT EXISTS (SELECT 1 FROM sp p WHERE p.id = v.place_id)",
            DECLARED,
        ),
        "rescore": with_views(f"SELECT {place_columns} FROM scored_places", UP_TO_PLACES),
        "score_flagged": with_views(
            "SELECT s.id, s.frecency FROM scored_places s JOIN merged_places m ON m.id = s.id"
            " WHERE m.recalc_frecency = 1",
            UP_TO_PLACES,
        ),
        "nullsafe_max": with_views(
            "SELECT s.id, CASE WHEN s.last_visit_date IS NULL THEN d.last_visit_date"
            " WHEN d.last_visit_date IS NULL THEN s.last_visit_date"
            " ELSE greatest(s.last_visit_date, d.last_visit_date) END AS last_visit_date"
            " FROM sp s JOIN dp d USING (url_hash, url)",
            DECLARED,
        ),
        "merge_stats": with_views("SELECT * FROM stats", UP_TO_STATS),
        "dry_run_stats": with_views("SELECT * FROM stats", UP_TO_STATS),
        "stats_report": with_views(
            "SELECT 'origins' AS table_name, origins_read AS rows_read,"
            " origins_inserted AS rows_inserted, origins_merged AS rows_merged_or_skipped FROM stats"
            " UNION ALL SELECT 'places', places_read, places_inserted, places_merged FROM stats"
            " UNION ALL SELECT 'visits', visits_read, visits_inserted, visits_skipped FROM stats",
            UP_TO_STATS,
        ),
        "stats_json": with_views("SELECT stats_json FROM stats_text", UP_TO_STATS),
        "meta_upsert": with_views(
            "SELECT 'origins' AS key, CAST((SELECT count(*) FROM dor) AS VARCHAR) AS value"
            " UNION ALL SELECT 'places', CAST((SELECT count(*) FROM dp) AS VARCHAR)"
            " UNION ALL SELECT 'visits', CAST((SELECT count(*) FROM dv) AS VARCHAR)"
            f" UNION ALL SELECT 'last_migration', '{NOW_US}'"
            " UNION ALL SELECT 'migration_stats', stats_json FROM stats_text",
            UP_TO_STATS,
        ),
        "validation_report": with_views(
            "SELECT 'rows_moved' AS check_name, places_read + visits_inserted AS value,"
            " places_read + visits_inserted > 0 AS passed FROM stats"
            " UNION ALL SELECT 'orphan_visits', orphans, orphans = 0 FROM"
            f" ({ORPHANS.format('merged_visits')})"
            " UNION ALL SELECT 'new_orphan_visits', orphans, orphans = 0 FROM"
            f" ({ORPHANS.format('visits_inserted')})",
            UP_TO_STATS,
        ),
        "repeated_keys": with_views(
            " UNION ALL ".join(
                [
                    _repeated("merged origins", "merged_origins", "prefix, host"),
                    _repeated("merged places", "merged_places", "guid"),
                    _repeated("source places", "sp", "url_hash, url"),
                    _repeated("source visits", "sv", "place_id, visit_date, visit_type"),
                ]
            ),
            UP_TO_PLACES,
        ),
        "merge_history_counts": with_views(
            "SELECT 'origins' AS table_name, (SELECT count(*) FROM dor) AS rows_before,"
            " (SELECT count(*) FROM merged_origins) AS rows_after"
            " UNION ALL SELECT 'places', (SELECT count(*) FROM dp),"
            " (SELECT count(*) FROM merged_places)"
            " UNION ALL SELECT 'visits', (SELECT count(*) FROM dv),"
            " (SELECT count(*) FROM merged_visits)",
            UP_TO_STATS,
        ),
        "publish_versioned": with_views(
            f"SELECT {place_columns} FROM scored_places", UP_TO_STATS
        ),
        "publish_second_run": with_views(
            "SELECT v.id, v.place_id, v.visit_date, v.visit_type, p.url FROM merged_visits v"
            " JOIN merged_places p ON p.id = v.place_id",
            UP_TO_STATS,
        ),
        "incremental_visits": with_views(
            f"SELECT {visit_columns} FROM merged_visits", UP_TO_VISITS
        ),
        "tiered_lookup": with_views(
            "SELECT q, status, tier, name_hits, path_hits, part_hits, name FROM answers", LOOKUP
        ),
        "ambiguous_names": with_views(
            "SELECT DISTINCT q, h.name FROM hits h JOIN answers a USING (q)"
            " WHERE a.status = 'ambiguous'",
            LOOKUP,
        ),
        "default_per_group": (
            "SELECT c_nationkey, min(c_custkey) FILTER (c_acctbal > 0) AS c_custkey,"
            " CASE WHEN count(*) FILTER (c_acctbal > 0) > 0 THEN 'default' ELSE 'no default' END"
            " AS status FROM customer GROUP BY c_nationkey"
        ),
        "text_repair": f"SELECT doc_id, {REPAIRED} AS text, lang FROM documents",
        "text_repair_required": (
            f"SELECT doc_id, coalesce({REPAIRED}, '') AS text, coalesce(lang, '') AS lang"
            " FROM documents"
        ),
        "url_hash": f"SELECT page_id, {_crc32('url')} AS url_hash FROM pages",
        "merge_dimension_orders": _plain(
            "SELECT d.id, d.o_custkey, d.month, d.cents + coalesce(g.cents, 0) AS cents,"
            " greatest(d.last_order, coalesce(g.last_order, d.last_order)) AS last_order"
            " FROM order_dst d LEFT JOIN g USING (o_custkey, month)"
            " UNION ALL"
            " SELECT CAST((SELECT max(id) FROM order_dst) + row_number() OVER (ORDER BY first_id)"
            " AS BIGINT), o_custkey, month, cents, last_order FROM g"
            " WHERE NOT EXISTS (SELECT 1 FROM order_dst d WHERE d.o_custkey = g.o_custkey"
            " AND d.month = g.month)",
            ORDER_SIDES
            + "g AS (SELECT o_custkey, month, CAST(sum(cents) AS BIGINT) AS cents,"
            " max(last_order) AS last_order, min(id) AS first_id FROM order_src GROUP BY 1, 2)",
        ),
        "merge_facts_lineitem": _plain(
            "SELECT CAST((SELECT max(id) FROM line_dst) + row_number() OVER"
            " (ORDER BY first_id, l_suppkey, ship_month, l_linenumber) AS BIGINT) AS id,"
            " l_suppkey, l_linenumber, ship_month"
            " FROM (SELECT min(id) AS first_id, l_suppkey, l_linenumber, ship_month FROM line_src"
            " GROUP BY ALL) f WHERE NOT EXISTS (SELECT 1 FROM line_dst d"
            " WHERE d.l_suppkey = f.l_suppkey AND d.ship_month = f.ship_month"
            " AND d.l_linenumber = f.l_linenumber)",
            LINE_SIDES,
        ),
    }
    return {name: render(text, DUCKDB) for name, text in sql.items()}
