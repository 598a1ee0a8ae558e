"""Two history sides derived from whole ``pages`` and ``events`` tables.

The demonstration and bench input. Both sides read every row of both tables:

* The source is a browser that keeps one row per page visit target, filed under
  the page's site section (scheme, host, language), so one section has many rows.
  Its place ids skip every fifth number, which leaves visits without a place.
* The destination is a browser that only uses https, keeps one row per section,
  and starts its days at noon.

So http sections are new, https ones match, and visits of one section on one
day match where the two ways of counting days agree. The statements are written
once with tokens for what differs between SQL dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from histmerge.sources.schema import META, empty_table
from histmerge.sources.tables import History, scan_origins, scan_places, scan_visits

# Tokens: microseconds of a timestamp without zone, whatever the session's zone;
# 60 bits of a text's MD5.
SPARK = {
    "micros": (
        "(unix_date(CAST({0} AS DATE)) * 86400000000L + hour({0}) * 3600000000L"
        " + minute({0}) * 60000000L + CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT))"
    ),
    "hash60": "CAST(conv(substr(md5({0}), 1, 15), 16, 10) AS BIGINT)",
}
DUCKDB = {
    "micros": "epoch_us({0})",
    "hash60": "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)",
}

VIEWS = {
    "site_pages": r"""
        SELECT page_id, url AS page_url, html,
               regexp_extract(url, '^[a-z]+://[^/?#]+/[a-z]*', 0) AS url,
               regexp_extract(url, '^([a-z]+://)', 1) AS prefix,
               regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
               regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/[a-z]*', 0),
                              '^http://', 'https://') AS secure_url,
               CAST(floor(CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) / 100.0) AS BIGINT)
                 AS hundreds
        FROM pages""",
    "src_origins": r"""
        SELECT ${hash60(concat(prefix, host))} AS id, prefix, host,
               min(page_id) * 10 AS frecency
        FROM site_pages GROUP BY prefix, host""",
    "dst_origins": r"""
        SELECT min(page_id) + 1 AS id, 'https://' AS prefix, host,
               min(page_id) * 10 + 1 AS frecency
        FROM site_pages GROUP BY host""",
    "src_places": r"""
        SELECT page_id + CAST(floor(page_id / 4.0) AS BIGINT) + 1 AS id, url,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               concat(reverse(host), '.') AS rev_host, hundreds AS visit_count,
               (page_url LIKE '%utm_source%') AS hidden,
               CASE WHEN page_url LIKE '%.html' THEN 1 ELSE 0 END AS typed,
               CASE WHEN page_url LIKE '%#top' THEN 1 ELSE 0 END AS foreign_count,
               CASE WHEN page_url LIKE '%ref=x' THEN NULL
                    ELSE 1704067200000007 + page_id * 60000000 END AS last_visit_date,
               concat('source-', CAST(page_id AS VARCHAR(20))) AS guid,
               CAST(length(url) AS BIGINT) AS url_hash, host AS site_name,
               CASE WHEN page_url LIKE '%/' THEN NULL WHEN page_url LIKE '%ref=x' THEN page_id
                    ELSE ${hash60(concat(prefix, host))} END AS origin_id,
               CASE WHEN page_url LIKE '%#top' THEN 1 ELSE 0 END AS recalc_frecency,
               page_id * 100 AS frecency
        FROM site_pages""",
    "dst_places": r"""
        SELECT min(p.page_id) + 1 AS id, p.secure_url AS url,
               concat('Section ', p.secure_url) AS title,
               concat(reverse(p.host), '.') AS rev_host, min(p.hundreds) AS visit_count,
               (max(p.hundreds) < 5) AS hidden, min(p.hundreds) AS typed,
               max(p.hundreds) AS foreign_count,
               CASE WHEN max(p.hundreds) = 9 THEN NULL
                    ELSE 1704067200000003 + max(p.page_id) * 30000000 END AS last_visit_date,
               concat('destination-', CAST(min(p.page_id) AS VARCHAR(20))) AS guid,
               CAST(length(p.secure_url) AS BIGINT) AS url_hash, p.host AS site_name,
               o.id AS origin_id, CASE WHEN max(p.hundreds) < 3 THEN 1 ELSE 0 END AS recalc_frecency,
               min(p.page_id) * 100 + 1 AS frecency
        FROM site_pages p JOIN dst_origins o ON o.host = p.host
        GROUP BY p.secure_url, p.host, o.id""",
    "timed_events": r"""
        SELECT event_id, user_id, ${micros(ts)} AS us,
               CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
                    WHEN 'error' THEN 4 WHEN 'purchase' THEN 9 ELSE 7 END AS visit_type
        FROM events""",
    "src_visits": r"""
        SELECT event_id + 1 AS id, CASE WHEN event_id > 0 THEN event_id END AS from_visit,
               user_id + 1 AS place_id, us - us % 86400000000 AS visit_date, visit_type,
               user_id AS session, user_id + 1 AS triggering_place_id
        FROM timed_events""",
    "dst_visits": r"""
        SELECT e.event_id + 1 AS id, CASE WHEN e.event_id > 0 THEN e.event_id END AS from_visit,
               d.id AS place_id,
               (e.us - 43200000000) - (e.us - 43200000000) % 86400000000 AS visit_date,
               e.visit_type, e.user_id AS session, d.id AS triggering_place_id
        FROM timed_events e JOIN site_pages p ON p.page_id = e.user_id
        JOIN dst_places d ON d.url = p.secure_url""",
}


def render(statement: str, dialect: dict[str, str]) -> str:
    """Fill the dialect tokens ``${name(argument)}`` of a statement."""

    def fill(found: re.Match[str]) -> str:
        return dialect[found["name"]].format(found["argument"])

    return re.sub(r"\$\{(?P<name>\w+)\((?P<argument>[^}]*)\)\}", fill, statement)


def _needed(text: str) -> list[str]:
    """The views a statement reads, directly or through others, in order."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", text)]
    seen: set[str] = set()
    while names:
        name = names.pop()
        if name not in seen:
            seen.add(name)
            names += [n for n in VIEWS if re.search(rf"\b{n}\b", VIEWS[name])]
    return [n for n in VIEWS if n in seen]


def with_views(select: str, more: str = "", dialect: dict[str, str] = DUCKDB) -> str:
    """A query over the derived views as one statement over the raw tables.

    ``more`` holds further named subqueries, separated and ended by commas.
    """
    parts = [f"{n} AS ({render(VIEWS[n], dialect)})" for n in _needed(more + select)]
    parts += [more.strip().rstrip(",")] if more.strip() else []
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def derived_view(name: str, **tables: DataFrame) -> DataFrame:
    """One derived view over the raw tables it reads (``pages=``, ``events=``)."""
    spark = next(iter(tables.values())).sparkSession
    statement = with_views(f"SELECT * FROM {name}", dialect=SPARK)
    for table in tables:
        statement = re.sub(rf"FROM {table}\b", f"FROM {{{table}}}", statement)
    return spark.sql(statement, **tables)


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables the views read."""
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "events")}


def derived_history(spark: SparkSession, sf_dir: str, side: str) -> History:
    """One side ("src" or "dst") as a history of the declared schemas."""
    raw = raw_tables(spark, sf_dir)
    return History(
        scan_origins(derived_view(f"{side}_origins", **raw)),
        scan_places(derived_view(f"{side}_places", **raw)),
        scan_visits(derived_view(f"{side}_visits", **raw)),
        empty_table(spark, META),
    )
