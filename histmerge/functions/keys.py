"""Natural keys, hashes and labels of history rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from histmerge.functions.columns import as_col

# Natural key columns of each table: what decides that two rows are the same.
ORIGIN_KEY = ["prefix", "host"]
PLACE_KEY = ["url_hash", "url"]
VISIT_KEY = ["place_id", "visit_date", "visit_type"]

# The visit types that have a name.
VISIT_TYPES = {
    1: "link",
    2: "typed",
    3: "bookmark",
    4: "embed",
    5: "redirect_permanent",
    6: "redirect_temporary",
    7: "download",
    8: "frame",
}


def origin_key(prefix: str | Column = "prefix", host: str | Column = "host") -> Column:
    """Readable origin key. Joins use the two columns, which cannot collide."""
    return F.concat_ws(" ", as_col(prefix), as_col(host))


def place_key(url_hash: str | Column = "url_hash", url: str | Column = "url") -> Column:
    """Readable place key."""
    return F.concat_ws(":", as_col(url_hash).cast("string"), as_col(url))


def visit_key(
    place_id: str | Column = "place_id",
    visit_date: str | Column = "visit_date",
    visit_type: str | Column = "visit_type",
) -> Column:
    """Readable visit key."""
    parts = [as_col(c).cast("string") for c in (place_id, visit_date, visit_type)]
    return F.concat_ws(":", *parts)


def visit_type_label(visit_type: str | Column = "visit_type") -> Column:
    """Name of a visit type; types without a name print as ``other(n)``."""
    code = as_col(visit_type)
    label = F.concat(F.lit("other("), code.cast("string"), F.lit(")"))
    for value, name in VISIT_TYPES.items():
        label = F.when(code == value, name).otherwise(label)
    return label


def url_hash(url: str | Column = "url") -> Column:
    """CRC-32 of the URL's UTF-8 bytes followed by one 0xFF byte, as a bigint.

    The trailing byte is part of the stored hash format; a bare CRC-32 of the
    URL gives another number and would never match stored rows.
    """
    return F.crc32(F.concat(F.encode(as_col(url), "UTF-8"), F.lit(b"\xff")))


def derived_guid(run_id: str, *key: str | Column) -> Column:
    """A UUID-shaped id from the run and the row's natural key.

    Unlike a random one it is the same when a lost task is computed again.
    Version digit 3 (name-based, MD5) and an RFC 4122 variant digit are set.
    """
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in key]
    digest = F.md5(F.concat_ws("\x1f", F.lit(run_id), *parts))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def random_guid() -> Column:
    """A random UUID. Write the rows once before they are read twice."""
    return F.uuid()
