import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from histmerge.functions import keys as K
from histmerge.functions.score import age_days, decayed_score, later_of
from histmerge.functions.text import repair_text, repair_text_required
from tests.conftest import rows

MALFORMED = [
    b"plain",
    "caf\u00e9 \u4e2d \U0001f600".encode(),
    b"stray \x80 byte",
    b"cut \xc3",
    b"cut \xe4\xb8 off",
    b"overlong \xc0\xaf",
    b"surrogate \xed\xa0\x80",
    b"too far \xf4\x90\x80\x80",
    b"\xff\xfe",
    b"",
    None,
]


def test_text_repair_replaces_each_malformed_part(spark):
    df = spark.createDataFrame(list(enumerate(MALFORMED)), "id bigint, b binary")
    got = df.select("id", repair_text("b").alias("t"), repair_text_required("b").alias("r"))
    want = {
        i: None if b is None else b.decode("utf-8", errors="replace")
        for i, b in enumerate(MALFORMED)
    }
    for row in got.collect():
        assert row["t"] == want[row["id"]]
        assert row["r"] == (want[row["id"]] or "")


URLS = ["https://example.com/", "", "a", "https://example.com/\u00fc?q=1", "x" * 3000]


def test_url_hash_is_the_crc_with_its_trailing_byte(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r["url"]: r["h"] for r in df.select("url", K.url_hash().alias("h")).collect()}
    assert got == {u: zlib.crc32(u.encode() + b"\xff") for u in URLS}
    assert got["https://example.com/"] == 2127969085
    assert len(set(got.values())) == len(URLS)


def test_visit_type_labels(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 7, 8, 0, 9, -3)], "visit_type int")
    got = dict(rows(df.select("visit_type", K.visit_type_label())))
    assert got[1] == "link" and got[8] == "frame" and got[5] == "redirect_permanent"
    assert (got[0], got[9], got[-3]) == ("other(0)", "other(9)", "other(-3)")


def test_readable_keys(spark):
    df = spark.sql(
        "SELECT 'https://' AS prefix, 'a.b' AS host, 7L AS url_hash, 'u' AS url,"
        " 1L AS place_id, 2L AS visit_date, 3 AS visit_type"
    )
    got = df.select(K.origin_key(), K.place_key(), K.visit_key()).first()
    assert tuple(got) == ("https:// a.b", "7:u", "1:2:3")


def test_guid_has_uuid_form_and_depends_on_run_and_key(spark):
    df = spark.range(200).select("id", F.col("id").cast("string").alias("url"))
    one = rows(df.select(K.derived_guid("run", "id", "url")))
    again = rows(df.select(K.derived_guid("run", "id", "url")))
    other = rows(df.select(K.derived_guid("later run", "id", "url")))
    assert one == again and not set(one) & set(other)
    assert len(set(one)) == 200
    for (text,) in one:
        parsed = uuid.UUID(text)
        assert str(parsed) == text and parsed.version == 3
        assert parsed.variant == uuid.RFC_4122


NOW = 1_717_200_000_000_000
DAY = 86_400_000_000


@pytest.mark.parametrize(
    ("count", "last", "score"),
    [
        (5, None, -1),
        (0, NOW, -1),
        (3, NOW, 3000),
        (1, NOW - DAY, 500),
        (3, NOW - DAY * 3 // 2, 1200),
        (7, NOW - 2 * DAY, 2333),
        (2, NOW + DAY // 2, 4000),
        (2, NOW + 2 * DAY, -2000),
        (2, NOW + DAY, None),
    ],
)
def test_score(spark, count, last, score):
    df = spark.createDataFrame([(count, last)], "visit_count bigint, last_visit_date bigint")
    assert df.select(decayed_score(NOW)).first()[0] == score


def test_age_is_measured_from_whole_seconds(spark):
    df = spark.createDataFrame([(NOW - DAY,)], "last_visit_date bigint")
    assert df.select(age_days(NOW + 999_999)).first()[0] == 1.0


def test_later_of_lets_a_missing_date_give_way(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4), (None, None)], "a bigint, b bigint")
    assert [r[0] for r in df.select(later_of("a", "b")).collect()] == [1, 2, 4, None]
