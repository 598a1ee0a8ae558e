import pytest

from histmerge.sources.schema import (
    ORIGINS,
    PLACES,
    VISITS,
    ContractError,
    check_contract,
    conform,
    contract_violations,
    empty_table,
)
from histmerge.sources.tables import (
    SameSideError,
    empty_history,
    read_history,
    refuse_same_side,
    seed_keys,
)
from tests.conftest import place, rows


def test_conform_adds_defaults_casts_and_repairs(spark):
    raw = spark.sql(
        "SELECT 1 AS id, X'61ff' AS url, CAST(NULL AS STRING) AS guid, 1 AS hidden, 5 AS frecency,"
        " 'dropped' AS more"
    )
    got = conform(raw, PLACES)
    assert got.columns == [f.name for f in PLACES]
    assert [f.dataType for f in got.schema] == [f.type for f in PLACES]
    row = got.first()
    assert (row["url"], row["guid"], row["rev_host"], row["title"]) == ("a\ufffd", "", "", None)
    assert (row["hidden"], row["visit_count"], row["frecency"]) == (True, 0, 5)
    assert (row["typed"], row["recalc_frecency"], row["last_visit_date"]) == (0, 0, None)


def test_conform_defaults_of_a_bare_place(spark):
    assert conform(spark.range(1), PLACES).first()["frecency"] == -1


def test_conform_refuses_numbers_as_text_and_missing_required_columns(spark):
    with pytest.raises(ContractError, match="url must hold text"):
        conform(spark.sql("SELECT 1L AS id, 5 AS url"), PLACES)
    with pytest.raises(ContractError, match="place_id is missing"):
        conform(spark.range(1), VISITS)


def test_contract_counts_nulls_of_required_columns(spark, table):
    bad = table("id place_id visit_date visit_type session source", (1, None, 5, 1, None, 0),
                (2, None, 6, 1, 0, 0))
    found = dict(rows(contract_violations(bad, VISITS)))
    assert found == {
        "id": 0, "place_id": 2, "visit_date": 0, "visit_type": 0, "session": 1, "source": 0,
    }
    with pytest.raises(ContractError, match="place_id: 2"):
        check_contract(bad, VISITS, "visits")
    check_contract(empty_table(spark, ORIGINS), ORIGINS, "origins")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_read_any_format(spark, history, tmp_path, fmt):
    side = history(
        [(1, "https://", "a", 5)], [place(1, "u", 9, 2, origin=1)], [(1, 1, 10, 1, 0)]
    )
    for name, df in side.tables().items():
        df.write.format(fmt).save(f"{tmp_path}/past-{name}")
    names = {name: f"past-{name}" for name in side.tables()}
    read = read_history(spark, str(tmp_path), fmt, names={**names, "meta": None})
    assert rows(read.places, "id", "url", "url_hash", "visit_count", "origin_id") == [
        (1, "u", 9, 2, 1)
    ]
    assert rows(read.visits, *side.visits.columns) == rows(side.visits)


def test_seeds_hold_keys_only(spark, history):
    side = history(
        [(3, "https://", "a", 5)], [place(4, "u", 12345)], [(6, 4, 10, 1, 0)]
    )
    seeds = seed_keys(side)
    assert rows(seeds["origins"]) == [("https://", "a", 3)]
    assert rows(seeds["places"]) == [(12345, "u", 4)]
    assert rows(seeds["visits"]) == [(4, 10, 1)]
    assert empty_history(spark).places.count() == 0


@pytest.mark.parametrize(
    ("a", "b"), [("/x/y", "/x/y/"), ("file:///x/y", "/x/./y"), ("s3a://b/x", "s3a://b//x")]
)
def test_same_side_is_refused(a, b):
    with pytest.raises(SameSideError):
        refuse_same_side(a, b)
    refuse_same_side(a, b + "/other")
