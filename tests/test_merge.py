import pytest

from histmerge.functions.keys import url_hash
from histmerge.operators import lookup as lookup_module
from histmerge.operators.dimension import MergeRules, merge_dimension
from histmerge.operators.facts import merge_facts
from histmerge.plans.history import merge_origins, merge_places, merge_visits
from tests.conftest import place, rows

PINNED = "https://example.com/"


def test_origins_are_inserted_once_and_mapped(history, work):
    src = history([(50, "https://", "a", 1), (99, "https://", "a", 2), (100, "http://", "a", 3)])
    got = merge_origins(src.origins, history().origins, work)
    assert rows(got.table, "id", "prefix", "host", "frecency") == [
        (1, "https://", "a", 1),
        (2, "http://", "a", 3),
    ]
    assert rows(got.id_map) == [(100, 2), (50, 1), (99, 1)]
    assert tuple(got.stats.first()) == (3, 2, 1)


def test_origin_pairs_that_join_to_one_text_stay_apart(history, work):
    src = history([(1, "a b", "c", 1), (2, "a", "b c", 2)])
    assert merge_origins(src.origins, history().origins, work).table.count() == 2


def test_existing_origin_is_kept_as_it_is(history, work):
    got = merge_origins(
        history([(8, "https://", "a", 100)]).origins, history([(3, "https://", "a", 50)]).origins, work
    )
    assert rows(got.table, "id", "frecency") == [(3, 50)]
    assert rows(got.id_map) == [(8, 3)]


@pytest.fixture(params=["whole", "batch"])
def way(request, monkeypatch):
    """Keys compared by shuffling both sides, and by broadcasting a batch's keys."""
    monkeypatch.setattr(lookup_module, "BATCH_RATIO", 0 if request.param == "batch" else 10**9)


@pytest.fixture
def merged_places(spark, history, work):
    def merge(src, dst=(), ids=()):
        id_map = spark.createDataFrame(list(ids), "old_id bigint, new_id bigint")
        return merge_places(history(places=src).places, history(places=dst).places, id_map, work)

    return merge


def test_new_place_gets_translated_origin_new_guid_and_hash(merged_places):
    got = merged_places([place(7, PINNED, 111, 5, origin=50, title="T", guid="old")], ids=[(50, 1)])
    row = got.table.first()
    assert (row["id"], row["origin_id"], row["title"], row["url_hash"]) == (1, 1, "T", 2127969085)
    assert row["guid"] != "old" and len(row["guid"]) == 36
    assert row["recalc_frecency"] == 0
    assert rows(got.id_map) == [(7, 1)]


def test_matched_place_combines_counters_flags_dates_and_origin_only(merged_places):
    src = place(9, "u", 1, 5, True, 3, 2, 40, origin=50, score=900, title="new", guid="s")
    dst = place(4, "u", 1, 10, False, 1, 1, 70, origin=3, score=100, title="old", guid="d")
    got = merged_places([src], [dst, place(6, "v", 2, 1)], [(50, 8)])
    columns = [
        "id", "visit_count", "hidden", "typed", "foreign_count", "last_visit_date", "origin_id",
        "recalc_frecency", "frecency", "title", "guid", "url_hash",
    ]
    assert rows(got.table.where("id = 4"), *columns) == [
        (4, 15, True, 3, 3, 70, 8, 1, 100, "old", "d", 1)
    ]
    assert rows(got.table.where("id = 6"), "visit_count", "recalc_frecency") == [(1, 0)]
    assert tuple(got.stats.first()) == (1, 0, 1)


def test_the_later_date_wins_and_a_missing_one_gives_way(merged_places):
    dates = [(None, 5, 5), (5, None, 5), (None, None, None), (9, 5, 9), (5, 9, 9)]
    src = [place(n + 1, "u", n, last=there) for n, (there, _, _) in enumerate(dates)]
    dst = [place(n + 1, "u", n, last=here) for n, (_, here, _) in enumerate(dates)]
    got = merged_places(src, dst)
    assert rows(got.table, "url_hash", "last_visit_date") == [
        (n, want) for n, (_, _, want) in enumerate(dates)
    ]


def test_repeated_new_key_takes_the_first_row_and_merges_the_others(merged_places, way):
    src = [
        place(30, "u", 1, 1, False, 0, 1, None, origin=60, score=3, title="third"),
        place(10, "u", 1, 2, False, 4, 1, 50, origin=50, flag=0, score=1, title="first"),
        place(20, "u", 1, 4, True, 2, 1, 20, origin=None, score=2, title="second"),
        place(15, "v", 1, 1, flag=1),
    ]
    got = merged_places(src, [place(100, "w", 9)], [(50, 5), (60, 6)])
    columns = ["id", "title", "visit_count", "hidden", "typed", "foreign_count", "last_visit_date",
               "origin_id", "recalc_frecency", "frecency"]
    assert rows(got.inserted, *columns) == [
        (101, "first", 7, True, 4, 3, 50, 6, 1, 1),
        (102, None, 1, False, 0, 0, None, None, 1, -1),
    ]
    assert rows(got.id_map) == [(10, 101), (15, 102), (20, 101), (30, 101)]
    assert tuple(got.stats.first()) == (4, 2, 2)


def test_origins_of_merged_and_inserted_places(merged_places):
    """The last known origin wins; an unknown one keeps the old value, or its raw id."""
    src = [
        place(1, "u", 1, origin=50), place(2, "u", 1, origin=None), place(3, "u", 1, origin=99),
        place(4, "new", 1, origin=77),
        place(5, "old", 2, origin=77),
    ]
    got = merged_places(src, [place(5, "u", 1, origin=7), place(6, "old", 2, origin=3)], [(50, 8)])
    assert rows(got.table, "url", "origin_id") == [("new", 77), ("old", 3), ("u", 8)]


def test_missing_url_counts_as_the_empty_one(merged_places):
    got = merged_places([place(1, None, 5, 1), place(2, "", 5, 1)], [place(9, None, 5, 1)])
    assert rows(got.table, "id", "url", "visit_count") == [(9, "", 3)]


def test_repeated_destination_key_merges_into_the_largest_id(merged_places, way):
    got = merged_places([place(1, "u", 1, 5)], [place(2, "u", 1, 10), place(9, "u", 1, 20)])
    assert rows(got.table, "id", "visit_count") == [(2, 10), (9, 25)]
    assert rows(got.id_map) == [(1, 9)]


def test_unfit_rules_are_refused(history, work, table):
    with pytest.raises(ValueError, match="median"):
        MergeRules({"a": "median"})
    places, ids = history().places, {"origin_id": table("old_id new_id")}
    with pytest.raises(ValueError, match="origin_id is translated"):
        merge_dimension(places, places, ["url"], work, MergeRules({"origin_id": "max"}), id_maps=ids)


def test_missing_values_give_way_in_every_rule(spark, work):
    columns = "id bigint, k string, n bigint, f boolean, m bigint, l bigint"
    src = spark.createDataFrame(
        [(1, "a", None, None, None, None), (2, "b", 5, True, 5, 5), (3, "c", 2, False, 2, 2),
         (4, "c", None, None, None, None)], columns)
    dst = spark.createDataFrame(
        [(10, "a", 1, False, 1, 1), (11, "b", None, None, None, None)], columns
    )
    rules = MergeRules({"n": "sum", "f": "or", "m": "max", "l": "last"})
    got = merge_dimension(src, dst, ["k"], work, rules)
    assert rows(got.table) == [
        (10, "a", 1, False, 1, 1),
        (11, "b", 5, True, 5, 5),
        (12, "c", 2, False, 2, 2),
    ]


def test_generic_dimension_with_fresh_columns_on_insert(spark, work):
    src = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "key bigint, url string, n bigint")
    dst = spark.createDataFrame([(10, "b", 1)], "key bigint, url string, n bigint")
    rules = MergeRules({"n": "max"}, on_insert={"n": url_hash("url")})
    got = merge_dimension(src, dst, ["url"], work, rules, id_col="key")
    assert rows(got.table, "key", "url") == [(10, "b"), (11, "a")]
    assert rows(got.table.where("key = 10"), "n") == [(3,)]
    assert rows(got.keys, "url", "key", "is_new") == [("a", 11, True), ("b", 10, False)]


def test_visits_are_moved_and_inserted_once(spark, history, work, way):
    ids = spark.createDataFrame([(7, 1), (8, 1)], "old_id bigint, new_id bigint")
    src = history(visits=[
        (1, 7, 10, 1, 0),
        (2, 7, 10, 1, 5),  # the same again
        (3, 8, 10, 1, 0),  # another place that became the same one
        (4, 7, 11, 1, 0),  # already there
        (5, 50, 11, 1, 0),  # no place: keeps its id
        (6, 7, 10, 2, 9),
    ])
    dst = history(visits=[(40, 1, 11, 1, 0), (41, 1, 11, 1, 0)])
    got = merge_visits(src.visits, dst.visits, ids, work)
    assert rows(got.inserted, "id", "place_id", "visit_date", "visit_type", "session") == [
        (42, 1, 10, 1, 0),
        (43, 50, 11, 1, 0),
        (44, 1, 10, 2, 9),
    ]
    assert tuple(got.stats.first()) == (6, 3, 3)
    assert got.table.count() == 5


def test_facts_from_and_into_nothing(history, work, way):
    some, none = history(visits=[(3, 1, 10, 1, 0)]).visits, history().visits
    keys = ["place_id", "visit_date", "visit_type"]
    into_nothing = merge_facts(some, none, keys, work, between="visit_date")
    assert rows(into_nothing.table, "id", "place_id") == [(1, 1)]
    nothing = merge_facts(none, some, keys, work, between="visit_date")
    assert rows(nothing.table, "id") == [(3,)]
    assert tuple(nothing.stats.first()) == (0, 0, 0)
