import random

import pytest
from pyspark.sql import functions as F

from histmerge.operators import lookup as L
from histmerge.operators.ids import assign_ids, first_per_key, rows_and_largest_id
from tests.conftest import rows


def test_ids_follow_source_order_over_many_partitions(spark, work):
    ids = random.Random(1).sample(range(10**12), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "old bigint").repartition(7)
    got = dict(rows(assign_ids(df, 40, work, "old", to="new")))
    assert got == {old: 41 + n for n, old in enumerate(sorted(ids))}


def test_ids_of_an_empty_table(spark, work):
    empty = spark.range(0).withColumnRenamed("id", "old")
    assert assign_ids(empty, 0, work, "old").count() == 0
    assert rows_and_largest_id(empty, "old") == (0, 0)


@pytest.mark.parametrize("text", [True, False])
def test_first_row_per_key(spark, text):
    r = random.Random(2)
    data = [(i, r.randrange(20), r.choice([None, 1, 2]), f"t{i}") for i in range(500)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "id bigint, k bigint, v bigint, t string").repartition(5)
    df = df if text else df.drop("t")
    want = {}
    for row in sorted(data):
        want.setdefault(row[1], row if text else row[:3])
    got = first_per_key(df, ["k"])
    assert got.columns == df.columns
    assert rows(got) == sorted(want.values(), key=repr)


@pytest.mark.parametrize("text", [True, False])
def test_first_row_of_keys_that_are_not_held(spark, text):
    data = [(i, i % 10, None if i < 15 else i, f"t{i}") for i in range(100)]
    df = spark.createDataFrame(data, "id bigint, k bigint, v bigint, t string").repartition(3)
    df = df if text else df.drop("t")
    held = spark.createDataFrame([(3,), (3,), (7,), (99,)], "k bigint")
    got = first_per_key(df, ["k"], unless=held)
    assert rows(got, "id", "v") == [(i, None) for i in range(10) if i not in (3, 7)]


FACTS = [(i, 7 if i % 3 == 0 else i % 50, "k" if i % 10 else None) for i in range(3000)]


@pytest.fixture
def facts(spark):
    return spark.createDataFrame(FACTS, "id bigint, a bigint, b string").withColumn(
        "a", F.when(F.col("id") % 4 != 1, F.col("a"))
    )


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "spread"])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_gives_the_same_rows_in_all_three_ways(spark, facts, work, monkeypatch, way, how):
    mapping = work.keep(
        spark.createDataFrame([(n, "k", n * 100) for n in range(0, 50, 2)] + [(7, "k", 1)],
                              "a bigint, b string, v bigint"), "mapping")
    want = facts.join(mapping, ["a", "b"], how)
    if way != "broadcast":
        monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if way == "spread":
        monkeypatch.setattr(L, "HEAVY_ROWS", 20)
        heavy = L.heavy_keys(facts, ["a", "b"])
        assert max(heavy.splits.values()) > 10 and heavy.unkeyed
    try:
        got = L.lookup(facts, mapping, ["a", "b"], how)
        assert rows(got, "id", "a", "b", "v") == rows(want, "id", "a", "b", "v")
        plan = got._jdf.queryExecution().toString()
        assert ("_salt" in plan) == (way == "spread")
        assert ("Generate explode" in plan) == (way == "spread")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heavy_keys_finds_a_key_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAVY_ROWS", 1000)
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-5)).otherwise(F.col("id")).alias("k")
    )
    heavy = L.heavy_keys(df, ["k"])
    (splits,) = heavy.splits.values()
    assert splits == 101 and not heavy.unkeyed  # 100,000 rows in parts of 1,000
    assert L.heavy_keys(df.where("k >= 0"), ["k"]) == L.Heavy({})


def test_a_thousand_heavy_keys_are_all_spread(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(L, "HEAVY_ROWS", 20)
    df = spark.range(100_000).select("id", (F.col("id") % 1000).alias("k"))
    heavy = L.heavy_keys(df, ["k"])
    assert len(heavy.splits) == 1000 and set(heavy.splits.values()) == {6}
    table = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = L.lookup(df, table, ["k"], spread=["id"])
    want = df.withColumn("v", F.when(F.col("k") % 2 == 0, F.col("k") * 10)).select(got.columns)
    assert got.count() == 100_000 and got.exceptAll(want).isEmpty()


def test_a_match_shuffles_each_side_once(spark, monkeypatch):
    src = spark.range(1000).select("id", (F.col("id") % 50).alias("k"))
    dst = spark.range(2000).select("id", (F.col("id") % 40).alias("k"))
    monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.match(src, dst, ["k"])
        assert got.where("dst_id IS NULL").count() == 200
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_check_counts_real_bytes(spark, work, monkeypatch):
    wide = work.keep(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t")), "wide")
    assert L.fits_broadcast(wide)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 50_000)
    assert not L.fits_broadcast(wide)
    assert L.fits_broadcast(wide.select("id"))
    monkeypatch.setattr(L, "BROADCAST_ROWS", 99)
    assert not L.fits_broadcast(wide.select("id"))
    assert L.fits_broadcast(wide.where("id < 0"))


def test_match_takes_the_largest_id_of_a_repeated_key(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, k string")
    dst = spark.createDataFrame([(5, "a"), (9, "a"), (7, "a")], "id bigint, k string")
    assert rows(L.match(src, dst, ["k"]), "id", "dst_id") == [(1, 9), (2, None)]


def test_remap_keeps_what_the_map_does_not_hold(spark, table):
    ids = table("old_id new_id", (1, 11), (2, 12))
    df = table("id place_id", (1, 2), (2, 5), (3, None), (4, 1))
    got = L.remap(df, ids, "place_id")
    assert got.columns == ["id", "place_id"]
    assert rows(got) == [(1, 12), (2, 5), (3, None), (4, 11)]


def test_seen_and_unseen_split_the_source(spark, table):
    src = table("id place_id visit_date", (1, 1, 10), (2, 1, 11), (3, 2, 10))
    dst = table("place_id visit_date", (1, 10), (1, 10), (2, 11))
    keys = ["place_id", "visit_date"]
    assert rows(L.seen(src, dst, keys), "id") == [(1,)]
    assert rows(L.unseen(src, dst, keys), "id") == [(2,), (3,)]
