import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmerge.plans.history import run_merge
from histmerge.sources import publish
from histmerge.sources.publish import DAY_US, BusyError, Cut, Publication, TableState
from histmerge.streaming.incremental import merge_arriving_visits
from histmerge.workspace import Workspace, shared_folder
from tests.conftest import place, rows
from tests.model import NOW

IDS = T.StructType([T.StructField("id", T.LongType())])
DATED = T.StructType([*IDS.fields, T.StructField("visit_date", T.LongType())])


@pytest.fixture
def plain(spark, tmp_path):
    """A publication of two narrow tables, in parts of ten."""
    cuts = {"places": Cut("id", 10), "visits": Cut("visit_date", 10, grows=True)}
    schemas = {"places": IDS, "visits": DATED}
    return Publication(spark, str(tmp_path / "p"), schemas, cuts)


def dated(spark, *dates):
    return spark.createDataFrame([(n + 1, d) for n, d in enumerate(dates)], DATED)


def files(df):
    """Files a scan of ``df`` opens, once partitions are pruned."""
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.selectedPartitions().totalNumberOfFiles()


def test_an_empty_publication(plain):
    assert (plain.current(), plain.state(), plain.claims()) == (0, {}, [])
    assert plain.read("places").count() == 0 and not plain.has("places")


def test_facts_grow_and_touched_parts_are_replaced(spark, plain):
    plain.publish({"places": spark.range(25), "visits": dated(spark, 1, 5, 25)})
    assert plain.state() == {"places": TableState(25, 24), "visits": TableState(3, 3)}
    # A run that changes one range of ids: the other two stay as they are.
    plain.publish(
        {"places": spark.range(10, 15), "visits": dated(spark, 7)},
        {"places": TableState(20, 24), "visits": TableState(4, 4)},
    )
    assert rows(plain.read("places")) == sorted([(n,) for n in [*range(15), *range(20, 25)]], key=repr)
    assert rows(plain.read("visits"), "visit_date") == sorted([(1,), (5,), (7,), (25,)], key=repr)
    assert plain.state() == {"places": TableState(20, 24), "visits": TableState(4, 4)}
    assert plain.current() == 2 and plain.has("visits")


def test_only_parts_that_are_asked_for_are_opened(spark, plain):
    plain.publish({"places": spark.range(95), "visits": dated(spark, *range(-15, 60))})
    assert rows(plain.read_parts("places", [3])) == [(n,) for n in range(30, 40)]
    assert rows(plain.read_between("visits", -12, 3), "visit_date") == sorted([(n,) for n in range(-12, 4)], key=repr)
    assert files(plain.read_parts("places", [3])) == 1
    assert files(plain.read_between("visits", 21, 29)) == 1
    assert files(plain.read("visits")) == 8
    assert plain.read_between("visits", None, None).count() == 0


def test_a_failing_write_leaves_what_is_published(spark, plain):
    plain.publish({"places": spark.range(25)})
    bad = spark.range(30).select(F.when(F.col("id") == 29, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        plain.publish({"places": bad}, {})
    assert plain.read("places").count() == 25
    assert (plain.current(), plain.claims()) == (1, [])


def test_partitions_of_a_number_never_reached_are_cleared(spark, plain):
    plain.publish({"visits": dated(spark, 1)})
    left = f"{plain.root}/published_table=visits/published_part=7/published_run=2"
    dated(spark, 75).write.parquet(left)  # a driver was lost between two renames
    plain.publish({"visits": dated(spark, 2)})
    assert rows(plain.read("visits"), "visit_date") == [(1,), (2,)]


def test_a_write_that_fails_after_counting_leaves_what_is_published(spark, plain):
    plain.publish({"visits": dated(spark, 1)})
    lost = F.when(F.col("id") == 29, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id"))
    bad = spark.range(30).select(lost.alias("id"), F.lit(5).cast("long").alias("visit_date"))
    with pytest.raises(Exception, match="lost"):
        plain.publish({"visits": bad}, {})
    assert rows(plain.read("visits")) == [(1, 1)]
    assert (plain.current(), plain.claims()) == (1, [])


def test_a_task_writes_a_bounded_number_of_rows(spark, plain, monkeypatch):
    """A large part is cut into several files, however its rows were staged."""
    monkeypatch.setattr(publish, "TASK_ROWS", 1000)
    one = spark.range(9500).select("id", F.lit(5).cast("long").alias("visit_date")).coalesce(1)
    few = spark.range(3).select("id", (F.col("id") * 10 + 20).alias("visit_date"))
    empty = spark.range(1).select("id", F.lit(None).cast("long").alias("visit_date"))
    rows_in = one.unionAll(few).unionAll(empty)
    plain.publish({"visits": rows_in, "places": spark.range(15)})
    assert rows(plain.read("visits")) == rows(rows_in)
    assert rows(plain.read("places")) == rows(spark.range(15))
    sizes = plain.read("visits").where("visit_date = 5").groupBy(F.input_file_name()).count()
    assert max(r["count"] for r in sizes.collect()) <= 1200 and sizes.count() == 10
    assert files(plain.read_between("visits", 20, 29)) == 1
    assert plain.state() == {"visits": TableState(9504, 9499), "places": TableState(15, 14)}


def test_one_writer_at_a_time(spark, plain):
    with plain.claimed("first"):
        with pytest.raises(BusyError, match="claimed by first"):
            plain.publish({"places": spark.range(5)})
        with pytest.raises(BusyError), plain.claimed("second"):
            pass
        with pytest.raises(Exception, match="(?i)exist"), plain.claimed("first"):
            pass
        assert plain.claims() == ["first"]
        plain.publish({"places": spark.range(3)}, writer="first")
    assert (plain.claims(), plain.read("places").count()) == ([], 3)
    with pytest.raises(RuntimeError), plain.claimed("third"):
        raise RuntimeError("the merge failed")
    assert plain.claims() == []
    path, store = plain._files("_claims", "gone")
    store.create(path, False).close()  # a driver that was lost
    with pytest.raises(BusyError, match="gone"):
        plain.publish({"places": spark.range(5)})
    plain.release("gone")
    plain.publish({"places": spark.range(5)})
    assert plain.read("places").count() == 5


def side(history, n):
    return history(
        origins=[(1, "https://", f"h{n}", 0)],
        places=[place(1, f"https://h{n}/", n, 1, origin=1)],
        visits=[(1, 1, n, 1, 0)],
    )


def test_the_loser_of_two_interleaved_writers_changes_nothing(spark, history, tmp_path):
    """B reads the state that A read, and comes to publish after A has."""
    target = Publication(spark, str(tmp_path / "out"))
    run_merge(side(history, 1), None, target, NOW, Workspace(spark))
    with target.claimed("writer A"):
        before = {t: rows(target.read(t)) for t in ("origins", "places", "visits", "meta")}
        with pytest.raises(BusyError):
            run_merge(side(history, 2), None, target, NOW, Workspace(spark))
        assert {t: rows(target.read(t)) for t in before} == before
        a = spark.createDataFrame([("by", "A")], "key string, value string")
        target.publish({"meta": a}, {}, "writer A")
        late = spark.createDataFrame([("by", "B")], "key string, value string")
        for writer in ("writer B", None):
            with pytest.raises(BusyError):
                target.publish({"meta": late}, {}, writer)
        assert rows(target.read("meta")) == [("by", "A")]
    run_merge(side(history, 2), None, target, NOW, Workspace(spark))
    assert target.read("visits").count() == 2


def stored(target, table):
    """Names of a table's files with the parts they are in."""
    path, store = target._files(f"published_table={table}", "published_part=*", "published_run=*", "part-*")
    return {str(s.getPath()) for s in store.globStatus(path) or []}


def test_a_small_run_into_a_large_target_writes_one_part(spark, history, tmp_path):
    cuts = {"places": Cut("id", 10), "origins": Cut("id", 10)}
    target = Publication(spark, str(tmp_path / "out"), cuts=cuts)
    many = history(
        origins=[(n, "https://", f"h{n}", 0) for n in range(1, 31)],
        places=[place(n, f"https://h{n}/", n, 1, origin=n) for n in range(1, 60)],
        visits=[(n, n, n * 40 * DAY_US, 1, 0) for n in range(1, 60)],
    ).mapped(lambda name, df: df.withColumn("origin_id", F.col("origin_id") % 30 + 1) if name == "places" else df)
    target.publish(many.tables())
    before = {t: stored(target, t) for t in ("origins", "places", "visits")}
    assert len({f.split("published_part=")[1].split("/")[0] for f in before["places"]}) == 6
    one = history(
        origins=[(7, "https://", "h5", 0)],
        places=[place(3, "https://h25/", 25, 4, origin=7)],
        visits=[(1, 3, 25 * 40 * DAY_US + 5, 1, 0)],
    )
    run_merge(one, None, target, NOW, Workspace(spark))
    after = {t: stored(target, t) for t in before}
    assert after["origins"] == before["origins"]
    changed = after["places"] ^ before["places"]
    assert changed and all("published_part=2/" in f for f in changed)
    assert before["visits"] < after["visits"] and len(after["visits"] - before["visits"]) == 1
    found = target.read("places").where("id = 25").first()
    assert (found["visit_count"], found["origin_id"]) == (5, 5)
    assert target.read("places").count() == 59
    assert target.state()["visits"] == TableState(60, 60)


@pytest.fixture
def stream(spark, history, tmp_path):
    """A published destination, a folder that visits arrive in, and a way to run the stream."""
    target = Publication(spark, str(tmp_path / "out"))
    dst = history(visits=[(40, 1, 10, 1, 0)])
    target.publish({"visits": dst.visits})
    ids = spark.createDataFrame([(7, 1), (8, 2)], "old_id bigint, new_id bigint")
    folder = str(tmp_path / "arriving")

    def arrive(*visits):
        history(visits=list(visits)).visits.coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint="state"):
        arriving = (
            spark.readStream.schema(dst.visits.schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(folder)
        )
        query = merge_arriving_visits(
            arriving, target, ids, str(tmp_path / checkpoint), "arriving"
        )
        query.awaitTermination()

    return target, arrive, run


KEY = ["place_id", "visit_date", "visit_type"]


def test_arriving_visits_are_merged_batch_by_batch(stream):
    target, arrive, run = stream
    arrive((1, 7, 10, 1, 0), (2, 7, 11, 1, 0))
    arrive((3, 7, 11, 1, 0), (4, 8, 11, 1, 0))
    run()
    want = [(1, 10, 1), (1, 11, 1), (2, 11, 1)]
    assert rows(target.read("visits"), *KEY) == want
    assert sorted(r[0] for r in rows(target.read("visits"), "id")) == [40, 41, 42]
    assert target.current() == 3
    arrive((5, 9, 12, 2, 0))
    run()
    assert rows(target.read("visits"), *KEY) == sorted([*want, (9, 12, 2)])


def test_a_replayed_batch_adds_nothing(stream):
    target, arrive, run = stream
    arrive((1, 7, 10, 2, 0))
    run()
    before = rows(target.read("visits"))
    run(checkpoint="lost")  # the stream's own state is gone: batch 0 comes again
    assert rows(target.read("visits")) == before
    assert target.current() == 2


def test_new_visits_after_a_lost_checkpoint_are_kept(stream):
    target, arrive, run = stream
    arrive((1, 7, 10, 2, 0))
    run()
    arrive((2, 8, 12, 1, 0))
    run(checkpoint="lost")  # numbers start again, with other content
    want = [(1, 10, 1), (1, 10, 2), (2, 12, 1)]
    assert rows(target.read("visits"), *KEY) == want


def test_a_visit_without_a_place_stops_the_stream(stream):
    target, arrive, run = stream
    arrive((1, None, 10, 1, 0))
    with pytest.raises(Exception, match="NULL in required columns"):
        run()
    assert target.current() == 1


def test_the_fiftieth_batch_reads_no_more_than_the_fifth(spark, history, tmp_path, monkeypatch):
    """A batch opens published files of its own dates only, however long the history is."""
    target = Publication(spark, str(tmp_path / "out"))
    days = 30 * DAY_US
    history_visits = lambda n: history(visits=[(k + 1, 1, (n * 10 + k) * days, 1, 0) for k in range(10)]).visits
    opened = []
    between = target.read_between

    def counted(*args):
        found = between(*args)
        opened.append((files(found), found.count()))
        return found

    monkeypatch.setattr(target, "read_between", counted)
    ids = spark.createDataFrame([(1, 1)], "old_id bigint, new_id bigint")
    folder = tmp_path / "arriving"
    for n in (0, 4, 49):  # the visits of the batches between are there already
        target.publish({"visits": history_visits(n)})
        late = history(visits=[(1, 1, (n * 10 + 3) * days + 5, 1, 0), (2, 1, (n * 10 + 3) * days, 1, 0)]).visits
        late.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(late.schema).parquet(str(folder))
        merge_arriving_visits(stream, target, ids, str(tmp_path / "state"), "s").awaitTermination()
    assert opened == [(1, 1)] * 3
    assert target.state()["visits"].rows == target.read("visits").count() == 33


def test_work_goes_to_the_folder_the_session_names(spark):
    work = Workspace(spark)
    kept = work.keep(spark.range(3), "step")
    assert kept.inputFiles()[0].replace("file://", "").startswith(
        shared_folder(spark).replace("file://", "").replace("file:", "")
    )
    again = work.keep(spark.range(4), "step")
    assert (kept.count(), again.count()) == (3, 4)
