"""Spelling variants, whitening and sharding against plain versions of themselves."""

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from histmerge.llm import oracles, shards, spelling, whiten
from histmerge.llm import queries as registered

DATA = Path("/root/testdata/sf0.001")
random = np.random.Generator(np.random.PCG64(11))


def vocabulary_by_hand(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, c in enumerate(a) if c != b[k]), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def variants_by_hand(rows):
    vocab = vocabulary_by_hand(rows)
    form, out = {}, []
    for w, n in vocab.items():
        close = [v for v in vocab if near(w, v)]
        best = min(close, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best and vocab[best] >= 10 * n else None
        out.append([w, form[w], None, n, len(close), vocab[form[w]] if form[w] else None])
    for line in out:
        line[2] = line[0]
        while form[line[2]]:
            line[2] = form[line[2]]
    return sorted(map(tuple, out))


def edited(word):
    at, letter = int(random.integers(len(word))), "abéÿ÷"[int(random.integers(5))]
    return [word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]][
        int(random.integers(3))
    ]


def test_spelling_variants_equal_brute_force(spark, work):
    base = ["spelling", "variants", "grouping", "ÉLANvital", "aaaaaaaa", "b" * 3000]
    chain = ["rootword"] * 420 + ["rootwort"] * 41 + ["rootwert"] * 3 + ["rootxert"] * 2
    rows = [(0, " ".join(chain)), (0, " ".join(chain)), (None, "Spelling,spelling"), (None, None), (1, ""),
            (1, "shorter words only no"), (2, "b" * 2999 + " " + "b" * 2999)]
    for k in range(400):
        word = base[int(random.integers(len(base)))]
        for _ in range(int(random.integers(3))):
            word = edited(word)
        rows.append((k % 50, f"{word} {word.upper()}-{word}1"))
    df = spark.createDataFrame(
        [(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n long, word string"
    )
    found = spelling.spelling_variants(df, work)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_by_hand(rows)
    assert sorted(map(tuple, found.collect())) == want
    roots = {w: root for w, _, root, *_ in want}
    assert roots["rootwert"] == "rootword"  # by way of another form
    assert sum(line[4] for line in want) > 100
    assert spelling.spelling_variants(df.limit(0), work).collect() == []


def test_neighbourhoods_hold_every_reduced_word_in_reach():
    for word in [b"abcdefg", b"aaaaaaaaa", bytes([0xE9, 0xFF, 0xF7]) * 4]:
        hashes = {int(h) for part in spelling.Reduced([word]).near() for h in part[0]}
        for at in range(len(word) + 1):
            for letter in (0x61, 0x7A, 0xE0, 0xFF):
                other = word[:at] + bytes([letter]) + word[at:]
                assert int(spelling.Reduced([other]).hashes()[0]) in hashes
                if at < len(word):
                    other = word[:at] + bytes([letter]) + word[at + 1 :]
                    assert int(spelling.Reduced([other]).hashes()[0]) in hashes
            if at < len(word):
                assert int(spelling.Reduced([word[:at] + word[at + 1 :]]).hashes()[0]) in hashes


def whitened_by_hand(vectors, components=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    shown = min(components, len(e))
    with np.errstate(all="ignore"):
        y = (x - sums / n) @ v[:, :shown] / np.sqrt(e[:shown])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return n, deviation, y, e[:shown] / e.sum()


@pytest.mark.parametrize(("rows", "width"), [(2500, 6), (40, 3), (7, 5)])
def test_whitening_equals_plain_numpy(spark, work, rows, width):
    mixing = random.normal(size=(width, width))
    vectors = [[float(c) for c in random.normal(size=width) @ mixing] for _ in range(rows)]
    vectors += vectors[:5] * 3 + [[-0.0] * width]
    odd = [(1, None), (2, [None] * width), (3, [float("nan")] * width), (None, [float("inf")] * width), (4, [])]
    data = [(k + 10, v, 1.0, 0) for k, v in enumerate(vectors)] + [(i, v, 1.0, 0) for i, v in odd]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, component double, x int")
    found = whiten.whiten(df.repartition(3), work).toPandas()
    n, deviation, y, explained = whitened_by_hand(vectors)
    assert set(found["n"]) == {n}
    assert len(found) == len(vectors) * min(4, width)
    assert set(found["identity_error"]) == {found["identity_error"][0]}
    assert found["identity_error"][0] < 1e-9
    for k in range(min(4, width)):
        part = found[found.component == k + 1].set_index("vec_id").loc[[i + 10 for i in range(len(vectors))]]
        assert list(part.deviation) == deviation
        sign = np.sign((part.whitened.values * y[:, k]).sum())
        assert np.abs(part.whitened.values * sign - y[:, k]).max() < 1e-8
        assert part.explained.iloc[0] == pytest.approx(explained[k], rel=1e-9)


def test_whitening_of_vectors_without_spread(spark, work):
    make = lambda vectors: spark.createDataFrame(
        [(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>"
    )
    alike = whiten.whiten(make([[1.0, 2.0]] * 3), work).collect()
    assert len(alike) == 6
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alike)
    line = whiten.whiten(make([[float(k), 0.0, float(-k)] for k in range(4)]), work).collect()
    assert [r["component"] for r in line if r["whitened"] is not None] == [1] * 4
    assert {r["explained"] for r in line if r["component"] == 2} == {0.0}
    huge = whiten.whiten(make([[1e30, 1.0], [-1e30, 0.0], [0.5, 3.0]]), work).collect()
    assert {r["n"] for r in huge} == {3}
    assert all(r["deviation"] is None for r in huge if r["vec_id"] < 2)
    assert whiten.whiten(make([None, []]), work).collect() == []
    with pytest.raises(ValueError, match="vectors of 1 and of 2 entries"):
        whiten.whiten(make([[1.0], [1.0, 2.0]]), work)


def test_a_matrix_of_several_blocks(spark, work, monkeypatch):
    monkeypatch.setattr(whiten, "LEAST_ROWS", 16)
    monkeypatch.setattr(whiten, "MOST_COLUMNS", 2)
    monkeypatch.setattr(whiten, "MOST_SPLITS", 3)
    vectors = [[float(c) for c in random.normal(size=5)] for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    found = whiten.whiten(df, work).toPandas()
    _, _, y, _ = whitened_by_hand(vectors)
    part = found[found.component == 1].sort_values("vec_id").whitened.values
    assert np.abs(np.abs(part) - np.abs(y[:, 0])).max() < 1e-9


def test_shards_hold_every_row_in_gapless_slots(spark, work):
    texts = [None, "", "é" * 9, "x" * 50_000]
    rows = [(k % 700 if k % 3 else None, texts[k % 4], 1, "clash") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, shard string")
    tree = shards.layout(16)
    found = shards.assign_shards(df.repartition(5), work, tree).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(16))
    by_id = {}
    for r in found:
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    again = shards.assign_shards(df, work, tree).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
    assert shards.assign_shards(df.limit(0), work, tree).collect() == []


def placed(spark, tree, n=20_000):
    leaf = {x.shard: x for x in tree}
    found = spark.range(n).select("id", shards.shard_of(F.col("id"), tree).alias("shard")).collect()
    return {r["id"]: leaf[r["shard"]] for r in found}


def test_changed_weights_move_rows_in_changed_subtrees_only(spark):
    tree = [shards.Leaf(r, k, r * 6 + k * 2 + s, 1.0 + r) for r in range(3) for k in range(3) for s in range(2)]
    before = placed(spark, tree)
    for leaf in tree:
        share = sum(x == leaf for x in before.values()) / len(before)
        assert share == pytest.approx(leaf.weight / 36, abs=0.012)
    heavier = [shards.Leaf(1, 2, x.shard, 5.0) if x.shard == 10 else x for x in tree]
    moved = [(before[k], x) for k, x in placed(spark, heavier).items() if before[k].shard != x.shard]
    assert moved
    for old, new in moved:
        # Into the region, within it into the rack, within that into the shard; other
        # regions exchange nothing, nor do racks of one region that did not change.
        assert new.region == 1
        assert old.region != 1 or new.rack == 2
        assert (old.region, old.rack) != (1, 2) or new.shard == 10
    lighter = [shards.Leaf(x.region, x.rack, x.shard, 0.0) if x.shard == 10 else x for x in tree]
    for k, x in placed(spark, lighter).items():
        assert x.shard != 10
        assert before[k].region == 1 or before[k].shard == x.shard
        assert before[k].region != 1 or x.region != 1 or before[k].rack in (2, x.rack)


def test_each_new_shard_takes_rows_into_itself_alone(spark):
    tree = shards.layout(5)
    held = placed(spark, tree, 5000)
    for _ in range(3):
        tree = shards.with_one_more(tree)
        grown = placed(spark, tree, 5000)
        changed = {grown[k].shard for k in held if held[k].shard != grown[k].shard}
        assert changed == {tree[-1].shard}
        assert sum(x.shard == tree[-1].shard for x in grown.values()) / 5000 == pytest.approx(1 / len(tree), abs=0.03)
        held = grown
    for bad in ([], [shards.Leaf(0, 0, 0, 0.0)], [shards.Leaf(0, 0, 0, -1.0)], [shards.Leaf(0, 0, 0), shards.Leaf(1, 0, 0)]):
        with pytest.raises(ValueError):
            shards.shard_of(F.col("id"), bad)


def test_written_shards_hold_the_whole_rows(spark, work):
    df = spark.createDataFrame([(k, f"text {k}", None) for k in range(300)], "doc_id long, text string, lang string")
    tree = shards.layout(6)
    found = shards.write_shards(df, work.keep_path("shards"), tree)
    assert sorted(map(tuple, found.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    at = {x.shard: (x.region, x.rack) for x in tree}
    where = df.select("doc_id", shards.shard_of(F.col("doc_id"), tree).alias("s"))
    want = {r["doc_id"]: r["s"] for r in where.collect()}
    for r in found.collect():
        assert r["shard"] == want[r["doc_id"]] and (r["region"], r["rack"]) == at[r["shard"]]
    with pytest.raises(ValueError, match="named like a level"):
        shards.write_shards(df.withColumnRenamed("lang", "Rack"), work.keep_path("shards"), tree)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_sharding"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = duck.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registered.queries()[name](spark, str(DATA)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_whitening_query_equals_plain_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, y, explained = whitened_by_hand([r["embedding"] for r in rows])
    found = registered.op12_embedding_whitening(spark, str(DATA)).toPandas().sort_values("vec_id")
    for k in range(4):
        part = found[found.component == k + 1]
        assert list(part.deviation) == deviation and set(part.n) == {n}
        assert np.abs(np.abs(part.whitened.values) - np.abs(y[:, k])).max() < 1e-8
        assert part.explained.iloc[0] == pytest.approx(explained[k], rel=1e-9)
