"""The corpus operators against brute force on small tables with awkward rows."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from histmerge.llm import html, jaccard, langid, mix, oracles, quality, repeats, templates, tokens, toxicity, urls
from histmerge.llm import queries as registered
from histmerge.workspace import Workspace

DATA = Path("/root/testdata/sf0.001")
random = np.random.Generator(np.random.PCG64(3))
LETTERS = ["the", "cat", "sat", "on", "mat", "a", "dog", "ran", "far", "away", "é", "日本"]


def words(n):
    return " ".join(random.choice(LETTERS, n))


LONG = words(4000)
BASE = words(120)
DOCS = [
    (1, BASE), (2, BASE), (3, BASE + " end"), (4, "x " + BASE), (5, None), (6, ""), (7, " \n\t"),
    (8, "one"), (9, "ONE"), (10, LONG), (11, LONG[:9000] + " changed " + LONG[9000:]), (12, "a" * 900),
    (13, words(60)), (14, LONG[3000:5000]), (None, "one two"), (13, words(20)),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", 1, "clash") for i, t in DOCS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size string"
    )


def removed_by_hand(texts, length):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in blobs for p in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("most", [100_000, 1])
def test_repeats_equal_brute_force(spark, docs, work, most):
    found = repeats.remove_repeats(docs, work, length=40, most=most).collect()
    want = removed_by_hand([t for _, t in DOCS], 40)
    assert sorted(bytes(r["kept"]) for r in found) == sorted(want)
    assert sum(r["n_removed"] for r in found) == sum(len((t or "").encode()) for _, t in DOCS) - sum(map(len, want))


def test_rows_of_one_window_are_dealt_to_many_tasks(spark):
    windows = [(7, 7, bytes([d, s]), s) for d in range(40) for s in range(50)]  # one window, 2,000 places
    windows += [(8, 8, b"a", 1), (8, 8, b"b", 1), (8, 9, b"a", 2), (9, 8, b"a", 3), (9, 8, b"a", 3)]
    rows = spark.createDataFrame(windows, "one long, two long, key binary, start long")
    known = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(known, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        found = repeats.among_repeated(rows, 64).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    want = [w for w in windows if w[:2] in ((7, 7), (8, 8))]
    assert sorted((r["one"], r["two"], bytes(r["key"]), r["start"]) for r in found) == sorted(want)
    assert max(Counter(r["task"] for r in found if r["one"] == 7).values()) < 1000


def test_loser_tree_merges_and_tells_common_prefixes():
    keys = sorted({random.bytes(int(n)) for n in random.integers(1, 6, 300)})
    runs = [[k for k in keys if random.random() < 0.5] for _ in range(5)]
    tree = repeats.LoserTree([repeats.Run(repeats.Run.pack(r, [[b"x" * 24]] * len(r))) for r in runs if r])
    last = b""
    found = []
    for key, shared, _ in tree:
        assert shared == repeats.common_prefix(last, key, 0)
        found.append(key)
        last = key
    assert found == sorted(k for r in runs for k in r)


def components_by_hand(texts, size, percent):
    def shingles(text):
        w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("size", "percent", "most"), [(3, 90, 20_000), (2, 60, 4), (5, 80, 20_000)])
def test_jaccard_components_equal_brute_force(spark, work, size, percent, most):
    base = [words(40) for _ in range(4)]
    texts = [t for _, t in DOCS]
    for k in range(60):
        w = base[k % 4].split(" ")
        for p in random.integers(0, len(w), k % 5):
            w[p] = f"w{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.jaccard_components(df, work, words=size, percent=percent, most=most).orderBy("doc_id").collect()
    sizes, root = components_by_hand(texts, size, percent)
    assert [r["n_shingles"] for r in found] == sizes
    assert [r["component_id"] for r in found] == root
    kept = jaccard.keep_one(df, work, words=size, percent=percent, most=most)
    alone = [k for k in range(len(texts)) if root[k] == k]
    assert sorted(r["doc_id"] for r in kept.collect()) == alone


def test_one_document_stays_but_every_wordless_row(spark, work):
    texts = [(1, BASE), (1, BASE), (2, BASE), (5, ""), (5, ""), (None, ""), (None, ""), (6, None), (6, None), (7, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = jaccard.keep_one(df, work, words=3, percent=90).collect()
    assert Counter(map(tuple, found)) == Counter([texts[0], *texts[3:]])


def test_stages_of_rows_with_clashing_names(spark, work):
    """Names that the operators use within, and rows of one document that differ."""
    names = ["__doc", "__text", "__key", "__s", "__h", "doc", "key", "row", "s", "h", "limits", "best_doc", "filled", "a.b"]
    texts = [(1, BASE), (1, BASE), (2, BASE), (3, ""), (3, None), (None, "two words"), (None, "two words")]
    rows = [(i, t, "web", *[f"{n} {k % 2}" for n in names]) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    kept = jaccard.keep_one(df, work, words=3, percent=90)
    assert kept.columns == df.columns
    found = list(map(tuple, kept.collect()))
    assert set(found) <= set(rows) and Counter(r[:2] for r in found) == Counter(
        [(1, BASE), (3, ""), (3, None), (None, "two words")]
    )
    # Which of the rows stays does not depend on their order.
    again = jaccard.keep_one(df.orderBy(F.col("row").desc()), work, words=3, percent=90)
    assert set(map(tuple, again.collect())) == set(found)
    mixed = mix.apply_mix(df, work)
    assert mixed.columns == df.columns
    times = {r["doc_id"]: r["takings"] for r in mix.mix_sources(df, work).collect()}
    want = Counter({r: n * times[r[0]] for r, n in Counter(rows).items() if times[r[0]]})
    assert Counter(map(tuple, mixed.collect())) == want
    assert not mix.apply_mix(df.limit(0), work).collect()
    assert not jaccard.keep_one(df.limit(0), work, words=3, percent=90).collect()


def test_mix_meets_its_targets(spark, work):
    rows = [(k, words(int(random.integers(1, 30))), f"s{k % 4}" if k % 9 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix.mix_sources(df, work).collect()
    by_target = {}
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        key = (r["source_size"], r["target"])
        by_target[key] = by_target.get(key, 0) + r["taken"]
    assert all(abs(t - target) <= 30 for (_, target), t in by_target.items())
    assert sum(t for _, t in by_target) == pytest.approx(1.5 * sum(s for s, _ in by_target))
    times = mix.apply_mix(df, work)
    assert times.columns == df.columns
    assert times.count() == sum(r["takings"] for r in found)


def test_token_files_round_trip(spark, docs, work):
    from tokenizers import Tokenizer

    path = registered.tokenizer_path()
    library = Tokenizer.from_file(path)
    found = tokens.write_and_read(docs, path, work).orderBy("start").collect()
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter(
        (i, bytes(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))) for i, t in DOCS
    )
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == want
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in found]
    assert ids == sorted(ids)


def test_packing_keeps_every_width():
    values = np.array([0, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    assert (tokens.unpack(tokens.pack(values)) == values).all()
    assert not len(tokens.unpack(tokens.pack(values[:0])))


def test_quality_base_counts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    text = "a b c d e\nx # x\nx # x\na b c d e"
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(99, text)], "doc_id long, text string"))
    found = {r["doc_id"]: r for r in quality.quality_rules(df, labels).collect()}
    r = found[99]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (16, 16, 2, 2, 10)
    assert r["base_failed"] and not r["kept"] and found[5]["n_words"] == 0
    assert found[10]["n_words"] == 4000
    assert not quality.quality_rules(df.limit(0), labels.limit(0)).collect()


@pytest.mark.parametrize("labelled", [0, 5, 50, 5000])
def test_quality_keeps_good_documents_held_out(spark, labelled):
    draw = np.random.Generator(np.random.PCG64(5))
    weights = 1 / np.arange(1, 20_001)
    drawn = draw.choice(20_000, (5600, 40), p=weights / weights.sum())
    texts = [" ".join(f"word{k}" for k in row) for row in drawn]
    junk = [" ".join(f"#{k}x" for k in row) for row in draw.integers(0, 400, (100, 40))]
    df = spark.createDataFrame(list(enumerate(texts + junk)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k in range(labelled)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(df, labels).select("doc_id").collect()}
    assert len(kept & set(range(5000, 5600))) >= 580
    assert len(kept & set(range(5600, 5700))) <= (5 if labelled >= 50 else 100)


def test_quality_rejects_junk_with_few_trusted(spark):
    draw = np.random.Generator(np.random.PCG64(6))
    good = [" ".join(f"word{k}" for k in row) for row in draw.integers(0, 60, (15, 60))]
    junk = [" ".join(f"#{k}x" for k in row) for row in draw.integers(0, 60, (300, 60))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(good + junk)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1) for k in range(15)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(15))
    alone = quality.keep_good(df, labels.where("doc_id = 0"))
    assert alone.count() == 315  # nothing can be held out: the base rules decide


def test_quality_scores_each_trusted_text_without_itself(spark):
    from histmerge.llm.batches import SPACES

    texts = [words(int(n)) for n in random.integers(12, 60, 9)]
    copies = np.array([1, 1, 3, 1, 2, 1])
    trusted = [t for t, c in zip(texts, copies, strict=False) for _ in range(c)]
    drawn = langid.texts_of(texts[:6])

    def buckets(some):
        read = langid.texts_of(some)
        starts, ends, rows = read.spans(~SPACES)
        return np.bincount(quality.ngram_buckets(read.hashes(starts, ends), rows, 10)[1], minlength=1 << 10)

    raw, all_trusted = buckets(texts + trusted), buckets(trusted)
    starts, ends, rows = drawn.spans(~SPACES)
    found = quality.held_out_scores(drawn.hashes(starts, ends), rows, copies, raw, all_trusted, 10)
    for k, text in enumerate(texts[:6]):
        rest = buckets([t for t in trusted if t != text])
        table = quality.log_ratios(raw, rest, quality.PRIOR * rest.sum() / all_trusted.sum())
        own = buckets([text])
        assert found[k] == pytest.approx((own * table).sum() / own.sum())
    alone = quality.held_out_scores(drawn.hashes(starts, ends), rows, copies, raw, buckets(texts[:1]), 10)
    assert np.isnan(alone[0])


def test_quality_counts_every_trusted_text(spark):
    """More good documents than any sample: all are counted, copies and repeated rows too."""
    from histmerge.workspace import Workspace

    rows = [(k, f"good{k % 5990} text") for k in range(6000)] + [(7, "good7 text"), (8, "second of 8"), (9000, "raw")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = [(k, 1) for k in [*range(6000), 5, 70_000]] + [(9000, 0), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    texts = quality.trusted_texts(df, labels, Workspace(spark))
    found = {r["text"]: r["copies"] for r in texts.collect()}
    want = {}
    for k, text in rows:
        if k < 6000:
            want[text] = want.get(text, 0) + 1
    assert texts.count() == len(found) and found == want
    every = spark.createDataFrame([(t,) for t, n in want.items() for _ in range(n)], "text string")
    assert (quality.bucket_counts(texts, 10) == quality.bucket_counts(every, 10)).all()
    scores = spark.createDataFrame([(k * k % 997 / 100,) for k in range(999)], "x double")
    for share in (0.005, 0.3, 1.0):
        plain = scores.agg(F.expr(f"percentile_disc({share}) within group (order by x)")).first()[0]
        assert quality.value_at(scores, "x", share) == plain
    assert quality.value_at(scores.limit(0), "x", 0.5) is None


def test_languages_beside_many_copies_and_in_long_texts(spark):
    rows = [(f"the cat and the dog went to town {k}", "en") for k in range(200)]
    rows += [(f"der hund und die katze gingen fort {k}", "de") for k in range(200)]
    rows += [("le chat et le chien sont partis en ville " * 1500 + str(k), "fr") for k in range(20)]
    train = spark.createDataFrame(rows, "text string, lang string")
    copies = spark.range(300_000).selectExpr("'the same old text of the cat' text", "'en' lang")
    drawn = langid.labelled_sample(train.union(copies), size=50).collect()
    assert Counter(r["lang"] for r in drawn) == {"en": 50, "de": 50, "fr": 20}
    assert max(len(r["text"].encode()) for r in drawn) <= langid.SAMPLE_BYTES
    df = spark.createDataFrame([(1, "the dog", "zz"), (1, "the dog", "zz"), (2, "le chien en ville", "zz")],
                               "doc_id long, text string, lang_pred string")
    found = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, train.union(copies), 50).collect()]
    assert sorted(found) == [(1, "en"), (1, "en"), (2, "fr")]
    assert not langid.identify(df.limit(0), train).collect()


def test_languages_and_letters(spark, docs):
    train = spark.createDataFrame(
        [(f"the cat and the dog {k}", "en") for k in range(30)] + [(f"der hund und die katze {k}", "de") for k in range(30)],
        "text string, lang string",
    )
    asked = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, "12 !"), (5, "日")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, train).collect()}
    assert (found[1], found[2], found[3], found[4]) == ("en", "de", "und", "und") and found[5] in ("en", "de")
    none = langid.identify(docs, train.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_toxicity_learns_and_scores(spark):
    rows = [(k, words(20) + (" scum" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all((found[i]["predicted"] == 1) == (y == 1) for i, _, y in rows)
    assert found[900]["score"] == found[901]["score"] < 0.5
    assert toxicity.fit(df, labels.limit(0)) is None


def test_toxicity_threshold_is_where_labels_part_best(spark):
    def by_hand(values, labels):
        best, where = 0, None
        for a, b in zip(sorted(values)[1:], sorted(values), strict=False):
            said = values >= a
            f1 = 2 * (said & (labels == 1)).sum() / (said.sum() + labels.sum())
            if a > b and f1 >= best:
                best, where = f1, (a + b) / 2
        return where

    draw = np.random.Generator(np.random.PCG64(8))
    for _ in range(50):
        labels = draw.integers(0, 2, 30)
        values = np.round(draw.normal(size=30) + labels, 1)
        assert toxicity.best_cut(values, labels) == by_hand(values, labels)
    assert toxicity.best_cut(values, labels * 0) is None
    assert toxicity.best_cut(values * 0, labels) is None
    # A sign that half of the toxic texts have, a third of them faint.
    rows = []
    for k in range(1800):
        toxic = int(k % 10 == 0)
        faint = " vermin" if toxic and k % 30 == 0 else ""
        rows.append((k, words(30) + (" scum scoundrel" if toxic and not faint else "") + faint, toxic))
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = toxicity.score(df, toxicity.fit(df.union(df), labels.where("doc_id < 900"))).collect()
    said = {r["doc_id"] for r in found if r["predicted"] and r["doc_id"] >= 900}
    want = {i for i, _, y in rows if y and i >= 900}
    assert len(said & want) >= 0.8 * len(want) and len(said - want) <= 0.1 * len(said)
    assert not toxicity.score(df.limit(0), None).collect()
    one = toxicity.fit(df, labels.where("toxic = 0"))
    assert not any(r["predicted"] for r in toxicity.score(df, one).collect())


def test_contamination_catches_other_numbers_only_if_consistent(spark, work):
    item = "a train leaves at 40 km speed and after 3 hours it has passed Berlin again at 40 km"
    texts = [
        (1, "before. " + item + ". after"), (2, item.replace("40", "55").replace("3 h", "7 h")),
        (3, item.replace("40", "55", 1)), (4, words(300)), (5, None), (6, ""),
        (7, item.replace("Berlin", "Paris")), (8, item[:40]),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string")
    found = {r["doc_id"]: r["contaminated"] for r in templates.contamination(df, bench, work).collect()}
    assert {k for k, v in found.items() if v} == {1, 2, 3, 7}  # 3: its second part as it is
    assert sorted(r["doc_id"] for r in templates.decontaminate(df, bench, work).collect())[0] > 2
    assert not any(r["contaminated"] for r in templates.contamination(df, bench.limit(0), work).collect())


def test_contamination_wants_one_value_for_each_value(spark, work):
    item = "a train leaves at 40 km speed and after 3 hours it has passed Berlin again at 40 km"
    twice = "if a shop sells 3 apples and 3 pears to every guest how many does it sell"
    long = " ".join(f"plain{k}" for k in range(59))
    w = long.split()
    altered = " ".join("other" if k in (9, 19, 29, 39, 49) else x for k, x in enumerate(w))
    far = words(200)
    texts = [
        (1, item.replace("40", "55", 1).replace("40", "71")), (2, item.replace("40", "55")),
        (3, twice.replace("3", "5", 1).replace("3", "7")), (4, twice.replace("3", "5")),
        (5, twice.replace("shop sells", "farm grows").replace("guest how", "day so")),
        (6, f"{far} {' '.join(w[:32])} {far}"), (7, f"{far} {altered} {far}"),
        (8, far.join([" ".join(w[k : k + 12]) + " " for k in (44, 30, 16, 2)])),
        (9, " ".join([*w[:30], "and", "more", *w[30:]])), (10, f"{far} {' '.join(w[:25])} {far}"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, twice), (2, long)], "item_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in templates.contamination(df, bench, work).collect()}
    want = {1: [], 2: [0], 3: [], 4: [1], 5: [], 6: [2], 7: [2], 8: [], 9: [2], 10: []}
    assert found == want


def contaminated_by_hand(text, item):
    """The rule of the operator over lists of words, all windows against all."""

    def parse(value):
        w = value.split()
        kinds = []
        for k, x in enumerate(w):
            unit = k > 0 and w[k - 1][0].isdigit() and x.lower() in templates.UNITS
            kinds.append("N" if x[0].isdigit() else "U" if unit else "C" if k and x[0].isupper() else "")
        low = [x.lower() for x in w]
        return low, kinds, [k or x for k, x in zip(kinds, low, strict=True)]

    (a, _, a_shown), (b, b_kinds, b_shown) = parse(text), parse(item)
    size = min(8, len(b))
    starts = range(len(b) - size + 1)
    has = {i for i in starts if b_kinds[i : i + size].count("") >= 4}
    hits = []
    for i in starts:
        for p in range(len(a) - size + 1):
            if a[p : p + size] == b[i : i + size]:
                hits.append((i, p, []))
            if i in has and a_shown[p : p + size] == b_shown[i : i + size]:
                hits.append((i, p, [(k, b[i + k], a[p + k]) for k in range(size) if b_kinds[i + k]]))
    for off in (0, 8):
        for band in {(p - i + off) // 16 for i, p, _ in hits}:
            own = [x for x in hits if (x[1] - x[0] + off) // 16 == band]
            pairs = {(p + k, x, y) for _, p, s in own for k, x, y in s}
            votes, total = Counter((x, y) for _, x, y in pairs), Counter(x for _, x, _ in pairs)
            good = [h for h in own if all(2 * votes[x, y] > total[x] for _, x, y in h[2])]
            found = {i for i, _, _ in good}
            cover = len({i + k for i in found for k in range(size)})
            if 2 * len(found) >= len(starts) or (has and 2 * len(found & has) >= len(has)):
                return True
            if 2 * cover >= len(b) and cover >= 13:
                return True
    return False


def test_contamination_equals_brute_force(spark, work):
    draw = np.random.Generator(np.random.PCG64(17))
    plain = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "tau"]
    items, texts = [], []
    for _ in range(12):
        kind = draw.choice(4, int(draw.integers(9, 45)), p=[0.75, 0.13, 0.07, 0.05])
        items.append(" ".join([plain[draw.integers(8)], "Berlin", str(draw.integers(3, 6)), "7 km"][k]
                              if k else str(draw.choice(plain)) for k in kind))
    for k in range(240):
        w = items[k % 12].split()
        for _ in range(int(draw.integers(0, 5))):
            p = int(draw.integers(len(w)))
            w[p] = str(draw.choice(["8", "9", "Paris", "mile", *plain]))
        if k % 3 == 0:
            w = [{"3": "8", "4": "9", "Berlin": "Rome"}.get(x, x) for x in w]
        if k % 5 == 0:
            cut = int(draw.integers(1, len(w)))
            w = [*w[cut:], *draw.choice(plain, int(draw.integers(0, 30))), *w[:cut]]
        texts.append(" ".join([*draw.choice(plain, 12), *w, *draw.choice(plain, 12)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in templates.contamination(df, bench, work).collect()}
    want = {k: [i for i, x in enumerate(items) if contaminated_by_hand(t, x)] for k, t in enumerate(texts)}
    assert found == want
    assert 40 < sum(map(bool, want.values())) < 220


def test_contamination_of_odd_rows(spark, work):
    item = "which of these seven colours has the shortest wave of all"
    rows = [(1, item, "a", "x", 1), (1, item, "b", "y", 2), (2, None, "c", None, 3), (None, None, "d", None, 4),
            (None, item, "e", None, 5), (3, "", "f", "z", 6), (4, "no such words", "g", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, row string, salt int")
    bench = spark.createDataFrame([(0, item, "k"), (0, item, "k"), (None, item, "k"), (1, None, "k")],
                                  "item_id long, text string, key string")
    kept = templates.decontaminate(df, bench, work)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[2], rows[3], rows[5], rows[6]])
    found = Counter((r["doc_id"], r["contaminated"]) for r in templates.contamination(df, bench, work).collect())
    assert found == {(1, True): 2, (2, False): 1, (None, False): 1, (None, True): 1, (3, False): 1, (4, False): 1}
    assert not templates.decontaminate(df.limit(0), bench, work).collect()


def test_contamination_finds_exact_copies_of_any_item(spark, work):
    items = [
        "12 + 7 = 19", "Anna Berta Carl Dora Emil Fritz Gerd Hans Ida Jan", "How many legs has a spider?",
        "1 2 3 4 5 6 7 8 9 10 11 12", "Name The Capital Of France", "Paris", "", "...",
    ]
    texts = [
        *(f"{words(30)}. {x}\n{words(30)}" for x in items[:6]),
        *(f"They asked us, {x[0].lower()}{x[1:]} and so on" for x in items[1:5]),
        *(f"They asked us {x} and so on" for x in items[1:5]), "They went to Paris by 12 + 7 = 19 ways", "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in templates.contamination(df, bench, work).collect()}
    want = [[0], [1], [2], [3], [4], [5], [1], [2], [3], [4], [1], [2], [3], [4], [], []]
    assert [found[k] for k in range(len(texts))] == want


def test_urls(spark):
    asked = [
        "http://A.Example.NET/en/1?x", "http://net/", "http://x.net", "http://notnet/x", "https://a.org/fr/z#t",
        "nothing", None, "http://example.com/de/", "x://example.com?q=http://b.net/", "http://example.com/d",
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, registered.RULES).collect()}
    assert found[0] == ("example.net/en/", "allow") and found[1] == ("net/", "block")
    assert found[4] == ("org/fr/", "allow") and found[7] == ("example.com/de/", "block")
    assert {found[k] for k in (2, 3, 5, 6, 8, 9)} == {(None, "allow")}
    assert {r["verdict"] for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_html_content():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><div id=content><h1>A &amp; B</h1>"
        "<p>First   long paragraph with many words in it<br>and a line.<p>No.</p>"
        "<div class=ad>Buy this</div><p>Second long paragraph with many words in it.</p></div>"
        "<div class=comments><p>I am a reader with a long comment about all this.</p></div>"
        "<script>var a='</p>'</script><footer>&copy; x</footer></body></html>"
    )
    assert html.main_text(page) == (
        "A & B\n\nFirst long paragraph with many words in it and a line.\n\nNo.\n\n"
        "Second long paragraph with many words in it."
    )
    assert html.main_text("") == "" and html.main_text("<p") == ""


def test_html_keeps_unequal_parts():
    short = [f"Short paragraph {k}. " + words(70) for k in range(3)]
    long = "Long paragraph. " + words(1500)
    parts = "".join(f"<p>{p}</p>" for p in short), f"<p>{long}</p>"
    menu = "<div><a href=a>Home page of this site</a> <a href=b>All the other pages of it</a></div>"
    want = "\n\n".join([*short, long])
    for tag in ("section", "article", "div"):
        inner = "".join(f"<{tag}>{p}</{tag}>" for p in parts)
        assert html.main_text(f"<body>{menu}<div id=content>{inner}</div></body>") == want
    inner = f"<article>{parts[1]}</article><div>{parts[0]}</div>"
    assert html.main_text(f"<body>{menu}<div>{inner}</div></body>") == "\n\n".join([long, *short])


def test_html_layout_names_are_no_marks():
    text = "The text of this page. " + words(80)
    body = f"<div id=content><p>{text}</p><p>More of it here.</p></div>"
    want = f"{text}\n\nMore of it here."
    names = [
        "class='container has-sidebar'", "class=with-comments", "class=no-header", "id=search-results",
        "class='post related-topics'", "class=sidebar", "class=content-sidebar-wrap",
    ]
    for name in names:
        for inner in (body, f"<article>{body}</article>"):
            assert html.main_text(f"<body><div {name}>{inner}</div></body>") == want
    for name in ("class=ad-slot", "id=page-footer", "class='x cookie-notice'", "role=navigation", "class=comments"):
        noise = f"<div {name}>{words(20)}</div><p>And <span class=ad>buy</span>more.</p>"
        assert html.main_text(f"<article>{body}{noise}</article>") == f"{want}\n\nAnd more."
        assert html.main_text(f"<body><div {name}>{words(200)}</div><article>{body}</article></body>") == want
    said = "".join(f"<article class=comment-body><p>{words(90)}</p></article>" for _ in range(3))
    page = f"{body}<div class=comments>{said}</div>"
    assert html.main_text(f"<body><article>{page}</article></body>") == want
    page = f"<header class=entry-header><h1>A title</h1></header>{body}"
    assert html.main_text(f"<body><article>{page}</article></body>") == f"A title\n\n{want}"


def test_html_clusters_alone_find_the_content():
    """No article, no name that says anything: the lines' ratios choose."""
    long, middle, short = words(300), words(90), "A short line."
    menu = "<div><ul>" + "".join(f"<li><a href=x>part {k}</a></li>" for k in range(8)) + "</ul></div>"
    advert, foot = "<div class=x1>Buy this now, it is cheap.</div>", "<div>(c) example.com, all rights reserved here</div>"
    body = f"<h2>Of cats</h2><p>{middle}</p><p>{short}</p><p>{long}</p><ul><li>one<li>two</ul><p>{middle}</p>"
    want = "\n\n".join(["Of cats", middle, short, long, "one", "two", middle])
    assert html.main_text(f"<body>{menu}{advert}<div class=x2>{body}</div>{foot}</body>") == want
    assert html.main_text(f"<body>{advert}{menu}<div>{body}</div>{menu}{foot}</body>") == want
    # Two parts, with nothing that names them.
    page = f"<body>{menu}{advert}<div><div><p>{middle}</p></div><div>{body}</div></div>{foot}{menu}</body>"
    assert html.main_text(page) == f"{middle}\n\n{want}"
    # Clusters less than a factor of three apart are one.
    assert html.high_cluster(np.array([1.0, 1.2, 5.0, 5.5])).tolist() == [False, False, True, True]
    assert html.high_cluster(np.array([4.6, 5.0, 5.5])).all()


def test_html_forms_and_open_menus_around_the_content():
    text = words(200)
    menu = "<ul>" + "".join(f"<li><a href=x>part {k}</a></li>" for k in range(8)) + "</ul>"
    for tag in ("article", "div"):
        inner = f"<{tag}><p>{text}</p><p>End.</p></{tag}>"
        for page in (
            f"<form action=x><nav>{menu}</nav><input name=q><button>Go</button>{inner}</form>",
            f"<nav>{menu}{inner}",
            f"<nav>{menu}</nav><form><label>Your name, if you please</label><input></form>{inner}",
            f"<aside><p>{text[:200]}</p></aside>{inner}<footer><p>{text[:200]}</p></footer>",
        ):
            assert html.main_text(f"<body>{page}</body>") == f"{text}\n\nEnd."
    # In an article a name may end in a word that elsewhere marks what is left out.
    page = f"<article><p>{text}</p><p class=editor-notice>Edited.</p><div class=binary-search>It halves.</div>"
    assert html.main_text(f"{page}<div class=cookie-notice>Cookies!</div></article>") == f"{text}\n\nEdited.\n\nIt halves."
    assert html.main_text(f"<form><p>Name</p><p>{words(3)}</p></form>") == ""


def test_html_unclosed_and_stray_tags_cost_little():
    from time import process_time

    def cost(n):
        page = "<body><i><div>" + "<font>" * n + "</i>" * n + f"<p>{words(80)}</p></div></body>"
        start = process_time()
        assert html.main_text(page)
        return process_time() - start

    cost(500)
    assert cost(16_000) < 16 * max(cost(2_000), 0.02)  # squared, it would be 64 times as much


def test_html_rows(spark):
    page = f"<body><div id=content><p>{'A sentence of the page. ' * 9}</p></div></body>"
    rows = [(1, "u", page, "x"), (1, "u", page, "y"), (2, None, None, "z"), (3, "v", "", None), (None, "w", page, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    text = ("A sentence of the page. " * 9).strip()
    found = [tuple(r[c] for c in ("page_id", "url", "text", "n_chars")) for r in html.extract_text(df).collect()]
    whole = len(text)
    want = [(1, "u", text, whole), (1, "u", text, whole), (2, None, "", 0), (3, "v", "", 0), (None, "w", text, whole)]
    assert Counter(found) == Counter(want)
    assert not html.extract_text(df.limit(0)).collect()


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["op1_mix_sources", "op8_url_filters", "op9_ngram_jaccard"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = duck.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registered.queries()[name](spark, str(DATA)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_suffix_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = removed_by_hand([r["text"] for r in docs], 400)
    found = {r["doc_id"]: r for r in registered.op4_suffix_dedup(spark, str(DATA)).collect()}
    for r, kept in zip(docs, want, strict=True):
        assert found[r["doc_id"]]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert found[r["doc_id"]]["text"] == kept.decode(errors="replace")


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_pipeline_runs(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, str(DATA)).collect()
    assert found and all(r["n_tokens"] >= 1 for r in found)
    assert zlib.crc32(b"") == 0


def test_encoder_equals_the_library_on_odd_texts():
    import random as plain_random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from histmerge.llm.batches import slices

    path = registered.tokenizer_path()
    library, r = Tokenizer.from_file(path), plain_random.Random(5)
    letters = [*"ab cd  .,!'\n\té᠎日本　\xa0", *" " * 6, "word", "longerwordthatgoesoverthelimit", "it's", "end.",
               "\r\n", "x" * 24, "y" * 25]
    for most in (50, 500, 10**6) * 3:
        encoder = tokens.Encoder(path, most=most)
        for limit in (50, 1000, 1 << 18):
            texts = [None if k % 20 == 0 else "".join(r.choices(letters, k=r.randrange(40))) for k in range(100)]
            found = []
            for _, part in slices(pa.record_batch([pa.array(texts, pa.string())], ["text"]), limit=limit):
                ids, counts = encoder.encode(part)
                found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_known_parts_are_found_by_their_bytes():
    parts = list({bytes(random.integers(97, 99, int(n), dtype=np.uint8)) for n in random.integers(0, 25, 6000)})
    size = np.array([len(p) for p in parts])
    words = tokens.Known.read(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
    known = tokens.Known()
    for lo in range(0, len(parts), 700):
        some = slice(lo, lo + 700)
        assert (known.find([w[some] for w in words], size[some]) == -1).all()
        known.add([w[some] for w in words], size[some], np.arange(len(parts))[some] * 3)
    assert (known.find(words, size) == np.arange(len(parts)) * 3).all()
    half = known.below(3000).find(words, size)
    assert (half[:1000] == np.arange(1000) * 3).all() and (half[1000:] == -1).all()
