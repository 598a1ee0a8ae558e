"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams.

A document's features are the presence of its words, word pairs and skip-grams
(two words with one or two others between them), hashed to 2**20 coordinates.
Training goes over a bounded, balanced sample of labelled documents with a rate
for each coordinate; the L1 term keeps all but a few weights at zero, so the
model that is broadcast is a short list of (coordinate, weight). L1 also draws the
scores to the commoner label, so the bias is moved: models of all folds but one
score that fold of the training rows, and the score that separates the labels best
there (by F1) becomes ``THRESHOLD``.

Words are runs of ASCII letters, digits and bytes beyond ASCII, A-Z as a-z.

Defined results: a null or empty text has no feature and gets the bias' score;
labels that are null are left out; a document with several labels counts once
for each; a document id with several texts is learned by one of them; without any
labelled document every score is 0, and with one label only the bias stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import (
    FOLDED,
    Texts,
    binaries,
    distinct_by_row,
    map_batches,
    map_slices,
    mix,
    with_columns,
)

BITS = 20
#: Most rows of each label in the training sample; passes over it.
SAMPLE = 2_500
#: Most coordinates of a document in the sample, and folds of the calibration.
SAMPLE_FEATURES, FOLDS = 8_192, 4
#: Rows seen in training, repeats included, and most passes over a small sample.
STEPS, PASSES = 20_000, 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
THRESHOLD = 0.7

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Distances of the second word of a pair, and the salt of each kind.
GAPS = {1: np.uint64(0x51ED270B), 2: np.uint64(0x2545F491), 3: np.uint64(0x9E6C63D0)}


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of all features, repeats included."""
    starts, ends, rows = texts.spans(WORD)
    words = texts.hashes(starts, ends, FOLDED)
    drop = np.uint64(64 - bits)
    out_rows, out = [rows], [words >> drop]
    for gap, salt in GAPS.items():
        same = rows[:-gap] == rows[gap:]
        pair = mix(words[:-gap] * np.uint64(3) + mix(words[gap:] + salt))
        out_rows.append(rows[:-gap][same])
        out.append(pair[same] >> drop)
    return np.concatenate(out_rows), np.concatenate(out).astype(np.int64)


@dataclass
class Weights:
    """The coordinates that are not zero, in order, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.at] = self.weight
        return out


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Weights:
    """FTRL-proximal over the rows (distinct coordinates each), in a fixed order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = np.array([1 << bits])

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.where(at == bias[0], zi, np.sign(zi) * np.maximum(np.abs(zi) - L1, 0))
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(min(PASSES, -(-STEPS // max(1, len(rows))))):
        for k in order.permutation(len(rows)):
            at = np.concatenate([rows[k], bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    used = np.flatnonzero(np.abs(z[:-1]) > L1)
    return Weights(used, weights(used).astype(np.float32), float(weights(bias)[0]))


def training_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rows (``doc_id, toxic``) of each label, by a hash of the id."""
    known = with_columns(labels, {"doc_id": "long", "toxic": "int"}).where(
        "doc_id is not null and toxic in (0, 1)"
    )
    keyed = known.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(11)).alias("h"))
    near = keyed.groupBy("toxic").agg((F.lit(2.0 * size + 40) / F.count("*")).alias("part"))
    thinned = keyed.join(F.broadcast(near), "toxic").where(
        F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30)
    )
    best = thinned.groupBy("toxic").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("h", "doc_id"))), 1, size).alias("drawn")
    )
    return best.select("toxic", F.inline("drawn")).select("toxic", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Weights | None:
    """Weights from a sample of ``labels`` joined to the texts of ``docs``.

    The texts stay with the executors: a task gets the sample's coordinates
    (2 * ``size`` documents of ``SAMPLE_FEATURES`` at most) and returns the few
    weights, or the scores of a fold that it did not learn from.
    """
    chosen = F.broadcast(training_sample(labels, size))  # 2 * size rows at most
    # Copies of a text are in one fold.
    texts = (
        with_columns(docs, {"doc_id": "long", "text": "string"})
        .join(chosen, "doc_id")
        .withColumn("fold", F.pmod(F.xxhash64("text", F.lit(12)), F.lit(FOLDS)).cast("int"))
    )

    def extract(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        rows, found = distinct_by_row(*features(texts))
        cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
        # Coordinates are hashes: the first of them are a draw.
        blobs = [
            found[a : min(b, a + SAMPLE_FEATURES)].astype("<i4").tobytes()
            for a, b in zip(cuts, cuts[1:], strict=False)
        ]
        keep = ["doc_id", "toxic", "fold"]
        return pa.record_batch(
            [*(part.column(part.schema.get_field_index(c)) for c in keep), binaries(blobs)],
            [*keep, "at"],
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[dict]] = {}
        for r in (r for b in batches for r in b.to_pylist()):
            turns.setdefault(r["turn"], []).append(r)
        for turn, seen in sorted(turns.items()):
            seen.sort(key=lambda r: (r["doc_id"], r["toxic"]))
            rows = [np.frombuffer(r["one"]["at"], "<i4") for r in seen]
            known = np.array([r["toxic"] for r in seen], float)
            held = np.array([r["one"]["fold"] == turn for r in seen])
            if held.all():
                continue
            found = train([x for x, h in zip(rows, held, strict=True) if not h], known[~held])
            if turn == FOLDS:
                at, value = [*found.at.tolist(), -1], [*found.weight.astype(float).tolist(), found.bias]
            else:
                dense = found.dense()
                at = (-2 - known[held]).astype(int).tolist()
                value = [float(dense[rows[k]].sum()) + found.bias for k in np.flatnonzero(held)]
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(value, pa.float64())], ["at", "value"])

    rows = map_slices(texts, extract, "doc_id long, toxic int, fold int, at binary")
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("at", "fold")).alias("one"))
    dealt = one.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    learned = map_batches(dealt.repartition(FOLDS + 1, "turn"), learn, "at long, value double").collect()
    if not learned:
        return None
    bias = next(r["value"] for r in learned if r["at"] == -1)
    rest = sorted((r["at"], r["value"]) for r in learned if r["at"] >= 0)
    held = sorted((r["value"], -2 - r["at"]) for r in learned if r["at"] <= -2)
    cut = best_cut(np.array([v for v, _ in held]), np.array([y for _, y in held], int))
    if cut is not None:
        bias += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return Weights(
        np.array([a for a, _ in rest], np.int64), np.array([w for _, w in rest], np.float32), float(bias)
    )


def best_cut(values: np.ndarray, labels: np.ndarray) -> float | None:
    """The middle between the two neighbouring values that part label 1 (above) from
    label 0 with the best F1, the higher of equals; None without both labels."""
    if not 0 < labels.sum() < len(labels):
        return None
    order = np.argsort(-values, kind="stable")
    values, right = values[order], np.cumsum(labels[order])
    f1 = 2 * right / (np.arange(1, len(values) + 1) + right[-1])
    apart = np.flatnonzero(values[:-1] > values[1:])
    if not len(apart):
        return None
    k = apart[np.argmax(f1[apart])]
    return float(values[k] + values[k + 1]) / 2


def score(docs: DataFrame, weights: Weights | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    dense: list[np.ndarray] = []

    def work(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        model = shared.value
        out = np.zeros(len(texts))
        if model is not None:
            if not dense:
                dense.append(model.dense())
            rows, at = features(texts)
            hit = dense[0][at] != 0
            rows, at = distinct_by_row(rows[hit], at[hit])
            total = np.bincount(rows, dense[0][at], len(texts)) + model.bias
            out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        ids = part.column(part.schema.get_field_index("doc_id"))
        return pa.record_batch(
            [ids, pa.array(out), pa.array((out >= threshold).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )

    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    return map_slices(plain, work, "doc_id long, score double, predicted int")
