"""Removal of byte strings that occur more than once, by a merge sort of suffixes.

A string of ``length`` bytes that starts anywhere else as well is removed, in
every place. Sorting the suffixes at all bytes would exchange many times the
input, so suffixes are sorted at anchors: the byte positions where the hash of
the next ``length`` / 2 bytes is the least of some window. Both places of a
repeated string have the same anchors within it, so a suffix at an anchor and
the bytes before it (its context, ``1.5 * length`` bytes at most) tell all
repeated strings around it. Anchors whose hash occurs once are sifted out first.

The sort is a distributed merge sort that never compares a known common prefix
again. Every task sorts its contexts and front-codes them (the length of the
prefix shared with the one before, then the rest); the runs are exchanged by
ranges of the suffix; a loser tree merges a range's runs, in which every
contestant carries its common prefix with the last winner, and bytes are only
looked at behind two equal ones. The merged contexts and their common prefixes
give blocks of equal suffixes; blocks of equal left contexts are numbered the
same way; two contexts in one block of either kind repeat a string.

An anchor with more than ``most`` places is a hot one: its windows are counted
as rows by two 64-bit hashes instead, with partial sums before the exchange; the
rows of one window are dealt to many tasks by their places.

Defined results: null and empty texts keep nothing and lose nothing; a text of
at least ``length`` bytes that occurs twice is removed whole; shorter texts are
never touched; matches never cross documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import (
    VALUES,
    Texts,
    _powers,
    binaries,
    map_batches,
    map_slices,
    mix,
    slices,
    with_columns,
)
from histmerge.llm.marks import bitmap, marked
from histmerge.workspace import Workspace

LENGTH = 400
#: Places of an anchor above which its windows are counted as rows.
MOST_PLACES = 100_000
#: Contexts that a task sorts at once, and ranges for each shuffle partition.
RUN_CONTEXTS, RANGES = 20_000, 3
#: One anchor in so many may be drawn to find the ranges' bounds.
DRAWN = 1 << 10
#: Bits of the bitmap of hot anchors.
HOT_BITS = 20
OTHER_VALUES = mix(VALUES)


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    size, out = 1, a
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    if size < width:
        out = pick(out[: len(out) - (width - size)], out[width - size :])
    return out


def span_hashes(texts: Texts, width: int, values: np.ndarray = VALUES) -> np.ndarray:
    """Hashes of the ``width`` bytes from each position."""
    n = len(texts.data) - width + 1
    sums = texts.prefix_hash(values)
    _, down = _powers.of(len(texts.data) + 1)
    return mix((sums[width:] - sums[:n]) * down[:n])


def anchors(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors."""
    n, half = len(texts.data), length // 2
    sizes = np.diff(texts.offsets)
    if n < length or sizes.max() < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = span_hashes(texts, half)
    width = length - half + 1
    least = sliding(h, width, np.minimum)
    # Windows that would cross a row's end count for nothing.
    inside = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, texts.offsets[:-1][long], 1)
    np.add.at(inside, texts.offsets[1:][long] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    end = min(len(a), len(b))
    while start < end:
        stop = min(start + 64, end)
        x = int.from_bytes(a[start:stop]) ^ int.from_bytes(b[start:stop])
        if x:
            return stop - (x.bit_length() + 7) // 8
        start = stop
    return end


class Run:
    """Sorted, distinct, front-coded keys, each with its places."""

    @staticmethod
    def pack(keys: list[bytes], places: list[list[bytes]]) -> bytes:
        """``keys`` in order; a place is 16 bytes of the text's digest and 8 of its position."""
        lengths = np.array([len(k) for k in keys])
        grid = np.zeros((len(keys), lengths.max()), np.uint8)
        reach = np.arange(grid.shape[1])
        inside = reach < lengths[:, None]
        grid[inside] = np.frombuffer(b"".join(keys), np.uint8)
        shared = np.zeros(len(keys), np.int64)
        if len(keys) > 1:
            differ = (grid[1:] != grid[:-1]) | ~(inside[1:] & inside[:-1])
            shared[1:] = np.where(differ.any(1), differ.argmax(1), np.minimum(lengths[1:], lengths[:-1]))
        rest = grid[inside & (reach >= shared[:, None])]
        heads = np.array([[len(keys)]], "<i8").tobytes()
        return b"".join(
            [
                heads, shared.astype("<i4").tobytes(), (lengths - shared).astype("<i4").tobytes(),
                np.array([len(p) for p in places], "<i4").tobytes(),
                b"".join(x for p in places for x in p), rest.tobytes(),
            ]
        )

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        counts = np.frombuffer(blob, "<i4", 3 * n, 8).reshape(3, n)
        self.shared, self.rest, self.count = (c.tolist() for c in counts)
        self.blob, self.place = blob, 8 + 12 * n
        self.at = self.place + 24 * int(counts[2].sum())
        self.n, self.next, self.key = n, 0, b""
        self.prefix, self.places = 0, b""

    def advance(self) -> bool:
        """Go to the next key; ``prefix`` is what it shares with the one before."""
        k = self.next
        if k == self.n:
            return False
        self.next, self.prefix = k + 1, self.shared[k]
        end = self.at + self.rest[k]
        self.key = self.key[: self.prefix] + self.blob[self.at : end]
        self.at = end
        end = self.place + 24 * self.count[k]
        self.places, self.place = self.blob[self.place : end], end
        return True


class LoserTree:
    """Merges runs; each contestant's ``prefix`` is its common prefix with the
    contestant that it lost to, or with the last key that came out."""

    def __init__(self, runs: list[Run]):
        self.runs = [r if r.advance() else None for r in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs += [None] * (self.size - len(self.runs))
        for r in self.runs:
            if r is not None:
                r.prefix = 0
        # The losers of all matches; the winner of the first ones goes up.
        self.losers: list[int] = [0] * self.size
        up = list(range(self.size))
        for level in range(self.size.bit_length() - 1):
            first = self.size >> (level + 1)
            winners = []
            for k in range(0, len(up), 2):
                win, lose = self.match(up[k], up[k + 1])
                self.losers[first + k // 2] = lose
                winners.append(win)
            up = winners
        self.winner = up[0]

    def match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.runs[a], self.runs[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if x.prefix > y.prefix:
            return a, b
        if x.prefix < y.prefix:
            return b, a
        shared = common_prefix(x.key, y.key, x.prefix)
        if x.key[shared:] <= y.key[shared:]:
            y.prefix = shared
            return a, b
        x.prefix = shared
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        """Keys in order with the prefix shared with the key before, and places."""
        while (run := self.runs[self.winner]) is not None:
            yield run.key, run.prefix, run.places
            leaf = self.winner
            if not run.advance():
                self.runs[leaf] = None
            node = (self.size + leaf) >> 1
            winner = leaf
            while node:
                winner, self.losers[node] = self.match(winner, self.losers[node])
                node >>= 1
            self.winner = winner


def repeated_around(
    keys: list[bytes], shared: np.ndarray, many: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per context the first and last repeated string around its anchor.

    They are told by how far before the anchor they start: ``far`` and ``near``;
    ``far`` is -1 if there is none. All strings between them overlap at the
    anchor, so their union is what both cover. ``many`` marks contexts with
    several places. ``keys`` are in order, ``shared`` their common prefixes.
    """
    n, half = len(keys), length // 2
    back = length - half
    right = np.empty(n, np.int64)
    left: list[bytes] = []
    for k, key in enumerate(keys):
        short = key.find(b"\xff", 0, length)
        right[k] = length if short < 0 else short
        left.append(key[length:] if short < 0 else key[short + 1 :])
    before = np.array([len(x) for x in left])
    far, near = np.full(n, -1), np.full(n, length)
    fits = before + right >= length
    alone = many & fits
    far[alone] = np.minimum(back, before[alone])
    near[alone] = np.maximum(0, length - right[alone])
    # Contexts with one anchor string; only where there are several can others match.
    group = np.cumsum(shared < half)
    inside = np.flatnonzero((np.bincount(group)[group] > 1) & fits)
    if not len(inside):
        return far, near
    run_min = _between(shared, inside)
    order = sorted(range(len(inside)), key=lambda k: (group[inside[k]], left[inside[k]]))
    order = np.array(order)
    rows = inside[order]
    grid = np.full((len(rows), back), 255, np.uint8)
    grid[np.arange(back) < before[rows, None]] = np.frombuffer(b"".join(left[k] for k in rows), np.uint8)
    differ = grid[1:] != grid[:-1]
    same_left = np.where(differ.any(1), differ.argmax(1), back) if len(rows) > 1 else np.empty(0, np.int64)
    same_left = np.concatenate([[-1], np.where(group[rows[1:]] == group[rows[:-1]], same_left, -1)])
    lefts = np.empty(len(rows), np.int64)
    for d in range(back + 1):
        usable = (before[inside] >= d) & (right[inside] >= length - d)
        if not usable.any():
            continue
        lefts[order] = np.cumsum(same_left < d)
        block = np.cumsum(run_min < length - d) * (len(rows) + 1) + lefts
        block = block[usable]
        ranked = np.argsort(block, kind="stable")
        same = block[ranked][1:] == block[ranked][:-1]
        hit = np.zeros(len(block), bool)
        hit[ranked[1:]] |= same
        hit[ranked[:-1]] |= same
        found = inside[usable][hit]
        far[found] = np.maximum(far[found], d)
        near[found] = np.minimum(near[found], d)
    return far, near


def _between(shared: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Common prefix of each chosen key with the chosen one before it."""
    # A part of reduceat ends where the next begins, behind the chosen key itself.
    out = np.minimum.reduceat(shared[: chosen[-1] + 1], np.concatenate([[0], chosen[:-1] + 1]))
    out[0] = 0
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = with_columns(docs, {"doc_id": "long", "text": "string"}).select("doc_id", text.alias("text"))
    return plain.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def _new_rows(part: pa.RecordBatch, seen: set[bytes]) -> np.ndarray:
    """Which rows have a text that the task has not seen yet."""
    out = np.zeros(len(part), bool)
    for k, key in enumerate(part.column(part.schema.get_field_index("key")).to_pylist()):
        if key not in seen:
            seen.add(key)
            out[k] = True
    return out


def anchor_counts(keyed: DataFrame, length: int) -> DataFrame:
    """``h, places, head``: each anchor hash, how often it occurs, and for some
    the first bytes of a suffix that begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, texts in slices(batch):
                at, h = anchors(texts, length)
                new = _new_rows(part, seen)[texts.rows(at)]
                at, h = at[new], h[new]
                h, first, count = np.unique(h, return_index=True, return_counts=True)
                heads = [
                    texts.data[at[k] : at[k] + length // 2].tobytes() if x % DRAWN == 0 else None
                    for k, x in zip(first, h.tolist(), strict=True)
                ]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(count), pa.array(heads, pa.binary())],
                    ["h", "places", "head"],
                )

    rows = map_batches(keyed.select("key", "text"), run, "h long, places long, head binary")
    return rows.groupBy("h").agg(F.sum("places").alias("places"), F.max("head").alias("head"))


def suffix_runs(keyed: DataFrame, length: int, marks, hot, bounds) -> DataFrame:
    """``range, run``: front-coded runs of the marked anchors' contexts."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: dict[bytes, list[bytes]] = {}

        def runs() -> pa.RecordBatch:
            ordered = sorted(held)
            place = np.array([bisect_right(bounds.value, k[:half]) for k in ordered])
            cuts = np.flatnonzero(np.diff(place)) + 1
            parts = np.split(np.arange(len(ordered)), cuts)
            blobs = [Run.pack([ordered[k] for k in p], [held[ordered[k]] for k in p]) for p in parts]
            out = pa.record_batch(
                [pa.array(place[[p[0] for p in parts]], pa.int32()), binaries(blobs)], ["range", "run"]
            )
            held.clear()
            return out

        for batch in batches:
            for part, texts in slices(batch):
                at, h = anchors(texts, length)
                row = texts.rows(at)
                use = _new_rows(part, seen)[row]
                use &= marked(marks.value, h) & ~marked(hot.value, h, HOT_BITS)
                keys = part.column(part.schema.get_field_index("key")).to_pylist()
                data = texts.data.tobytes()
                for p, r in zip(at[use].tolist(), row[use].tolist(), strict=True):
                    lo, hi = int(texts.offsets[r]), int(texts.offsets[r + 1])
                    right = data[p : min(p + length, hi)]
                    if len(right) < length:
                        right += b"\xff"  # in no UTF-8 text: a suffix that ends here
                    key = right + data[max(lo, p - length + half) : p][::-1]
                    held.setdefault(key, []).append(keys[r] + (p - lo).to_bytes(8, "little"))
                    if len(held) >= RUN_CONTEXTS:
                        yield runs()
        if held:
            yield runs()

    return map_batches(keyed.select("key", "text"), run, "range int, run binary")


def merged_spans(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """``key, start, stop``: repeated bytes around each sorted anchor."""

    def spans(blobs: list[bytes]) -> pa.RecordBatch:
        keys: list[bytes] = []
        shared: list[int] = []
        places: list[set[bytes]] = []
        for key, prefix, where in LoserTree([Run(b) for b in blobs]):
            here = {where[k : k + 24] for k in range(0, len(where), 24)}
            if keys and prefix == len(key) == len(keys[-1]):
                places[-1] |= here
            else:
                keys.append(key)
                shared.append(prefix)
                places.append(here)
        many = np.array([len(p) > 1 for p in places])
        far, near = repeated_around(keys, np.array(shared), many, length)
        found, start, stop = [], [], []
        for k in np.flatnonzero(far >= 0):
            for place in places[k]:
                at = int.from_bytes(place[16:], "little")
                found.append(place[:16])
                start.append(at - int(far[k]))
                stop.append(at - int(near[k]) + length)
        return pa.record_batch(
            [binaries(found), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
            ["key", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for place, blob in zip(*batch.columns, strict=True):
                if place.as_py() != here and held:
                    yield spans(held)
                    held = []
                here = place.as_py()
                held.append(blob.as_py())
        if held:
            yield spans(held)

    dealt = runs.repartition(parts, "range").sortWithinPartitions("range")
    return map_batches(dealt, run, "key binary, start long, stop long")


def among_repeated(rows: DataFrame, parts: int) -> DataFrame:
    """The rows ``one, two, key, start`` whose window has two places or more.

    A window's rows are dealt by their places to ``parts`` parts, so that a task
    gets a part of them only; what is known of a whole window is one row a part.
    """
    place = F.struct("key", "start")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key", "start"), F.lit(parts)).cast("int"))
    some = dealt.groupBy("one", "two", "part").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    whole = some.groupBy("one", "two").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.collect_list("part").alias("parts")
    )
    twice = whole.where("a <> b").select("one", "two", F.explode("parts").alias("part"))
    return dealt.join(twice, ["one", "two", "part"], "left_semi")


def hot_spans(keyed: DataFrame, length: int, hot, work: Workspace, parts: int) -> DataFrame:
    """``key, start, stop``: repeated strings around the hot anchors."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, texts in slices(batch):
                at, h = anchors(texts, length)
                row = texts.rows(at)
                use = _new_rows(part, seen)[row] & marked(hot.value, h, HOT_BITS)
                at, row = at[use], row[use]
                if not len(at):
                    continue
                start = np.unique(at[:, None] - np.arange(length - half + 1))
                start = start[start >= 0]
                row = texts.rows(start)
                fits = start + length <= texts.offsets[row + 1]
                start, row = start[fits], row[fits]
                one = span_hashes(texts, length)[start]
                two = span_hashes(texts, length, OTHER_VALUES)[start]
                keys = part.column(part.schema.get_field_index("key"))
                yield pa.record_batch(
                    [
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        keys.take(pa.array(row)), pa.array(start - texts.offsets[row]),
                    ],
                    ["one", "two", "key", "start"],
                )

    schema = "one long, two long, key binary, start long"
    rows = work.keep(map_batches(keyed.select("key", "text"), run, schema), "hot-windows")
    found = among_repeated(rows, parts)
    return found.select("key", "start", (F.col("start") + length).alias("stop")).distinct()


def repeated_spans(
    keyed: DataFrame, work: Workspace, length: int = LENGTH, most: int = MOST_PLACES
) -> DataFrame:
    """``key, start, stop`` of repeated bytes; ``keyed`` has ``text`` and its digest ``key``."""
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    often = work.keep(anchor_counts(keyed, length).where("places > 1"), "anchors")
    marks = spark.sparkContext.broadcast(bitmap(often.select("h")))
    hot = spark.sparkContext.broadcast(bitmap(often.where(F.col("places") > most).select("h"), HOT_BITS))
    drawn = often.where("head is not null").orderBy("h").limit(64 * RANGES * parts).select("head").collect()
    heads = sorted(bytes(r["head"]) for r in drawn)
    step = max(1, len(heads) // (RANGES * parts))
    bounds = spark.sparkContext.broadcast(heads[step::step])
    found = merged_spans(suffix_runs(keyed, length, marks, hot, bounds), length, parts)
    if hot.value.any():
        found = found.unionAll(hot_spans(keyed, length, hot, work, parts))
    return found


def remove_repeats(
    docs: DataFrame, work: Workspace, length: int = LENGTH, most: int = MOST_PLACES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: ``kept`` are the bytes that stay."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, work, length, most)
    by_text = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    told = by_text.join(copies, "key", "full")
    rows = keyed.join(told, "key", "left").select("doc_id", "text", "spans", "copies")

    def cut(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        ids, spans, copies = (
            part.column(part.schema.get_field_index(c)) for c in ("doc_id", "spans", "copies")
        )
        size = np.diff(texts.offsets)
        removed, runs, kept = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), []
        for k in range(len(part)):
            text, n = texts.text(k), int(size[k])
            whole = n >= length and copies[k].is_valid
            found = [(0, n)] if whole else sorted(
                (s["start"], s["stop"]) for s in (spans[k].as_py() or [])
            )
            out, at = [], 0
            for start, stop in found:
                if start > at or (start == 0 and at == 0 and not runs[k]):
                    out.append(text[at:start])
                    runs[k] += 1
                    removed[k] += stop - start
                else:
                    removed[k] += max(0, stop - at)
                at = max(at, stop)
            out.append(text[at:])
            kept.append(b"".join(out))
        return pa.record_batch(
            [ids, pa.array(size), pa.array(removed), pa.array(runs), binaries(kept)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return map_slices(rows, cut, schema)

