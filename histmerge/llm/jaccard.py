"""Exact n-gram Jaccard join by prefix trees.

A document's set is its distinct word shingles, as 64-bit ids whose numbers
follow one global order: shingles of one set alone first, then rare ones, by
counts over all documents in tables of fixed size, then by hash. Two sets that are similar enough share a
shingle among the first few of either one (the prefix), so a pair is looked for
only below a prefix shingle that both have.

The sets below one shingle are stored in a path-compressed trie. A set is
joined by one walk down: sets that begin alike share the overlap counted so
far, and a subtree is left as soon as the ids that remain on either side can't
reach the overlap that its sizes ask for. Subtrees all of whose sets are
already in the walker's own group are left as well; groups need one link only.

Equal sets are one node from the start. The first round meets every set at its
most frequent prefix shingle alone, which joins large groups of near copies
without any pair being listed. The second round goes through every prefix
shingle that still has sets of two groups, which makes the join complete. A
shingle with more sets than fit a task is dealt out in blocks, and pairs of
blocks meet in tasks of their own.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z.

Defined results: a text with fewer words than a shingle is one shingle; a null,
empty or wordless text has the empty set and is linked with nothing; documents
with equal sets are linked; ties and repeated rows need no rule, as links and
groups do not depend on any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import (
    FOLDED,
    SPACES,
    Texts,
    binaries,
    distinct_by_row,
    map_batches,
    mix,
    slices,
    windows,
    with_columns,
)
from histmerge.llm.graph import components
from histmerge.llm.marks import bitmap, marked
from histmerge.workspace import Workspace

#: A character of a word.
FILLED = r"[^\x20\x09-\x0D]"
#: Words of a shingle, and least similarity in percent.
WORDS, PERCENT = 5, 80
#: The tables of the global order: 2**SKETCH_BITS bytes and 2**REPEAT_BITS bits (32 MB).
SKETCH_BITS, REPEAT_BITS = 20, 28
#: Bits of a hash that are counted, and codes that a task sorts at once.
CODE_BITS, CODES_AT_ONCE = 44, 1 << 20
#: Most sets that meet in one tree; more are dealt out in blocks of half as many.
MOST_SETS = 20_000
WORD = ~SPACES


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distinct shingle hashes of all texts, ordered by row and hash."""
    starts, ends, rows = texts.spans(WORD)
    ids = texts.hashes(starts, ends, FOLDED)
    count = np.bincount(rows, minlength=len(texts))
    keys, at = windows(ids, rows, words)
    out_rows, out = [rows[at]], [keys]
    for fewer in range(1, words):
        if (count == fewer).any():
            keys, at = windows(ids, rows, fewer)
            whole = count[rows[at]] == fewer
            out_rows.append(rows[at[whole]])
            out.append(mix(keys[whole] + np.uint64(fewer)))
    return distinct_by_row(np.concatenate(out_rows), np.concatenate(out))


def digests(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """16 bytes for each row's set: two sums of different mixtures of its hashes."""
    out = np.zeros((n, 2), np.uint64)
    np.add.at(out[:, 0], rows, mix(values + np.uint64(0x1234567)))
    np.add.at(out[:, 1], rows, mix(values ^ np.uint64(0x7654321FEDCBA98)))
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Half powers of two, 63 at most; what is frequent comes late."""
    return np.minimum(2 * np.log2(counts + 1.0), 63).astype(np.uint8)


def pack_codes(codes: np.ndarray) -> bytes:
    """Sorted codes as differences, their bytes by place, so that they shrink when compressed."""
    steps = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_codes(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


class Order:
    """The global order of shingles, from tables of fixed size.

    ``repeated`` has a bit for the first ``REPEAT_BITS`` bits of a hash, set if
    any shingle there occurs in more than one set; ``level`` a byte for the
    first ``SKETCH_BITS``, the level of how many do. Shingles that occur once
    come first, then rare ones.
    """

    def __init__(self, repeated: np.ndarray, level: np.ndarray):
        self.repeated, self.level = repeated, level

    def ids(self, values: np.ndarray) -> np.ndarray:
        at = (values >> np.uint64(64 - REPEAT_BITS)).astype(np.int64)
        again = (self.repeated[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        level = self.level[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        return (
            (again.astype(np.uint64) << np.uint64(63))
            | (level.astype(np.uint64) << np.uint64(57))
            | (mix(values) >> np.uint64(7))
        )


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Of two similar sets, each has one of the shared ids among so many first ones."""
    return n - -(-n * percent // 100) + 1


def new_sets(
    batches: Iterator[pa.RecordBatch], words: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a task's batches with rows, hashes, digests, and which rows have
    a set that the task has not met before."""
    seen: set[bytes] = set()
    for batch in batches:
        for part, texts in slices(batch):
            rows, values = shingle_sets(texts, words)
            keys = digests(rows, values, len(texts))
            new = np.bincount(rows, minlength=len(texts)) > 0
            for k in np.flatnonzero(new):
                key = keys[k].tobytes()
                new[k] = key not in seen
                seen.add(key)
            yield part, rows, values, keys, new


def global_order(docs: DataFrame, words: int) -> Order:
    """Counts over all documents' sets, each task's own copies left out."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bits = min(14, max(6, (partitions - 1).bit_length()))
    parts, counters = 1 << bits, (1 << SKETCH_BITS) >> bits

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def codes() -> pa.RecordBatch:
            found = np.sort(np.concatenate(held))
            # Twice is as good as often.
            keep = np.ones(len(found), bool)
            keep[2:] = found[2:] != found[:-2]
            found = found[keep]
            cuts = np.searchsorted(found >> np.uint64(CODE_BITS - bits), np.arange(parts + 1))
            blobs = [pack_codes(found[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.record_batch(
                [pa.array(range(parts), pa.int32()), binaries(blobs), pa.nulls(parts, pa.binary())],
                ["part", "codes", "counts"],
            )

        for _, rows, values, _, new in new_sets(batches, words):
            values = values[new[rows]]
            total += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            held.append(values >> np.uint64(64 - CODE_BITS))
            size += len(values)
            if size >= CODES_AT_ONCE:
                yield codes()
                held.clear()
                size = 0
        if size:
            yield codes()
        blobs = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(total, parts)]
        yield pa.record_batch(
            [pa.array(range(parts), pa.int32()), pa.nulls(parts, pa.binary()), binaries(blobs)],
            ["part", "codes", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        held: list[np.ndarray] = []
        total = np.zeros(counters, np.int64)
        span = 1 << (REPEAT_BITS - bits)

        def result() -> pa.RecordBatch:
            found = np.sort(np.concatenate([np.empty(0, np.uint64), *held]))
            again = found[1:][found[1:] == found[:-1]] >> np.uint64(CODE_BITS - REPEAT_BITS)
            marks = np.zeros(span, bool)
            marks[again.astype(np.int64) % span] = True
            return pa.record_batch(
                [pa.array([here], pa.int32()), binaries([zlib.compress(np.packbits(marks).tobytes(), 1)]),
                 binaries([zlib.compress(levels(total).tobytes(), 1)])],
                ["part", "repeated", "level"],
            )

        for batch in batches:
            for part, blob, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != here:
                    if here is not None:
                        yield result()
                    here, total = part, np.zeros(counters, np.int64)
                    held.clear()
                if blob is not None:
                    held.append(unpack_codes(blob))
                if counts is not None:
                    total += np.frombuffer(zlib.decompress(counts), "<u4")
        if here is not None:
            yield result()

    texts = with_columns(docs, {"text": "string"})
    found = map_batches(texts, read, "part int, codes binary, counts binary")
    dealt = found.repartition(parts, "part").sortWithinPartitions("part")
    repeated = np.zeros((parts, (1 << REPEAT_BITS) // 8 // parts), np.uint8)
    level = np.zeros((parts, counters), np.uint8)
    for r in map_batches(dealt, add, "part int, repeated binary, level binary").collect():
        repeated[r["part"]] = np.frombuffer(zlib.decompress(r["repeated"]), np.uint8)
        level[r["part"]] = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
    return Order(repeated.reshape(-1), level.reshape(-1))


def scan(docs: DataFrame, words: int, percent: int, order, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Every document's size and set digest (``doc_id, text_key, n, key``), and
    ``token, place, key, n``: of each set the first ids that another set may have
    too, with their place in its order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n", "key", "token", "place"]
        for part, rows, values, keys, new in new_sets(batches, words):
            n = len(part)
            count = np.bincount(rows, minlength=n)
            blobs = binaries([k.tobytes() for k in keys])
            yield pa.record_batch(
                [
                    part.column(0), part.column(1), pa.array(count), blobs,
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                ],
                names,
            )
            chosen = new[rows]
            rows, ids = rows[chosen], order.value.ids(values[chosen])
            rank = np.lexsort((ids, rows))
            rows, ids = rows[rank], ids[rank]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            some = (place < prefix_size(count, percent)[rows]) & (ids >> np.uint64(63) == 1)
            rows, ids, place = rows[some], ids[some], place[some]
            nothing = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch(
                [
                    nothing, pa.nulls(len(rows), pa.string()), pa.array(count[rows]),
                    blobs.take(pa.array(rows)), pa.array(ids.view(np.int64)), pa.array(place),
                ],
                names,
            )

    plain = with_columns(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), "text"
    )
    schema = "doc_id long, text_key string, n long, key binary, token long, place long"
    found = work.keep(map_batches(plain, read, schema), "scanned")
    return (
        found.where("token is null").select("doc_id", "text_key", "n", "key"),
        found.where("token is not null").select("token", "place", "key", "n"),
    )


def wanted_sets(docs: DataFrame, words: int, order, marks) -> DataFrame:
    """``key, ids`` of the sets whose key is marked, ids in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, values, keys, new in new_sets(batches, words):
            first = np.array([int.from_bytes(k[:8], "big") for k in map(bytes, keys)], np.uint64)
            hit = np.flatnonzero(new & marked(marks.value, first))
            cuts = np.searchsorted(rows, np.arange(len(part) + 1))
            ids = [np.sort(order.value.ids(values[cuts[k] : cuts[k + 1]])) for k in hit]
            yield pa.record_batch(
                [binaries([keys[k].tobytes() for k in hit]), binaries([x.tobytes() for x in ids])],
                ["key", "ids"],
            )

    return map_batches(with_columns(docs, {"text": "string"}), run, "key binary, ids binary")


class Node:
    """Ids ``lo:hi`` of one set stand for those of all sets below."""

    __slots__ = ("children", "group", "hi", "least", "lo", "member", "most", "of")

    def __init__(self, of: int, lo: int, hi: int):
        self.of, self.lo, self.hi = of, lo, hi
        self.children: list[Node] = []
        self.member = self.group = -1
        self.least = self.most = 0


class PrefixTree:
    """Sets (ids in order) below one shingle, and the groups their links make.

    ``groups`` tells which sets are known to be linked; only links between
    different groups are looked for.
    """

    #: Ids of a path that are counted before the bound is looked at again.
    STRETCH = 64

    def __init__(self, sets: list[np.ndarray], percent: int, groups: list[int] | None = None):
        self.sets, self.percent = sets, percent
        self.parent = list(range(len(sets)))
        first: dict[int, int] = {}
        for k, g in enumerate(groups or []):
            self.parent[k] = first.setdefault(g, k)
        self.root = self._build()

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def _build(self) -> Node:
        sets = self.sets
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        root = Node(order[0] if order else 0, 0, 0)
        path, last = [root], None
        for k in order:
            x = sets[k]
            depth = 0
            if last is not None:
                m = min(len(x), len(last))
                other = np.flatnonzero(x[:m] != last[:m])
                depth = int(other[0]) if len(other) else m
            while path[-1].lo >= depth and len(path) > 1:
                path.pop()
            top = path[-1]
            if top.hi > depth:  # the path is shared in part: cut it
                rest = Node(top.of, depth, top.hi)
                rest.children, rest.member = top.children, top.member
                top.children, top.member, top.hi = [rest], -1, depth
            if depth == len(x):
                top.member = k
            else:
                leaf = Node(k, depth, len(x))
                leaf.member = k
                top.children.append(leaf)
                path.append(leaf)
            last = x
        self._bounds(root)
        return root

    def _bounds(self, root: Node) -> None:
        """Sizes of the smallest and largest set below each node, deepest first."""
        nodes = [root]
        for node in nodes:
            nodes += node.children
        for node in reversed(nodes):
            sizes = [c.least for c in node.children] + [c.most for c in node.children]
            if node.member >= 0:
                sizes.append(len(self.sets[node.member]))
            node.least, node.most = min(sizes, default=0), max(sizes, default=0)

    def same_group(self, node: Node, group: int) -> bool:
        """Whether all sets below are in ``group``; what is found uniform stays so."""
        if node.group < 0 and not node.children:
            node.group = node.member
        return node.group >= 0 and self.find(node.group) == group

    def settle(self, node: Node) -> None:
        marks = [c.group for c in node.children] + [node.member] * (node.member >= 0)
        if min(marks) >= 0 and len({self.find(g) for g in marks}) == 1:
            node.group = marks[0]

    def links_of(self, k: int) -> list[int]:
        """Join the groups of all sets that are similar to ``k``; the sets found."""
        x, percent, found = self.sets[k], self.percent, []
        nx = len(x)

        def walk(node: Node, overlap: int) -> None:
            group = self.find(k)
            if self.same_group(node, group):
                return
            if node.most * 100 < nx * percent or nx * 100 < node.least * percent:
                return
            # overlap * (100 + percent) >= percent * (sum of sizes), the smallest below.
            asked = percent * (nx + max(node.least, -(-nx * percent // 100)))
            lo = node.lo
            path = self.sets[node.of]
            while lo < node.hi:
                part = path[lo : min(lo + self.STRETCH, node.hi)]
                at = np.searchsorted(x, part)
                overlap += int((x[np.minimum(at, nx - 1)] == part).sum())
                lo += len(part)
                left = min(node.most - lo, nx - int(at[-1]))
                if (overlap + left) * (100 + percent) < asked:
                    return
            if node.member >= 0 and node.member != k:
                other = self.find(node.member)
                union = nx + len(self.sets[node.member]) - overlap
                if other != group and overlap * 100 >= percent * union:
                    self.parent[max(other, group)] = min(other, group)
                    found.append(node.member)
            stack.extend((c, overlap) for c in node.children)
            if node.children:
                passed.append(node)

        stack, passed = [(self.root, 0)], []
        while stack:
            walk(*stack.pop())
        for node in reversed(passed):
            self.settle(node)
        return found

    def join(self) -> list[tuple[int, int]]:
        """One link for each set that a group gains, over all pairs of sets."""
        return [(k, other) for k in range(len(self.sets)) for other in self.links_of(k)]


def tree_links(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that join different groups, below each ``(token, block)``.

    ``members`` has ``token, block, key, root, ids``; a key repeated below a
    token counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}

        def links() -> pa.RecordBatch | None:
            if len(held) < 2 or len({root for root, _ in held.values()}) < 2:
                return None
            keys = list(held)
            numbers: dict[bytes, int] = {}
            groups = [numbers.setdefault(held[k][0], len(numbers)) for k in keys]
            tree = PrefixTree([np.frombuffer(held[k][1], np.uint64) for k in keys], percent, groups)
            found = tree.join()
            return pa.record_batch(
                [binaries([keys[a] for a, _ in found]), binaries([keys[b] for _, b in found])], ["a", "b"]
            )

        for batch in batches:
            for token, block, key, root, ids in zip(*batch.columns, strict=True):
                place = (token.as_py(), block.as_py())
                if place != here:
                    if (out := links()) is not None:
                        yield out
                    here, held = place, {}
                held[key.as_py()] = (root.as_py(), ids.as_py())
        if (out := links()) is not None:
            yield out

    dealt = members.select("token", "block", "key", "root", "ids").repartition("token", "block")
    return map_batches(dealt.sortWithinPartitions("token", "block", "key"), run, "a binary, b binary")


def with_partner(n: np.ndarray, rest: np.ndarray, roots: list[bytes], percent: int) -> np.ndarray:
    """Which sets could be similar to one of another group, if the id at hand is
    the first that they share: both must have enough ids from there on.

    A set asks for partners of ``most`` ids at most, and its partner asks the
    same of it, so in order of size the largest ``most`` so far decides.
    """
    most = rest * (100 + percent) // percent - n
    order = np.argsort(n, kind="stable")
    size = n[order]
    # Of the sets up to each size the largest bound, its group, and the largest of another group.
    first, group, second = [], [], []
    a, g, b = -1, None, -1
    for k in order:
        if roots[k] == g:
            a = max(a, most[k])
        elif most[k] > a:
            a, g, b = most[k], roots[k], a
        else:
            b = max(b, most[k])
        first.append(a)
        group.append(g)
        second.append(b)
    upto = np.searchsorted(size, most, "right") - 1
    out = np.zeros(len(n), bool)
    for k in np.flatnonzero(upto >= 0):
        j = upto[k]
        out[k] = (second[j] if group[j] == roots[k] else first[j]) >= n[k]
    return out


def possible(members: DataFrame, percent: int) -> DataFrame:
    """The rows of ``members`` (``token, place, key, n, root``) with a possible partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def kept() -> pa.RecordBatch:
            place, key, n, root = zip(*held, strict=True)
            sizes = np.array(n)
            use = np.flatnonzero(with_partner(sizes, sizes - np.array(place), list(root), percent))
            return pa.record_batch(
                [
                    pa.array([here] * len(use), pa.int64()),
                    binaries([key[k] for k in use]), binaries([root[k] for k in use]),
                ],
                ["token", "key", "root"],
            )

        for batch in batches:
            for token, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if token != here and held:
                    yield kept()
                    held = []
                here = token
                held.append(row)
        if held:
            yield kept()

    dealt = members.select("token", "place", "key", "n", "root").repartition("token")
    return map_batches(
        dealt.sortWithinPartitions("token", "key"), run, "token long, key binary, root binary"
    )


def in_blocks(members: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """A row for each block of ``members`` (``token, key``) that it has to meet in.

    Tokens with up to ``most`` sets are one block. Larger ones are dealt out in
    parts of ``most`` / 2, and every two parts make a block.
    """
    parts = F.ceil(F.col("sets") / (most // 2)).cast("int")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    pair = lambda i: F.least(own, i) * parts + F.greatest(own, i)
    # A part that meets another holds its own pairs too; alone it is a block only if it is the only one.
    blocks = F.when(F.col("sets") <= most, F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), parts - 1), lambda i: i != own), lambda i: pair(i))
    )
    return members.join(sizes, "token").withColumn("block", F.explode(blocks)).drop("sets")


def similar_groups(
    docs: DataFrame, work: Workspace, words: int = WORDS, percent: int = PERCENT, most: int = MOST_SETS
) -> DataFrame:
    """``doc_id, text_key, n, key, root`` of every document.

    ``n`` is the size of its set, ``key`` the set's digest, ``root`` the digest
    that all documents have that are reachable by links; null for the empty set.
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(global_order(docs, words))
    every, first = scan(docs, words, percent, order, work)
    # Ids that only one set has in its prefix lead to no pair.
    of_token = first.groupBy("token").agg(
        F.count("*").alias("sets"), F.min("key").alias("a"), F.max("key").alias("b")
    )
    shared = work.keep(of_token.where("a <> b").select("token", "sets"), "shared-tokens")
    marks = spark.sparkContext.broadcast(bitmap(shared.select(F.col("token").alias("h"))))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.asarray(batch.column(0)).view(np.uint64)
            if len(tokens):
                yield batch.filter(pa.array(marked(marks.value, tokens)))

    sifted = map_batches(first, sift, "token long, place long, key binary, n long")
    # Copies of a set come from several tasks.
    pairs = work.keep(sifted.join(shared, "token").distinct(), "shared-prefixes")
    number = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    key_marks = spark.sparkContext.broadcast(bitmap(pairs.select("key").distinct().select(number.alias("h"))))
    sets = wanted_sets(docs, words, order, key_marks)
    known = pairs.select("key").distinct()
    sets = work.keep(sets.join(known, "key", "left_semi").dropDuplicates(["key"]), "sets")
    # All that reads these is written now.
    for used in (order, marks, key_marks):
        used.destroy()

    # First round: every set where most others are, large groups dealt out.
    home = pairs.groupBy("key").agg(
        F.max(F.struct("sets", "token")).alias("home")
    ).select("key", "home.token", F.greatest(F.lit(1), F.ceil(F.col("home.sets") / most)).alias("deal"))
    at_home = home.select(
        "token", "key", F.col("key").alias("root"), F.pmod(F.xxhash64("key"), "deal").cast("int").alias("block")
    )
    links = work.keep(tree_links(at_home.join(sets, "key"), percent), "first-links")
    roots = components(links, work)

    # Second round: every shared id that has sets of two groups, which may be similar.
    grouped = pairs.select("token", "place", "key", "n").join(
        roots.select(F.col("node").alias("key"), "root"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    grouped = work.keep(grouped, "grouped")
    spread = grouped.groupBy("token").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("sets")
    ).where("a <> b")
    mixed = grouped.join(spread.select("token", "sets"), "token")
    # An id with more sets than a task may hold goes on unsifted, in blocks.
    left = work.keep(
        possible(mixed.where(F.col("sets") <= most), percent).unionAll(
            mixed.where(F.col("sets") > most).select("token", "key", "root")
        ),
        "possible",
    )
    between = left.groupBy("token").agg(
        F.count("*").alias("sets"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    )
    # Ids with the very same sets lead to the same pairs: one of them is enough.
    once = between.groupBy("sets", "x", "y").agg(F.min("token").alias("token")).select("token", "sets")
    members = in_blocks(left, work.keep(once, "second-tokens"), most)
    more = work.keep(tree_links(members.join(sets, "key"), percent), "second-links")
    roots = components(links.unionAll(more), work)
    return (
        every.join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("doc_id", "text_key", "n", "key",
                F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root"))
    )


def jaccard_components(docs: DataFrame, work: Workspace, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable by links."""
    found = work.keep(similar_groups(docs, work, **options), "documents")
    smallest = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, work: Workspace, **options) -> DataFrame:
    """The rows of ``docs`` but all documents of each group save the one with the
    smallest id (then the smallest text digest); documents with an empty set stay.

    Of several rows of that document (same id and text) one stays, the one whose
    row has the smallest digest; equal rows are one. Columns may have any names.
    """
    found = work.keep(similar_groups(docs, work, **options), "documents")
    chosen = found.where("n > 0").groupBy("root").agg(
        F.min(F.struct("doc_id", "text_key")).alias("best")
    ).select(F.col("best.doc_id").alias("best_doc"), F.col("best.text_key").alias("best_key"))
    # The rows travel as one column, so that no name of theirs clashes.
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc"), F.md5(text.cast("binary")).alias("key"),
        F.coalesce(text.rlike(FILLED), F.lit(False)).alias("filled"),
    )
    same = F.col("doc").eqNullSafe(F.col("best_doc")) & (F.col("key") == F.col("best_key"))
    out = rows.where("filled").join(chosen, same, "left_semi")
    repeated = found.where("n > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if not repeated.isEmpty():
        digest = F.md5(F.to_json("row").cast("binary"))
        out = out.groupBy("doc", "key").agg(F.min_by("row", digest).alias("row"))
    out = out.select("row.*")
    # Null and empty texts, however many, need no join.
    if not found.where("n = 0").isEmpty():
        out = out.unionAll(rows.where(~F.col("filled")).select("row.*"))
    return out
