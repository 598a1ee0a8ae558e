"""Token ids as files: frequency-ranked ids in byte-aligned variable-length code.

Ids are counted over all documents and ranked, the most frequent first; the
files hold ranks. A block codes many documents' ranks: two bits of a control
byte say how many bytes (1 to 4) a rank has, the ranks' bytes follow in a
stream of their own, so that numpy decodes a block by table lookup without a
loop. Blocks are rows of Parquet files, in ascending ``doc_id`` (null first);
the rank table lies beside them.

Tokenizing goes through the tokenizers library, each distinct piece of a batch
once. A piece is cut only at a single space between two characters that are not
white space; the tokenizer's own rule always ends a token there, so the ids are
those of the whole text.

Defined results: a null or empty text has only the end id; rows with one
``doc_id`` follow each other in the order of their ids; an empty table makes no
block.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histmerge.llm.batches import Texts, binaries, map_batches, slices, with_columns
from histmerge.workspace import Workspace

END = 0
#: Ids of a block, and pieces of text that a Python worker remembers for its next
#: batch unless told otherwise, about 150 bytes each. Results do not depend on it.
BLOCK_IDS, MOST_PIECES = 1 << 18, 400_000
#: Bytes of text cut at once (one text at least), and pieces that the library
#: takes at once; its results are larger than the ids.
SLICE_BYTES, AT_ONCE = 1 << 18, 4096
#: Marks that a token of letters never holds; an apostrophe is not among them.
MARKS = ".,;:!?#*$%&|"
PIECES = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")

#: Bytes of each of a control byte's four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> bytes:
    """Number of values (8 bytes), control bytes, then the values' own bytes."""
    values = values.astype("<u4")
    raw = values.view(np.uint8).reshape(-1, 4)
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = raw[np.arange(4) < size[:, None]]
    return np.array([len(values)], "<u8").tobytes() + control.tobytes() + data.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    controls = -(-n // 4)
    size = LENGTHS[np.frombuffer(blob, np.uint8, controls, 8)].reshape(-1)[:n].astype(np.int64)
    data = np.frombuffer(blob + b"\0\0\0", np.uint8, offset=8 + controls)
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Bytes of a part that the table of known parts holds as three numbers; longer
#: ones are kept as text.
SHORT = 24
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Known:
    """Short byte strings and a number for each, found many at a time.

    The bytes themselves are the key, as three numbers and a length, in an open
    table: equal entries are equal strings, whatever their hashes.
    """

    def __init__(self):
        self.held = 0
        self.words, self.sizes = np.empty((3, 0), np.uint64), np.empty(0, np.uint8)
        self.values, self.slots = np.empty(0, np.int64), np.full(1 << 12, -1, np.int32)

    @staticmethod
    def read(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The first ``SHORT`` bytes of each span as three numbers."""
        padded = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])
        eight = np.ndarray(len(data) + SHORT + 1, "<u8", padded, strides=(1,))
        return [
            eight[starts + 8 * k] & _MASKS[np.minimum(np.maximum(size - 8 * k, 0), 8)] for k in range(3)
        ]

    @staticmethod
    def _hash(words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64)
        for word, factor in zip(words, _FACTORS, strict=True):
            h = (h ^ word) * factor
            h ^= h >> np.uint64(32)
        return h

    def find(self, words: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """The number of each string, or -1."""
        out = np.full(len(size), -1, np.int64)
        if not self.held:
            return out
        at = (self._hash(words, size) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        rest = None
        while True:
            entry = self.slots[at]
            same = (entry >= 0) & (self.sizes[entry] == size)
            for held, word in zip(self.words, words, strict=True):
                same &= held[entry] == word
            hit = np.flatnonzero(same)
            out[hit if rest is None else rest[hit]] = self.values[entry[hit]]
            more = np.flatnonzero((entry >= 0) & ~same)
            if not len(more):
                return out
            rest = more if rest is None else rest[more]
            at = (at[more] + 1) & (len(self.slots) - 1)
            words, size = [w[more] for w in words], size[more]

    def add(self, words: list[np.ndarray], size: np.ndarray, values: np.ndarray) -> None:
        """Add strings that are not held yet, each once."""
        first = self.held
        self.held += len(size)
        if self.held > len(self.sizes):
            grown = max(self.held, 2 * len(self.sizes))
            self.words = np.concatenate([self.words, np.zeros((3, grown - len(self.sizes)), np.uint64)], 1)
            self.values = np.concatenate([self.values, np.zeros(grown - len(self.sizes), np.int64)])
            self.sizes = np.concatenate([self.sizes, np.zeros(grown - len(self.sizes), np.uint8)])
        self.words[:, first : self.held] = words
        self.sizes[first : self.held], self.values[first : self.held] = size, values
        if 2 * self.held > len(self.slots):
            self.slots = np.full(1 << int(4 * self.held).bit_length(), -1, np.int32)
            first = 0
        self._place(first)

    def _place(self, first: int) -> None:
        entry = np.arange(first, self.held, dtype=np.int32)
        words, size = [w[first : self.held] for w in self.words], self.sizes[first : self.held]
        at = (self._hash(words, size) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(entry):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = entry[free]  # of several that want a slot, one gets it
            left = np.flatnonzero(self.slots[at] != entry)
            entry, at = entry[left], (at[left] + 1) & (len(self.slots) - 1)

    def below(self, most: int) -> Known:
        """The strings whose number is smaller."""
        out, keep = Known(), np.flatnonzero(self.values[: self.held] < most)
        out.add([w[keep] for w in self.words], self.sizes[keep], self.values[keep])
        return out


class Encoder:
    """Ids of whole texts, each distinct piece tokenized once.

    A text is cut at every space. If a part is empty or has white space at an
    end, the text is cut by ``PIECES`` instead; such parts are never remembered.
    Parts are compared as bytes of the batch; only those that are new become
    Python strings.
    """

    def __init__(self, path: str, most: int = MOST_PIECES):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        # Pieces as they are, and parts that stand for a piece with a space before it.
        self.plain: dict[str, int] = {}
        self.spaced, self.long = Known(), {}
        # The pieces' ids one after the other, where each begins, and how many there are.
        self.ids, self.starts, self.count = np.zeros(1 << 12, self.kind), np.zeros(1 << 10, np.int64), 0

    def _forget(self) -> None:
        """Keep the pieces met first; those are the frequent ones."""
        n = self.count = self.most // 2
        self.plain = {p: k for p, k in self.plain.items() if k < n}
        self.long = {p: k for p, k in self.long.items() if k < n}
        self.spaced = self.spaced.below(n)
        self.starts = self.starts[: n + 1].copy()
        self.ids = self.ids[: self.starts[-1]].copy()

    def _find(self, parts: list[str]) -> np.ndarray:
        """The number of each part that stands for a piece with a space before it, or -1."""
        raw = [p.encode() for p in parts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = self.spaced.find(Known.read(data, np.cumsum(size) - size, size), size)
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k] = self.long.get(parts[k], -1)
        return out

    def _remember(self, parts: list[str], first: int) -> None:
        """Parts that are new, with numbers from ``first`` on."""
        raw = [p.encode() for p in parts]
        size = np.array([len(r) for r in raw], np.int64)
        data, short = np.frombuffer(b"".join(raw), np.uint8), np.flatnonzero(size <= SHORT)
        words = Known.read(data, np.cumsum(size) - size, size)
        self.spaced.add([w[short] for w in words], size[short], first + short)
        self.long.update((parts[k], first + k) for k in np.flatnonzero(size > SHORT).tolist())

    def _learn(self, plain: set[str], spaced: set[str]) -> None:
        """Tokenize what is new. A part that ends in marks after a letter is put
        together from the part before them and the marks, as the rule ends a
        token between the two. ``spaced`` has parts that are not known."""
        tails: list[tuple[str, str, str]] = []
        more: set[str] = set()
        for part in spaced:
            stem = part.rstrip(MARKS)
            if stem and stem is not part and stem[-1].isascii() and stem[-1].isalpha():
                tails.append((part, stem, part[len(stem) :]))
            else:
                more.add(part)
        stems = list({t[1] for t in tails} - more)
        more.update(stems[k] for k in np.flatnonzero(self._find(stems) < 0).tolist())
        new = list(plain.union(t[2] for t in tails).difference(self.plain))
        parts = list(more)
        if new or parts:
            ids, counts = self._separately(new + [" " + x for x in parts])
            first = self._add(ids, counts)
            self.plain.update(zip(new, range(first, first + len(new)), strict=True))
            self._remember(parts, first + len(new))
        if tails:
            stem_at, mark_at = self._find([t[1] for t in tails]), [self.plain[t[2]] for t in tails]
            at = np.array([stem_at, mark_at], np.int64).T.reshape(-1)
            size = self.starts[at + 1] - self.starts[at]
            before = np.cumsum(size) - size
            ids = self.ids[np.repeat(self.starts[at] - before, size) + np.arange(size.sum())]
            self._remember([t[0] for t in tails], self._add(ids, size.reshape(-1, 2).sum(1)))

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """The number of the first of the pieces that are added."""
        first, used = self.count, self.starts[self.count]
        self.count += len(counts)
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(used + len(ids), 2 * len(self.ids)))
        if self.count >= len(self.starts):
            self.starts = np.resize(self.starts, max(self.count + 1, 2 * len(self.starts)))
        self.ids[used : used + len(ids)] = ids
        self.starts[first + 1 : self.count + 1] = used + np.cumsum(counts)
        return first

    def _separately(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece by itself, and how many it has."""
        found = []
        for lo in range(0, len(pieces), AT_ONCE):
            some = self.library.encode_batch_fast(pieces[lo : lo + AT_ONCE], add_special_tokens=False)
            found.extend(e.ids for e in some)
        return np.fromiter(chain.from_iterable(found), self.kind), np.array([*map(len, found)], np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and how many each has; without the end id."""
        data, bounds = texts.data, texts.offsets
        spaces = np.flatnonzero(data == 0x20)
        starts = np.sort(np.concatenate([bounds[:-1], spaces + 1]), kind="stable")
        ends = np.sort(np.concatenate([spaces, bounds[1:]]), kind="stable")
        count = np.diff(np.searchsorted(spaces, bounds)) + 1
        row = np.repeat(np.arange(len(texts)), count)
        if self.count > self.most:
            self._forget()
        size = ends - starts
        words = Known.read(data, starts, size)
        at = self.spaced.find(words, size)
        string = lambda k: data[starts[k] : ends[k]].tobytes().decode()
        longer = np.flatnonzero(size > SHORT).tolist()
        at[longer] = [self.long.get(string(k), -1) for k in longer]
        missing = np.flatnonzero(at < 0)
        asked = [string(k) for k in missing.tolist()]
        new = set(asked)
        odd = {p for p in new if p != p.strip() or not p or "\u180e" in p}
        self._learn(set(), new - odd)
        at[missing] = self.spaced.find([w[missing] for w in words], size[missing])
        for k in np.flatnonzero(size[missing] > SHORT).tolist():
            at[missing[k]] = self.long.get(asked[k], -1)
        wrong = np.unique(row[at < 0]).tolist()
        whole = {k: texts.text(k).decode() for k in wrong}
        by_rule = {k: PIECES.split(t) if t else [] for k, t in whole.items()}
        where = np.cumsum(count) - count
        firsts = {k: string(where[k]) for k in range(len(texts)) if k not in by_rule}
        plain = set(firsts.values()).union(*by_rule.values())
        self._learn(plain, set())
        for k, p in firsts.items():
            at[where[k]] = self.plain[p]
        if by_rule:
            keep = ~np.isin(row, wrong)
            rows = [row[keep], *(np.full(len(p), k) for k, p in by_rule.items())]
            ats = [at[keep], *(np.array([self.plain[x] for x in p], np.int64) for p in by_rule.values())]
            row, at = np.concatenate(rows), np.concatenate(ats)
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
        size = self.starts[at + 1] - self.starts[at]
        before = np.cumsum(size) - size
        flat = self.ids[np.repeat(self.starts[at] - before, size) + np.arange(size.sum())]
        return flat, np.bincount(row, size, len(texts)).astype(np.int64)


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, most: int) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def token_ids(docs: DataFrame, path: str, most: int = MOST_PIECES) -> DataFrame:
    """``doc_id, wide, ids``: ids with the end id as compressed unsigned numbers,
    of 4 bytes if ``wide``, else 2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = _encoder(path, most), zstandard.ZstdCompressor(level=1)
        end, wide = np.array([END], encoder.kind), encoder.kind.itemsize == 4
        for batch in batches:
            for part, texts in slices(batch, limit=SLICE_BYTES):
                flat, counts = encoder.encode(texts)
                cuts = np.cumsum(counts)
                blobs = [
                    squeeze.compress(np.concatenate([x, end]).tobytes())
                    for x in np.split(flat, cuts[:-1])
                ]
                yield pa.record_batch(
                    [part.column(0), pa.array([wide] * len(blobs)), binaries(blobs)],
                    ["doc_id", "wide", "ids"],
                )

    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    return map_batches(plain, work, "doc_id long, wide boolean, ids binary")


def expand(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each row of ``token_ids``."""
    open_up = zstandard.ZstdDecompressor()
    wide, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("wide", "ids"))
    return [
        np.frombuffer(open_up.decompress(blob.as_py()), "<u4" if w.as_py() else "<u2")
        for w, blob in zip(wide, ids, strict=True)
    ]


def ranked(coded: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first; as many as the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.bincount(np.concatenate(expand(batch)))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = map_batches(coded.select("wide", "ids"), count, "id long, n long")
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


@dataclass
class TokenFiles:
    """A folder of blocks and the rank table beside them."""

    spark: SparkSession
    folder: str

    def write(
        self, docs: DataFrame, path: str, work: Workspace, most: int = MOST_PIECES
    ) -> TokenFiles:
        """Tokenize ``docs``, rank the ids and write the blocks in ``doc_id`` order."""
        coded = work.keep(token_ids(docs, path, most), "token-ids")
        order = ranked(coded)
        rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        shared = self.spark.sparkContext.broadcast(rank)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, before = TaskContext.get().partitionId(), 0
            held: list[tuple[int | None, np.ndarray]] = []

            def block() -> pa.RecordBatch:
                values = np.concatenate([v for _, v in held])
                return pa.record_batch(
                    [
                        pa.array([part], pa.int32()), pa.array([before], pa.int64()),
                        pa.array([len(values)], pa.int64()),
                        pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                        pa.array([[len(v) for _, v in held]], pa.list_(pa.int64())),
                        binaries([pack(shared.value[values])]),
                    ],
                    ["part", "ids_before", "n_ids", "doc_ids", "n_tokens", "ranks"],
                )

            size = 0
            for batch in batches:
                for doc, ids in zip(batch.column(0), expand(batch), strict=True):
                    held.append((doc.as_py(), ids))
                    size += len(held[-1][1])
                    if size >= BLOCK_IDS:
                        yield block()
                        before, size, held = before + size, 0, []
            if held:
                yield block()

        dealt = coded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        blocks = map_batches(
            dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids"), encode,
            "part int, ids_before long, n_ids long, doc_ids array<long>, n_tokens array<long>, ranks binary",
        )
        blocks.write.parquet(f"{self.folder}/blocks")
        table = [(k, int(i)) for k, i in enumerate(order)]
        self.spark.createDataFrame(table, "rank int, id int").coalesce(1).write.parquet(f"{self.folder}/ranks")
        return self

    def read(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids`` of every document, from the files."""
        blocks = self.spark.read.parquet(f"{self.folder}/blocks")
        rows = self.spark.read.parquet(f"{self.folder}/ranks").orderBy("rank").collect()
        ids = self.spark.sparkContext.broadcast(np.array([r["id"] for r in rows], np.uint32))
        # One number for each written partition.
        sizes = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
        starts, total = {}, 0
        for r in sizes:
            starts[r["part"]] = total
            total += r["n"]
        first = self.spark.sparkContext.broadcast(starts)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    part, before, docs, counts, blob = (c[r].as_py() for c in batch.columns)
                    values = ids.value[unpack(blob)].astype("<u4")
                    counts = np.array(counts, np.int64)
                    ends = np.cumsum(counts)
                    start = first.value[part] + before + ends - counts
                    blobs = [x.tobytes() for x in np.split(values, ends[:-1])]
                    yield pa.record_batch(
                        [pa.array(docs, pa.int64()), pa.array(start), pa.array(counts), binaries(blobs)],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

        return map_batches(
            blocks.select("part", "ids_before", "doc_ids", "n_tokens", "ranks"), decode,
            "doc_id long, start long, n_tokens long, ids binary",
        )


def write_and_read(
    docs: DataFrame, path: str, work: Workspace, most: int = MOST_PIECES
) -> DataFrame:
    files = TokenFiles(docs.sparkSession, work.keep_path("tokens"))
    return files.write(docs, path, work, most).read()
