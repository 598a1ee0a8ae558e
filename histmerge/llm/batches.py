"""Arrow batches as byte arrays: words, n-gram hashes and rows as numpy columns.

The operators of this package that run in Python tasks read a text column
without making a Python object for each word: a batch's UTF-8 bytes are one
array, words are pairs of positions in it, and a word's hash is a difference of
two prefix sums. Texts are always whole; only the number of rows worked on at
once is bounded (``SLICE_BYTES``, one row at least).
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once in a task.
SLICE_BYTES = 1 << 19
#: Rows that Spark sends to a Python task at once, unless the session says otherwise.
BATCH_ROWS = 512

#: The separators of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_random = np.random.Generator(np.random.PCG64(20260101))
#: One random 64-bit value for each byte; A-Z as a-z in ``FOLDED``.
VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of ``BASE`` and of its inverse, as many as the longest slice needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            grow = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            for x in grow:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in grow)
        return self.up, self.down

    def forget(self) -> None:
        """Drop what a text longer than a slice asked for."""
        if len(self.up) > SLICE_BYTES + 1:
            self.up = self.down = np.ones(1, np.uint64)


_powers = _Powers()


@dataclass
class Texts:
    """Some rows' texts: their bytes, one after the other, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the longest runs of bytes that ``inside`` marks."""
        n = len(self.data)
        if not n:
            return (np.empty(0, np.int64),) * 3
        mark = inside[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        first, last = mark.copy(), mark.copy()
        first[1:] &= ~mark[:-1] | cut[1:-1]
        last[:-1] &= ~mark[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, self.rows(starts)

    def rows(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def prefix_hash(self, values: np.ndarray = VALUES) -> np.ndarray:
        up, _ = _powers.of(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def hashes(
        self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES
    ) -> np.ndarray:
        """64-bit hashes of the bytes of each span, equal for equal bytes anywhere."""
        sums = self.prefix_hash(values)
        _, down = _powers.of(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(ids: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of every ``size`` neighbouring words of one row."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * _STEP + ids[k : k + n])
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return out[at], at


def distinct_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ordered by row, then value."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """A batch in parts of about ``limit`` bytes of text; null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        texts, kind = texts.fill_null(""), np.int64
    else:
        texts, kind = texts.cast(pa.string()).fill_null(""), np.int32
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    bounds = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield (
            batch.slice(lo, hi - lo),
            Texts(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]),
        )
        lo = hi


def map_slices(
    df: DataFrame,
    work: Callable[[pa.RecordBatch, Texts], pa.RecordBatch],
    schema: str | T.StructType,
    column: str = "text",
) -> DataFrame:
    """``work`` on every part of every batch, in Spark's partitions of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, column):
                yield work(part, texts)

    return map_batches(df, run, schema)


def give_back() -> None:
    """Return a Python worker's unused memory; Spark keeps workers for later tasks."""
    _powers.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Have Spark hand this package to its Python tasks, once per application,
    unless they find it by their own path (``PYTHONPATH`` or installed)."""
    root = Path(__file__).resolve().parents[2]
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    known = any(p and Path(p).resolve() == root for p in paths)
    app = spark.sparkContext.applicationId
    if known or "site-packages" in root.parts or app in _shipped:
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "histmerge_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "histmerge").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def map_batches(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``mapInArrow`` with a bound on the rows of a batch; a task ends with ``give_back``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each row from the rows' values in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` cut to ``columns`` (name to type), each cast, a missing one null.

    Names are matched exactly first, then without case, so that a table with
    further columns of clashing names can be read as well.
    """
    folded = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, kind in columns.items():
        found = name if name in df.columns else folded.get(name.lower())
        source = F.lit(None) if found is None else F.col(f"`{found}`")
        out.append(source.cast(kind).alias(name))
    return df.select(*out)
