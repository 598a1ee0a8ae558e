"""Bitmaps of fixed size: what is broadcast to sift rows before an exact join.

A bitmap marks some 64-bit keys. A key that is not marked is surely not among
them; a marked one may be, and a join or comparison decides. The size doesn't
depend on the number of keys: with too many of them the bitmap sifts less, and
results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import map_batches

#: Bits of a bitmap: 2**26 bits are 8 MB.
MARK_BITS = 26


def bitmap(keys: DataFrame, bits: int = MARK_BITS, parts: int = 32) -> np.ndarray:
    """2**bits marks, packed: those whose number is ``h`` modulo 2**bits.

    ``keys`` has a column ``h``. Tasks make parts of fixed size and compress them,
    so what the driver gets and hands on has a bound whatever the number of keys.
    """
    span = (1 << bits) // parts

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column(0)) & ((1 << bits) - 1)
            for p in np.unique(at // span):
                held = marks.setdefault(int(p), np.zeros(span, bool))
                held[at[at // span == p] % span] = True
        if marks:
            yield pa.record_batch(
                [pa.array(list(marks), pa.int32()),
                 pa.array([zlib.compress(np.packbits(m).tobytes(), 1) for m in marks.values()], pa.binary())],
                ["part", "marks"],
            )

    dealt = keys.select("h").repartition(parts, F.shiftright(F.col("h").bitwiseAND((1 << bits) - 1), span.bit_length() - 1))
    out = np.zeros((parts, span // 8), np.uint8)
    for r in map_batches(dealt, mark, "part int, marks binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    return out.reshape(-1)


def marked(marks: np.ndarray, h: np.ndarray, bits: int = MARK_BITS) -> np.ndarray:
    at = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
