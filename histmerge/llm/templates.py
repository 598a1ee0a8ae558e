"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, names (a capital letter away from a sentence's
start) and units (a unit's name after a number) are replaced by typed
placeholders, everything else is taken without case. Windows of eight template
words of the benchmark are hash-joined to the documents' windows, and windows of
the words as they are (without case) beside them, so that a copy is found
whatever its words are taken for.

What matches is laid out by its shift (place in the document less place in the
item), in overlapping bands of ``BAND`` words, so that pieces of an item count
together only where they stand in its order, a few words more or less apart. In
a band each value of the item must stand for one value of the document: the one
in more than half of the places where the item's value was looked at. A template
window with another value is dropped; a window of the words as they are is not,
as it agrees by itself. This catches a question asked again with other numbers or
names, and leaves alone another question in like words.

A document is contaminated by an item if in one band at least half of the item's
windows are found, or half of those that have a template, or if what is found
covers half of the item's words and ``LEAST_COVERED`` words or more.

Only documents' windows whose hash is marked in a bitmap of fixed size leave the
task that reads the document; false marks fall out in the join. A group of hits
belongs to one text, one item and one band: its size is bounded by the item's.

Defined results: a null or empty text is clean; an item with fewer words than a
window is one window; a window with fewer than four plain words has no template,
as it would match by chance; an item of fewer than four words is found where it
stands as a sentence or line of its own, and one without words nowhere; rows with
equal texts are judged alike; items with one ``item_id`` are one item's texts,
each judged for itself; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histmerge.llm.batches import FOLDED, Texts, map_batches, map_slices, mix, ragged, windows, with_columns
from histmerge.llm.marks import bitmap, marked
from histmerge.workspace import Workspace

WINDOW, LEAST_PLAIN, LEAST_PART = 8, 4, 0.5
#: Shifts that count together, and the fewest words of an item that are enough by cover.
BAND, LEAST_COVERED = 16, 13
#: Parts that the copies of one text are joined in.
SALTS = 16

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
#: Bytes that end a sentence.
STOP = np.zeros(256, bool)
STOP[list(b".!?:\n")] = True
QUIET = np.zeros(256, bool)
QUIET[list(b" \t\r\"'()[]")] = True
#: Names of units.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l cl dl ms s sec min h hr hrs hz khz mhz ghz w kw"
    " mw v a k c f pa bar j kj cal kcal b kb mb gb tb usd eur gbp percent meter meters metre metres"
    " kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams"
    " kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute"
    " minutes hour hours day days week weeks month months year years degree degrees dollar dollars"
    " euro euros cent cents"
).split()
NUMBER, NAME, UNIT, VERBATIM = (np.uint64(x) for x in (0x11D, 0x22D, 0x33D, 0x44D))


def unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    starts = ends - [len(u) for u in UNITS]
    return np.sort(Texts(data, np.array([0, len(data)])).hashes(starts, ends, FOLDED))


UNIT_HASHES = unit_hashes()


@dataclass
class Template:
    """The words of some texts: row, place in the row, template hash, value hash,
    kind (0 for a plain word), and whether the word begins a sentence."""

    rows: np.ndarray
    place: np.ndarray
    shown: np.ndarray
    values: np.ndarray
    kinds: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Template:
        starts, ends, rows = texts.spans(WORD)
        if not len(starts):
            empty = np.empty(0, np.uint64)
            return cls(rows, rows, empty, empty, np.empty(0, np.int8), np.empty(0, bool))
        values = texts.hashes(starts, ends, FOLDED)
        data = texts.data
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        number = DIGIT[data[starts]] & (digits[ends] - digits[starts] > 0)
        # The last byte before a word that is neither a word's nor quiet, and the last word byte.
        kind_of = np.where(WORD[data], 1, np.where(STOP[data], 2, np.where(QUIET[data], 0, 3)))
        told = np.where(kind_of > 0, np.arange(len(data)), -1)
        np.maximum.accumulate(told, out=told)
        before = np.where(starts > 0, told[np.maximum(starts - 1, 0)], -1)
        begins = (before < texts.offsets[rows]) | (kind_of[np.maximum(before, 0)] == 2)
        # Latin capitals beyond ASCII are C3 80 to C3 9E in UTF-8.
        second = data[np.minimum(starts + 1, len(data) - 1)]
        capital = CAPITAL[data[starts]] | ((data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        name = capital & ~begins & ~number
        at = np.minimum(np.searchsorted(UNIT_HASHES, values), len(UNIT_HASHES) - 1)
        after_number = np.zeros(len(rows), bool)
        after_number[1:] = number[:-1] & (rows[1:] == rows[:-1])
        unit = (UNIT_HASHES[at] == values) & after_number & ~number
        kinds = np.select([number, unit, name], [1, 3, 2], 0).astype(np.int8)
        shown = np.select([kinds == 1, kinds == 2, kinds == 3], [NUMBER, NAME, UNIT], values)
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return cls(rows, place, shown, values, kinds, begins)

    def windows(self, sizes: list[int]) -> tuple[np.ndarray, ...]:
        """First word, size and hash of each window as it is, and of its template if
        it has enough plain words; last, whether it is a template's."""
        plain = np.concatenate([[0], np.cumsum(self.kinds == 0)])
        bounds = np.concatenate([self.begins, [True]])
        bounds[1:-1] |= self.rows[1:] != self.rows[:-1]
        parts = []
        for size in sizes:
            keys, at = windows(self.values, self.rows, size)
            if size < LEAST_PLAIN:
                alone = bounds[at] & bounds[at + size]
                keys, at = keys[alone], at[alone]
            parts.append((at, np.full(len(at), size), mix(keys ^ VERBATIM), np.zeros(len(at), bool)))
            if size < LEAST_PLAIN:
                continue
            keys, at = windows(self.shown, self.rows, size)
            enough = plain[at + size] - plain[at] >= LEAST_PLAIN
            keys, at = keys[enough], at[enough]
            parts.append((at, np.full(len(at), size), keys, np.ones(len(at), bool)))
        if not parts:
            none = np.empty(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(bool)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def slots(self, at: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Places in the window and values of the placeholders of each template
        window; none of the others."""
        turn = np.arange(n.max(initial=0))
        word = np.minimum(at[:, None] + turn, max(len(self.kinds) - 1, 0))
        if not word.size:
            none = np.zeros(len(at), np.int64)
            return ragged(none[:0], none, pa.int32()), ragged(none[:0], none, pa.int64())
        slot = (turn < n[:, None]) & kind[:, None] & (self.kinds[word] > 0)
        counts = slot.sum(1)
        return (
            ragged(np.broadcast_to(turn, slot.shape)[slot].astype(np.int32), counts, pa.int32()),
            ragged(self.values[word][slot].view(np.int64), counts, pa.int64()),
        )


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows of each item, of its own length if shorter, as they are and, where
    they have one, as a template.

    ``item`` is the item's id with its text's hash, ``words`` the item's length,
    ``at, n`` a window's place and size, ``h`` its hash, ``slots, values`` the
    places and values of its placeholders.
    """

    def work(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        found = Template.of(texts)
        words = np.bincount(found.rows, minlength=len(texts))
        own_size = np.minimum(words, size)
        at, n, h, kind = found.windows(sorted({int(n) for n in own_size if n}))
        own = n == own_size[found.rows[at]]
        at, n, h, kind = at[own], n[own], h[own], kind[own]
        row = found.rows[at]
        item = part.column(part.schema.get_field_index("item"))
        return pa.record_batch(
            [item.take(pa.array(row)), pa.array(words[row]), pa.array(found.place[at]), pa.array(n),
             pa.array(h.view(np.int64)), pa.array(kind), *found.slots(at, n, kind)],
            ["item", "words", "at", "n", "h", "template", "slots", "asked"],
        )

    plain = with_columns(benchmark, {"item_id": "long", "text": "string"}).where("item_id is not null")
    items = plain.select(F.struct("item_id", F.md5(F.col("text").cast("binary")).alias("t")).alias("item"), "text")
    return map_slices(
        items, work, "item struct<item_id: long, t: string>, words long, at long, n long, h long,"
        " template boolean, slots array<int>, asked array<long>",
    )


@dataclass
class Hit:
    """A window of an item found in a text: its place and size in the item, its place
    in the text, and the placeholders as (place in the window, asked, found)."""

    at: int
    n: int
    place: int
    slots: list[tuple[int, int, int]]


def consistent(hits: list[Hit]) -> list[Hit]:
    """The hits whose placeholders agree with the one value of the text that each of
    the item's values stands for in more than half of its places."""
    places: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for hit in hits:
        for slot, asked, found in hit.slots:
            places[asked][found].add(hit.place + slot)
    stands_for = {}
    for asked, found in places.items():
        total = sum(map(len, found.values()))
        stands_for |= {asked: v for v, at in found.items() if 2 * len(at) > total}
    return [x for x in hits if all(stands_for.get(asked) == found for _, asked, found in x.slots)]


def covered(hits: list[Hit]) -> int:
    """How many of the item's words are in a hit."""
    total = end = 0
    for at, n in sorted({(x.at, x.n) for x in hits}):
        total += max(0, at + n - max(end, at))
        end = max(end, at + n)
    return total


def enough(
    hits: list[Hit], words: int, windows: int, templates: set[int] | frozenset[int], n_templates: int,
    least: float = LEAST_PART,
) -> int:
    """The number of windows found if they are enough for the item, else 0.

    ``templates`` are the places of hits that have a template in the item."""
    kept = consistent(hits)
    found = {x.at for x in kept}
    cover = covered(kept)
    by_words = cover >= max(least * words, LEAST_COVERED)
    by_templates = n_templates > 0 and len(found & templates) >= least * n_templates
    return len(found) if len(found) >= least * windows or by_templates or by_words else 0


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, work: Workspace, least: float = LEAST_PART
) -> DataFrame:
    """``key, item_id, found``: each contaminated text (its MD5) with each of its
    items, and how many of the item's windows were found."""
    asked = work.keep(benchmark_windows(benchmark).distinct(), "benchmark-windows")
    sizes = sorted(r["n"] for r in asked.select("n").distinct().collect())
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(asked))

    def find(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        words = Template.of(texts)
        at, n, h, kind = words.windows(sizes)
        hit = marked(marks.value, h) if len(h) else np.empty(0, bool)
        at, n, h, kind = at[hit], n[hit], h[hit], kind[hit]
        keys = part.column(part.schema.get_field_index("key"))
        return pa.record_batch(
            [keys.take(pa.array(words.rows[at])), pa.array(h.view(np.int64)),
             pa.array(words.place[at]), words.slots(at, n, kind)[1]],
            ["key", "h", "place", "found"],
        )

    keyed = with_columns(docs, {"text": "string"}).select(text_key().alias("key"), "text")
    found = map_slices(
        keyed.where("text is not null"), find, "key string, h long, place long, found array<long>"
    )
    places = asked.groupBy("item", "at").agg(F.max("template").alias("plain"), F.max("words").alias("words"))
    totals = places.groupBy("item").agg(
        F.count("*").alias("windows"), F.count_if("plain").alias("templates"), F.max("words").alias("words")
    )
    listed = asked.join(places.select("item", "at", "plain"), ["item", "at"])
    # Copies of a text count once.
    hits = found.distinct().join(listed, "h")
    shift = F.col("place") - F.col("at")
    bands = F.array(
        F.floor(shift / BAND) * 2, F.floor((shift + BAND // 2) / BAND) * 2 + 1
    )  # any two shifts that are BAND / 2 apart or less share one
    hit = F.struct("at", "n", "place", "plain", "slots", "asked", "found").alias("hit")
    grouped = (
        hits.select("key", "item", F.explode(bands).alias("band"), hit)
        .groupBy("key", "item", "band")
        .agg(F.collect_list("hit").alias("hits"))
        .join(totals, "item")
    )
    n_found = F.size(F.array_distinct("hits.at"))
    most_words = n_found * F.element_at("hits.n", 1)
    possible = (most_words >= least * F.col("words")) | (
        (F.col("templates") > 0) & (n_found >= least * F.col("templates"))
    )

    def judge(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                hits = [
                    Hit(x["at"], x["n"], x["place"], list(zip(x["slots"], x["asked"], x["found"], strict=False)))
                    for x in r["hits"]
                ]
                plain = {x["at"] for x in r["hits"] if x["plain"]}
                n = enough(hits, r["words"], r["windows"], plain, r["templates"], least)
                if n:
                    out.append((r["key"], r["item"]["item_id"], n))
            keys, items, counts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [pa.array(keys, pa.string()), pa.array(items, pa.int64()), pa.array(counts, pa.int64())],
                ["key", "item_id", "found"],
            )

    judged = map_batches(grouped.where(possible), judge, "key string, item_id long, found long")
    return judged.groupBy("key", "item_id").agg(F.max("found").alias("found"))


def text_key() -> Column:
    return F.md5(F.col("text").cast("binary"))


def salted(rows: DataFrame) -> DataFrame:
    """``rows``, one for each of the ``SALTS`` parts that the copies of a text are in."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, work: Workspace) -> DataFrame:
    """Per document ``doc_id, contaminated, n_items, item_ids`` (in order)."""
    items = contaminated_texts(docs, benchmark, work).groupBy("key").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )
    plain = with_columns(docs, {"doc_id": "long", "text": "string"})
    part = F.xxhash64("doc_id")
    # A null text is like no other: it gets a key of its own that no MD5 equals.
    keyed = plain.select(
        "doc_id", F.coalesce(text_key(), part.cast("string")).alias("key"),
        F.pmod(part, F.lit(SALTS)).cast("int").alias("salt"),
    )
    none = F.array().cast("array<bigint>")
    ids = F.coalesce("item_ids", none)
    return keyed.join(salted(items), ["key", "salt"], "left").select(
        "doc_id", (F.size(ids) > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, in the same columns."""
    bad = salted(contaminated_texts(docs, benchmark, work).select("key").distinct())
    # The rows travel as one column, so that no name of theirs clashes.
    part = F.xxhash64("doc_id")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(text_key(), part.cast("string")).alias("key"),
        F.pmod(part, F.lit(SALTS)).cast("int").alias("salt"),
    )
    return rows.join(bad, ["key", "salt"], "left_anti").select("row.*")
