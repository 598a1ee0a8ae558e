"""URL filters from a sorted array of rule digests.

A rule is a host and a path prefix (``example.net/en/``) with a verdict. The
rules' 64-bit xxhash digests are kept in one sorted array, which every task
memory-maps from the file that Spark hands to its machine; the rule texts lie
behind the digests. A url asks for every rule it could fit: each suffix of its
host at a dot, with each prefix of its path of a length that some rule's path
has. All questions of a batch are probed by one vectorised binary search, and a
hit counts only if the stored text is the one asked for. The longest fitting
rule decides; a url that no rule fits is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; a rule repeated with the same text counts once, ``block`` before
``allow``; without any rule everything is allowed.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histmerge.llm.batches import map_slices, with_columns

#: Most bytes of a rule file handed to every machine.
MOST_BYTES = 1 << 30
DEFAULT = "allow"


def rule_parts(rule: str) -> tuple[str, str]:
    """Host and path prefix; the path begins with the first slash."""
    host, slash, rest = rule.partition("/")
    return host.lower(), slash + rest


@dataclass
class RuleFile:
    """``n`` digests in order, ``n + 1`` text offsets, ``n`` verdicts, the texts.

    The first 8 bytes hold ``n``; all numbers are little-endian and 8 bytes wide
    but for the verdicts (1 byte, 1 for block).
    """

    path: str
    digests: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        data = np.memmap(self.path, np.uint8, "r")
        n = int(data[:8].view("<u8")[0])
        cut = 8 + 8 * n
        self.digests = data[8:cut].view("<u8")
        self.offsets = data[cut : cut + 8 * (n + 1)].view("<i8")
        cut += 8 * (n + 1)
        self.blocks, self.texts = data[cut : cut + n], data[cut + n :]
        lengths = {len(rule_parts(self.text(k))[1]) for k in range(n)}
        self.path_lengths = sorted(lengths, reverse=True)

    def text(self, k: int) -> str:
        return self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes().decode()

    @staticmethod
    def write(rules: list[tuple[str, str]], path: str) -> None:
        verdicts: dict[str, bool] = {}
        for rule, verdict in rules:
            text = "".join(rule_parts(rule))
            verdicts[text] = verdicts.get(text, False) or verdict == "block"
        rows = sorted((xxhash.xxh64_intdigest(t), t.encode(), b) for t, b in verdicts.items())
        ends = np.cumsum([0, *(len(t) for _, t, _ in rows)])
        with open(path, "wb") as out:
            out.write(np.array([len(rows), *(d for d, _, _ in rows)], "<u8").tobytes())
            out.write(ends.astype("<i8").tobytes())
            out.write(bytes(b for _, _, b in rows) + b"".join(t for _, t, _ in rows))

    def find(self, asked: list[str]) -> np.ndarray:
        """The rule of each asked text, or -1."""
        out = np.full(len(asked), -1)
        if not len(self.digests) or not asked:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        low = np.searchsorted(self.digests, keys, "left")
        high = np.searchsorted(self.digests, keys, "right")
        for k in np.flatnonzero(high > low):  # digests that are there; texts decide
            out[k] = next((r for r in range(low[k], high[k]) if self.text(r) == asked[k]), -1)
        return out


def asked_rules(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """The texts of all rules that would fit, the longest first."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = [s + path[:n] for s in suffixes if s for n in path_lengths if n <= len(path)]
    return sorted(found, key=lambda x: (-len(x), x))


def share_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Write the rule file and have Spark hand it to every machine; its name."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="rules-")
    RuleFile.write(rules, os.path.join(folder, name))
    size = os.path.getsize(os.path.join(folder, name))
    if size > MOST_BYTES:
        raise ValueError(f"the rules take {size} bytes; at most {MOST_BYTES} go to every machine")
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


_files: dict[str, RuleFile] = {}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``)."""
    name = share_rules(pages.sparkSession, rules)
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    plain = with_columns(pages, {"page_id": "long", "url": "string"})
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = plain.select(
        "page_id",
        F.coalesce(F.translate(F.regexp_extract("url", pattern, 1), upper, upper.lower()), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", pattern, 2), F.lit("")).alias("path"),
    )

    def work(part: pa.RecordBatch, _) -> pa.RecordBatch:
        if name not in _files:
            _files[name] = RuleFile(SparkFiles.get(name))
        file = _files[name]
        ids, hosts, paths = part.columns
        asked, row = [], []
        for k, (h, p) in enumerate(zip(hosts.to_pylist(), paths.to_pylist(), strict=True)):
            texts = asked_rules(h, p, file.path_lengths)
            asked += texts
            row += [k] * len(texts)
        found = file.find(asked)
        rule, verdict = [None] * len(part), [default] * len(part)
        for k in np.flatnonzero(found >= 0)[::-1]:  # the first of a row, its longest, is set last
            rule[row[k]] = asked[k]
            verdict[row[k]] = "block" if file.blocks[found[k]] else "allow"
        return pa.record_batch(
            [ids, hosts, paths, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    return map_slices(
        split, work, "page_id long, host string, path string, rule string, verdict string", "path"
    )
