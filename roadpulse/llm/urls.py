"""URL rules and lists in a sorted digest array (operator 6)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest list shipped to the executors, where it is mapped, not loaded. A longer one is an error, never cut.
MOST_LIST_BYTES = 2 << 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Strings in the order of their 64-bit digests, with a small value each, in one file that tasks map.

    Layout: count, digests, ends of the strings, values, then the strings. A probe is a binary search of many digests at
    once; a hit counts only if the stored string is equal, so colliding digests do no harm.
    """

    def __init__(self, path: str):
        count = int(np.fromfile(path, dtype=np.int64, count=1)[0])
        self.digests = np.memmap(path, np.uint64, "r", 8, (count,)) if count else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 8 + 8 * count, (count,)) if count else np.empty(0, np.int64)
        self.values = np.memmap(path, np.int64, "r", 8 + 16 * count, (count,)) if count else np.empty(0, np.int64)
        start = 8 + 24 * count
        size = os.path.getsize(path) - start
        self.blob = np.memmap(path, np.uint8, "r", start, (size,)) if size else np.empty(0, np.uint8)

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, int]]) -> None:
        """Entries with equal strings keep the smallest value."""
        least: dict[bytes, int] = {}
        for text, value in entries:
            raw = text.encode()
            least[raw] = min(value, least.get(raw, value))
        keyed = sorted((xxhash.xxh64_intdigest(raw), raw, value) for raw, value in least.items())
        if sum(len(raw) + 24 for _, raw, _ in keyed) > MOST_LIST_BYTES:
            raise ValueError(f"the list is over {MOST_LIST_BYTES} bytes; split it and apply the parts in turn")
        with open(path, "wb") as out:
            out.write(np.array([len(keyed)], np.int64).tobytes())
            out.write(np.array([k for k, _, _ in keyed], np.uint64).tobytes())
            out.write(np.cumsum([len(raw) for _, raw, _ in keyed], dtype=np.int64).tobytes())
            out.write(np.array([v for _, _, v in keyed], np.int64).tobytes())
            for _, raw, _ in keyed:
                out.write(raw)

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Value of each string, -1 where it is not in the array."""
        found = np.full(len(texts), -1, np.int64)
        if not len(self.digests) or not texts:
            return found
        keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.digests, keys)
        open_ = np.flatnonzero(at < len(self.digests))
        while len(open_):
            open_ = open_[self.digests[at[open_]] == keys[open_]]
            for i in open_:  # only digests that are in the list
                end = int(self.ends[at[i]])
                start = int(self.ends[at[i] - 1]) if at[i] else 0
                if self.blob[start:end].tobytes() == texts[i]:
                    found[i] = self.values[at[i]]
            open_ = open_[found[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.digests)]
        return found


def _ship(spark: SparkSession, entries: Iterable[tuple[str, int]], name: str) -> str:
    """Writes the array once on the driver and lets Spark copy the file to every executor; returns the file's name."""
    file = f"{name}-{uuid.uuid4().hex}.digests"
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), file)
    DigestArray.write(path, entries)
    spark.sparkContext.addFile(path)
    return file


def _probe(rules_file: str, list_file: str, starts: tuple[int, ...], depth: int):
    """Task function: index of the longest fitting rule of each (host, path), and whether the list holds the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, blocked = DigestArray(SparkFiles.get(rules_file)), DigestArray(SparkFiles.get(list_file))
        for batch in batches:
            hosts, paths = batch.column("_host").to_pylist(), batch.column("_path").to_pylist()
            rows: list[int] = []
            tries: list[bytes] = []
            host_rows: list[int] = []
            host_tries: list[bytes] = []
            for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                labels = host.split(".")
                first = max(0, len(labels) - depth)
                suffixes = [".".join(labels[i:]) for i in range(first, len(labels))] if host else []
                # A host with more labels than any rule has only its last ones tried, which are all that can fit.
                for suffix in suffixes:
                    for length in starts:
                        if length <= len(path):
                            rows.append(row)
                            tries.append(f"{suffix} {path[:length]}".encode())
                host_rows += [row] * len(suffixes)
                host_tries += [s.encode() for s in suffixes]
            best = np.full(len(hosts), np.iinfo(np.int64).max, np.int64)
            hits = rules.find(tries)
            fits = hits >= 0
            np.minimum.at(best, np.array(rows, np.int64)[fits], hits[fits])
            listed = np.zeros(len(hosts), bool)
            listed[np.array(host_rows, np.int64)[blocked.find(host_tries) >= 0]] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(best, pa.int64(), mask=best == np.iinfo(np.int64).max), pa.array(listed)],
                names=["_row", "_host", "_path", "_best", "_listed"])

    return run


def judge(pages: DataFrame, rules: Iterable[Rule], blocked_hosts: Iterable[str] = (), url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``rules`` are (verdict, host, start of the path). One fits its host and all subdomains of it; of several that fit, the
    one with the most characters wins, at a tie the one with the longer host. Rules and hosts of the list lie in digest
    arrays, sized before they are shipped; the ranks of the rules are the values, best first, so the smallest hit wins.
    Without a rule, a host in ``blocked_hosts`` or below one is blocked, any other allowed.

    Null urls and those without ``://`` have an empty host and path, fit no rule and are allowed. Repeated rows and null ids
    are kept as they are, other columns are ignored, an empty table gives an empty result.
    """
    ranked = sorted({(v, h.lower(), p) for v, h, p in rules}, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[1], r[2], r[0]))
    hosts = sorted({h.lower() for h in blocked_hosts})
    spark = pages.sparkSession
    rules_file = _ship(spark, [(f"{h} {p}", i) for i, (_, h, p) in enumerate(ranked)], "rules")
    list_file = _ship(spark, [(h, 0) for h in hosts], "hosts")
    starts = tuple(sorted({len(p) for _, _, p in ranked}))
    depth = max((h.count(".") + 1 for h in [*hosts, *(h for _, h, _ in ranked)]), default=0)
    cut = pages.select(F.col(page_id).alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    kind = cut.schema["_row"].dataType.simpleString()
    probed = cut.mapInArrow(_probe(rules_file, list_file, starts, depth), f"_row {kind}, _host string, _path string, _best long, _listed boolean")
    # The rules are named again from their ranks on the same bounded list.
    named = spark.createDataFrame([(i, f"{h}{p}", v) for i, (v, h, p) in enumerate(ranked)], "_best long, rule string, _verdict string")
    if len(ranked) <= 100_000:
        named = F.broadcast(named)
    return probed.join(named, "_best", "left").select(
        F.col("_row").alias("page_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("_verdict", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))
