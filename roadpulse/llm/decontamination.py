"""Benchmark decontamination with an FM-index of every shard of the corpus (operator 8)."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import as_bytes, parts, ragged
from roadpulse.llm.fm_index import FmIndex

WINDOW = 13
#: Bytes of text in one shard, or one longer text, and of benchmark text in one block.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 4 << 20
#: Occurrences located at a time.
LOCATE_ROWS = 1 << 20
#: A document is contaminated if hit words are at least one in LEAST_SHARE.
LEAST_SHARE = 20
# Bytes other than ASCII letters, digits and those of other characters part words; A-Z are lower-cased first.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def _block(items: list[tuple[str, bytes]]) -> dict:
    """Vocabulary from 1 on, distinct windows as rows of word numbers, and the items of each window."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        numbers = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
        for i in range(max(1, len(numbers) - WINDOW + 1) if numbers else 0):
            owners.setdefault(numbers[i : i + WINDOW], set()).add(item)
    names = sorted({i for s in owners.values() for i in s})
    place = {n: i for i, n in enumerate(names)}
    lengths = np.array([len(w) for w in owners], np.int64)
    windows = np.zeros((len(owners), WINDOW), np.int64)
    for row, window in enumerate(owners):
        windows[row, : len(window)] = window
    listed = [sorted(place[i] for i in s) for s in owners.values()]
    return {
        "vocabulary": vocabulary, "windows": windows, "lengths": lengths, "names": names,
        "items": np.array(list(chain.from_iterable(listed)), np.int64), "ends": np.cumsum([0, *map(len, listed)]).astype(np.int64),
    }


def _runs(symbols: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols to index and their places: runs of known words of one text that can hold a window, each ended by 0.

    A window holds only words of the benchmark, so nothing else of the text can take part in an occurrence.
    """
    known = symbols > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1] | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.add.reduceat(known.astype(np.int64), starts)
    long = lengths >= least
    starts, lengths = starts[long], lengths[long]
    inside = np.arange((lengths + 1).sum()) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    places = np.repeat(starts, lengths + 1) + inside
    out = symbols[np.minimum(places, len(symbols) - 1)].copy()
    out[np.cumsum(lengths + 1) - 1] = 0
    return out, places


def _search(texts: list[bytes], blocks: list) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words, hit words and items of each text of one shard, by one index a block of the benchmark."""
    words = [words_of(t) for t in texts]
    rows = ragged(np.fromiter(map(len, words), np.int64, len(words)))
    hit = np.zeros(len(rows) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for held in blocks:
        block = held.value
        if len(blocks) > 1:
            held.__dict__.pop("_value", None)  # else the worker would keep every block it has read
        if not len(block["windows"]):
            continue
        number = block["vocabulary"].get
        symbols = np.fromiter((number(w, 0) for w in chain.from_iterable(words)), np.int64, len(rows))
        indexed, places = _runs(symbols, rows, int(block["lengths"].min()))
        if not len(indexed):
            continue
        index = FmIndex(indexed, len(block["vocabulary"]) + 1)
        low, high = index.search(block["windows"], block["lengths"])
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        counts = (high - low)[found]
        # A passage that is everywhere has many occurrences; they are located in slices.
        cuts = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum(), LOCATE_ROWS), side="right")
        for a, b in zip(cuts, [*cuts[1:], len(found)], strict=True):
            window = np.repeat(found[a:b], counts[a:b])
            offsets = np.arange(len(window)) - np.repeat(np.cumsum(counts[a:b]) - counts[a:b], counts[a:b])
            at = places[index.locate(np.repeat(low[found[a:b]], counts[a:b]) + offsets)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + block["lengths"][window], -1)
            pairs = np.unique(rows[at] * len(block["windows"]) + window)
            for text, w in zip((pairs // len(block["windows"])).tolist(), (pairs % len(block["windows"])).tolist(), strict=True):
                items[text].update(block["names"][i] for i in block["items"][block["ends"][w] : block["ends"][w + 1]])
    covered = np.cumsum(hit[:-1]) > 0
    return np.bincount(rows, minlength=len(texts)), np.bincount(rows, weights=covered, minlength=len(texts)).astype(np.int64), items


def blocks_of(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> list:
    """Broadcast parts of the benchmark of about BLOCK_BYTES each.

    Test sets are small next to a corpus, but their size is not assumed: rows arrive one by one and each block is sent off
    when it is full, so the driver holds one block, and a task one at a time. Items with a null id are named ``""``.
    """
    context = benchmark.sparkSession.sparkContext
    found, held, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), as_bytes(text).alias("t")).toLocalIterator():
        held.append((row["i"], bytes(row["t"])))
        size += len(row["t"])
        if size >= BLOCK_BYTES:
            found.append(context.broadcast(_block(held)))
            held, size = [], 0
    return [*found, context.broadcast(_block(held))] if held else found


def contamination(text: str | Column, blocks: list) -> Column:
    """Struct ``n_words, n_hit, items`` of a text; items are sorted as strings."""

    @F.arrow_udf("struct<n_words:long,n_hit:long,items:array<string>>")
    def searched(texts: pa.Array) -> pa.Array:
        total, hits, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for shard in parts(texts, SHARD_BYTES):
            n, h, i = _search(shard, blocks)
            total.append(n)
            hits.append(h)
            items += [sorted(s) for s in i]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(total), pa.int64()), pa.array(np.concatenate(hits), pa.int64()), pa.array(items, pa.list_(pa.string()))],
                                          names=["n_words", "n_hit", "items"])

    return searched(as_bytes(text))


def _contaminated(found: Column) -> Column:
    return (found["n_hit"] > 0) & (LEAST_SHARE * found["n_hit"] >= found["n_words"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` of every document.

    Each shard of documents is indexed and every window of the benchmark searched backward in it; occurrences are located
    and their spans merged. An item of fewer than WINDOW words, but not none, is one window. Null and empty texts have no
    words and are clean, an empty benchmark hits nothing, an item that repeats counts once. Repeated rows and null ids are
    judged one by one; other columns are ignored; an empty table gives an empty result.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), contamination(text, blocks_of(benchmark)).alias("_f"))
    return found.select("doc_id", "_f.n_words", "_f.n_hit", "_f.items", _contaminated(F.col("_f")).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return docs.where(~_contaminated(contamination(text, blocks_of(benchmark))))
