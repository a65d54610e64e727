"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letters (operator 13)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import as_bytes, lookup, parts, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a code point, which plants misspellings.
DAMAGE = 97
#: A letter multiset is a binary vector with one place for each letter and how-manieth of it. One edit changes at most two places.
DISTANCE = 2
#: Parts of the places. Vectors at that distance agree on some choice of all parts but two, so each choice is a signature.
PARTS = 6
CHOICES = tuple(combinations(range(PARTS), PARTS - DISTANCE))
#: Words of one signature that a task compares at a time; more are split into pairs of parts.
GROUP_ROWS = 4096
#: A signature counts as large only beyond this share of all entries, which bounds the broadcast table of large ones.
LARGE_SIGNATURES = 1_000_000
PARTITION_ROWS = 200_000
#: Words that a task counts, and pairs that it holds, before it hands them on.
HELD = 200_000
#: Letters compared in columns; longer words are compared one by one.
COLUMNS = 32
#: A word to be a form has this many times the occurrences.
TIMES = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(doc: object, text: bytes) -> Iterator[tuple[str, int]]:
    """Words of one text and their occurrences, after the planted damage."""
    prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(RUN.findall(text.translate(_LOWER).decode())).items():
        if len(run) >= LEAST_LETTERS:
            mark = zlib.crc32(run.encode(), prefix)
            if mark % DAMAGE == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= LEAST_LETTERS:
                yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: words and their occurrences, added up before they are shuffled."""
    total: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        docs, done = batch.column(0).to_pylist(), 0
        for texts in parts(batch.column(1)):
            for i, text in enumerate(texts):
                for word, n in _words(docs[done + i], text):
                    total[word] += n
                if len(total) >= HELD:
                    yield handed()
                    total.clear()
            done += len(texts)
    yield handed()


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n`` of the words with LEAST_LETTERS code points and LEAST_COUNT occurrences in all documents."""
    body = docs.select(F.col(doc_id).cast("string").alias("_id"), as_bytes(text).alias("_text"))
    return body.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins (and the end)."""
    cuts = np.concatenate([[0], np.cumsum(list(map(len, words)))]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), cuts


def signatures(words: list[str]) -> np.ndarray:
    """One number a word and choice of parts."""
    letters, cuts = _letters(words)
    rows = np.repeat(np.arange(len(words)), np.diff(cuts))
    order = np.lexsort((letters, rows))
    row, letter = rows[order], letters[order]
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])
    starts = np.flatnonzero(opens)
    nth = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    place = (letter.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64)) * _ODD
    place = (place ^ place >> np.uint64(29)) * _MIX
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (row, (letter + 2 * nth) % PARTS), place ^ place >> np.uint64(32))
    out = np.empty((len(words), len(CHOICES)), np.uint64)
    for i, chosen in enumerate(CHOICES):
        mixed = np.full(len(words), i + 1, np.uint64)
        for part in chosen:
            mixed = (mixed ^ sums[:, part]) * _ODD
            mixed ^= mixed >> np.uint64(31)
        out[:, i] = mixed
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: one row a word and signature."""
    for batch in batches:
        found = signatures(batch.column("word").to_pylist())
        row, choice = (x.reshape(-1) for x in np.indices(found.shape))
        source = batch.take(pa.array(row))
        yield pa.RecordBatch.from_pydict({
            "word": source.column("word"), "n": source.column("n"), "_choice": pa.array(choice.astype(np.int32)), "_key": pa.array(found.reshape(-1).view(np.int64))})


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


class _Table:
    """Words of a partition, ready to be compared pair by pair."""

    def __init__(self, words: list[str]):
        self.words = words
        letters, cuts = _letters(words)
        self.size = np.diff(cuts)
        rows = np.repeat(np.arange(len(words)), self.size)
        column = np.arange(len(letters)) - cuts[rows]
        near = column < COLUMNS
        self.grid = np.zeros((len(words), COLUMNS + 1), np.uint8)
        self.grid[rows[near], column[near]] = letters[near]  # no code point of a run is over 255
        self.held = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(self.held, rows, np.uint64(1) << (letters % 64).astype(np.uint64))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart."""
        fits = (np.abs(self.size[a] - self.size[b]) <= 1) & (np.bitwise_count(self.held[a] ^ self.held[b]) <= DISTANCE)
        at = np.flatnonzero(fits)
        a, b = a[at], b[at]
        a, b = np.where(self.size[a] <= self.size[b], a, b), np.where(self.size[a] <= self.size[b], b, a)
        long = self.size[b] > COLUMNS
        fits[at[long]] = [one_edit(self.words[x], self.words[y]) for x, y in zip(a[long], b[long], strict=True)]
        at, a, b = at[~long], a[~long], b[~long]
        even = self.size[a] == self.size[b]
        fits[at[even]] = (self.grid[a[even]] != self.grid[b[even]]).sum(axis=1) == 1
        at, short, full = at[~even], self.grid[a[~even]], self.grid[b[~even]]
        # The shorter word agrees up to some place, and from there on with the longer one's next letters.
        first = (short != full).argmax(axis=1)
        moved = short[:, :-1] != full[:, 1:]
        last = np.where(moved.any(axis=1), COLUMNS - 1 - moved[:, ::-1].argmax(axis=1), -1)
        fits[at] = last < first
        return fits


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: of each word with near words its number of new ones and the most frequent of them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    key, i, j, own, choice, n = (table.column(c).to_numpy() for c in ("_key", "_i", "_j", "_own", "_choice", "n"))
    order = np.lexsort((own, j, i, key, choice))
    key, i, j, own, choice, n = (c[order] for c in (key, i, j, own, choice, n))
    words = table.column("word").take(pa.array(order)).to_pylist()
    del table
    opens = np.ones(len(key), bool)
    opens[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (choice[1:] != choice[:-1])
    starts = np.flatnonzero(opens)
    sizes = np.diff(np.append(starts, len(key)))
    ends = np.repeat(starts + sizes, sizes)
    ready = _Table(words)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def told() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        found.clear()
        if not len(a):
            return
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        signs = signatures([words[u] for u in used])
        x, y = at[: len(a)], at[len(a) :]
        # A pair belongs to the first signature that both words share.
        mine = (signs[x] == signs[y]).argmax(axis=1) == choice[a]
        a, b = np.concatenate([a[mine], b[mine]]), np.concatenate([b[mine], a[mine]])
        sort = np.lexsort((rank[b], -n[b], a))
        a, b = a[sort], b[sort]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([words[w] for w in a[first]], pa.string()), pa.array(np.diff(np.append(first, len(a)))),
            pa.array([words[w] for w in b[first]], pa.string()), pa.array(n[b[first]])], names=["word", "n_near", "best", "best_n"])

    a = np.arange(len(key))
    for step in range(1, int(sizes.max())):
        a = a[a + step < ends[a]]
        b = a + step
        cross = (i[a] == j[a]) | (own[a] != own[b])
        x, y = a[cross], b[cross]
        near = ready.near(x, y)
        if near.any():
            found.append((x[near], y[near]))
            if sum(len(f[0]) for f in found) >= HELD:
                yield from told()
    yield from told()


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words with a near one, from stored ``word, n``.

    Words meet where they share a signature; each pair is counted at the first signature it shares, so pairs never leave
    their task. A signature over GROUP_ROWS words is cut into parts and compared pair of parts by pair of parts.
    """
    spark = words.sparkSession
    entries = words.mapInArrow(_signed, "word string, n long, _choice int, _key long")
    rows = words.count() * len(CHOICES)
    # Fewer than LARGE_SIGNATURES rows: each stands for over 1 / LARGE_SIGNATURES of the entries.
    large = entries.groupBy("_choice", "_key").count().where(F.col("count") > max(GROUP_ROWS, rows // LARGE_SIGNATURES)).select(
        "_choice", "_key", F.ceil(F.col("count") / (GROUP_ROWS / 2)).cast("int").alias("_parts"))
    placed = entries.join(F.broadcast(large), ["_choice", "_key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    split = placed.withColumn("_own", F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = split.select("*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")).drop("_other", "_parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PARTITION_ROWS + 1)
    told = dealt.repartition(tasks, "_choice", "_key", "_i", "_j").mapInArrow(_compared, "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("_first")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", F.col("_first.best").alias("best"), (-F.col("_first.less")).alias("best_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: every round follows twice as many forms. Each form is more frequent, so there is no ring."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "variant-forms")
    while True:
        further = lookup(ways, ways.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root")
        ways = stored(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variant-roots")
        if not ways.where("_moved").limit(1).count():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def group_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of LEAST_LETTERS code points and LEAST_COUNT occurrences.

    A word is a run of Latin letters with A to Z lower-cased, less a code point where its document and the run mark it as
    damaged. Its form is the most frequent word one edit away (of equal ones the first in code-point order) if that has TIMES
    its occurrences; the root is where the forms lead. Null texts have no words; a null id counts as an empty one. Repeated
    rows count again, other columns are ignored, an empty table gives an empty result. Texts and words of any length are
    taken whole.
    """
    words = stored(vocabulary(docs, text, doc_id), "words")
    near = words.join(near_words(words), "word", "left")
    fits = F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False))
    formed = stored(near.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(fits, F.col("best_n")).alias("form_n")), "word-forms")
    roots = _rooted(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
