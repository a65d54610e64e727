"""Quality rules: base counts and a hashed n-gram likelihood ratio of target to raw text (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import as_bytes, id_filter, parts, ragged, stored

#: Buckets of unigrams and bigrams.
BITS = 16
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0
#: Cut of the mean log-likelihood ratio per n-gram that labels start from, and the documents of each label that stand for it.
THRESHOLD, PRIOR = -0.5, 20
#: Scores are counted in steps of this size to find the cut.
STEP = 1 / 512
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point other than a separator.
_WORD_CHAR = (~_SEPARATOR & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.int64)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def _buckets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams, and the text of each."""
    inside = rows[1:] == rows[:-1]
    pairs = (hashes[:-1] * _MIX + hashes[1:])[inside]
    grams = np.concatenate([hashes, pairs]) * _ODD >> np.uint64(64 - BITS)
    return grams.astype(np.int64), np.concatenate([rows, rows[1:][inside]])


def _repeated(hashes: np.ndarray, rows: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text inside windows that it holds twice or more. Windows are told apart by 64-bit hashes."""
    if len(hashes) < WINDOW:
        return np.zeros(texts, np.int64)
    size = len(hashes) - WINDOW + 1
    windows = hashes[:size].copy()
    for i in range(1, WINDOW):
        windows = windows * _MIX + hashes[i : i + size]
    windows ^= rows[:size].astype(np.uint64) * _ODD
    whole = rows[:size] == rows[WINDOW - 1 :]
    ordered = np.sort(windows[whole])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        starts = np.flatnonzero(whole & np.isin(windows, twice))
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
    return np.bincount(rows, weights=np.cumsum(covered[:-1]) > 0, minlength=texts).astype(np.int64)


def _totals(table: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[data])])
    return sums[ends[1:]] - sums[ends[:-1]]


def _base(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The five base columns, and the hashes and rows of the words."""
    hashes, counts = _hashed(texts)
    rows = ragged(counts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum(list(map(len, texts)))]).astype(np.int64)
    doubles = []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip()]
        doubles.append(len(lines) - len(set(lines)))
    return np.stack([counts, _totals(_WORD_CHAR, data, ends), _totals(_SYMBOL, data, ends), np.array(doubles, np.int64), _repeated(hashes, rows, len(texts))]), hashes, rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: counts of each bucket, one row a bucket and task."""
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for texts in parts(batch.column("_text")):
            hashes, counts = _hashed(texts)
            total += np.bincount(_buckets(hashes, ragged(counts))[0], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """Log-likelihood ratio of each bucket, trusted to raw, from the counts of ``bucket_counts``."""
    return _ratios(bucket_counts(docs, labels, text, doc_id))


def bucket_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", maybe: Column | None = None) -> np.ndarray:
    """Counts of each bucket in raw and in trusted text. Raw counts cover all documents, trusted ones all with quality 1.

    Tasks add up before they shuffle, so a task sends one row a bucket. The driver gets one row a bucket, 2 ** BITS at most.
    Only texts that pass the filter of trusted ids (``maybe``, made here by default) go on to meet those ids.
    Without trusted documents all ratios are 0 and the method rejects nothing.
    """
    ids = _trusted(labels)
    body = docs.select(F.col(doc_id).alias("_id"), as_bytes(text).alias("_text"))
    # Hashed at every size, so that shuffles grow as the trusted texts do.
    good = body.where(id_filter(ids, "_id") if maybe is None else maybe).join(ids.hint("shuffle_hash"), "_id", "left_semi")
    counts = np.zeros((2, 1 << BITS))
    for i, texts in enumerate((body, good)):
        for row in texts.select("_text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            counts[i, row["bucket"]] = row["n"]
    return counts


def _ratios(counts: np.ndarray) -> np.ndarray:
    if not counts[1].sum():
        return np.zeros(1 << BITS)
    shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def _unseen(counts: np.ndarray, grams: np.ndarray) -> float:
    """Score of a trusted text as if it were not among the trusted ones."""
    of = counts[1].sum() - len(grams)
    if not len(grams) or of <= 0:
        return 0.0
    at, own = np.unique(grams, return_counts=True)
    size = SMOOTHING * counts.shape[1]
    ratio = np.log((counts[1][at] - own + SMOOTHING) / (of + size)) - np.log((counts[0][at] + SMOOTHING) / (counts[0].sum() + size))
    return float((ratio * own).sum() / len(grams))


def find_cut(judged: DataFrame, labels: DataFrame) -> float:
    """The score that tells quality 1 from quality 0 best: the largest sum of the share of 1 kept and that of 0 rejected.

    ``judged`` has ``doc_id, base_failed, score, unseen``. Every labelled document that passes the base rules counts, scored
    as if it were not trusted, which is how unlabelled text is scored. An id with both labels counts as 1. PRIOR documents of
    each label are added on either side of THRESHOLD, so with few labels the cut stays there and with many it follows them.
    Of equal cuts the lowest is taken.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    seen = judged.where(~F.col("base_failed")).join(known, "doc_id").select(
        "_quality", F.floor(F.when(F.col("_quality") == 1, F.col("unseen")).otherwise(F.col("score")) / STEP).alias("_step"))
    start = int(np.floor(THRESHOLD / STEP))
    tally: dict[int, list[int]] = {start - 1: [PRIOR, 0], start: [0, PRIOR]}
    for row in seen.groupBy("_quality", "_step").count().collect():  # steps of a mean log ratio, some ten thousand at most
        tally.setdefault(row["_step"], [0, 0])[row["_quality"]] += row["count"]
    return best_step(tally) * STEP


def best_step(tally: dict[int, list[int]]) -> int:
    """The step with the largest share of label 0 below less that of label 1, the lowest of equal ones, from counts of both by step."""
    bad, good = (sum(t[q] for t in tally.values()) for q in (0, 1))
    best, cut, rejected, lost = 0.0, min(tally), 0, 0
    for step in sorted(tally):
        gain = rejected / bad - lost / good
        if gain > best:
            best, cut = gain, step
        rejected, lost = rejected + tally[step][0], lost + tally[step][1]
    return cut


def rules(text: str | Column, maybe: Column, counts) -> Column:
    """Struct of the base columns, ``score`` and, where ``maybe`` holds, ``unseen`` of a text. ``counts`` is a broadcast array."""

    @F.arrow_udf("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,score:double,unseen:double>")
    def judged(texts: pa.Array, marks: pa.Array) -> pa.Array:
        ratios = _ratios(counts.value)
        base, scores, unseen, done = [np.zeros((5, 0), np.int64)], [np.zeros(0)], [], 0
        flags = marks.to_pylist()
        for part in parts(texts):
            columns, hashes, rows = _base(part)
            grams, owners = _buckets(hashes, rows)
            total = np.bincount(owners, minlength=len(part))
            sums = np.bincount(owners, weights=ratios[grams], minlength=len(part))
            base.append(columns)
            scores.append(sums / np.maximum(total, 1))
            cuts = np.searchsorted(rows, np.arange(len(part) + 1))
            for i in range(len(part)):
                words = hashes[cuts[i] : cuts[i + 1]]
                unseen.append(_unseen(counts.value, _buckets(words, np.zeros(len(words), np.int64))[0]) if flags[done + i] else None)
            done += len(part)
        return pa.StructArray.from_arrays([*map(pa.array, np.concatenate(base, axis=1)), pa.array(np.concatenate(scores)), pa.array(unseen, pa.float64())],
                                          names=[*_COLUMNS, "score", "unseen"])

    return judged(as_bytes(text), maybe)


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """``doc_id``, the base columns, ``base_failed``, ``kept`` and ``score`` of every document.

    The score is the mean over a text's unigrams and bigrams of the log ratio of their buckets' shares in trusted text and
    in all text. A text fails the base rules with under LEAST_WORDS words, or if over MOST_REPEATED_PERCENT percent of them
    lie in repeated windows; of the others those with a score of ``threshold`` or more are kept, by default
    the cut that ``find_cut`` takes from the labels. Null texts are empty and
    fail. Repeated rows and null ids are judged one by one; other columns are ignored; an empty table gives an empty result.

    Texts are read where they lie: what meets the labels are ids and scores, and the texts that a filter of the trusted ids lets through.
    """
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_body"))
    maybe = id_filter(_trusted(labels), "_id")
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(marked, labels, "_body", "_id", maybe))
    told = marked.select(F.col("_id").alias("doc_id"), rules("_body", maybe, counts).alias("_r"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = stored(told.select("doc_id", "_r.*").withColumn("base_failed", failed), "judged-texts")
    cut = find_cut(judged, labels) if threshold is None else threshold
    return judged.select("doc_id", *_COLUMNS, "base_failed", (~F.col("base_failed") & (F.col("score") >= cut)).alias("kept"), "score")
