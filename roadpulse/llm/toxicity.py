"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import allowed_labels, as_bytes, fold, parts, ragged, sampled

#: Words are runs of ASCII letters and digits and of all other characters, A-Z lower-cased.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ftrl:
    """``sample`` labelled documents of each class at most are learned from, dealt to ``shards`` tasks.

    ``l1`` holds from ``l1_documents`` documents a shard on and is less in proportion below, as gradients sum up to less.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l1_documents: int = 700
    l2: float = 1.0
    epochs: int = 6
    shards: int = 1
    sample: int = 4000


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unigrams, bigrams and bigrams that skip one word, each once a text, with the text's number."""
    words = [t.translate(_FOLDED).split() for t in texts]
    rows = ragged(np.fromiter(map(len, words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, len(rows))
    grams, owners = [hashes], [rows]
    for step in (1, 2):
        inside = rows[step:] == rows[:-step]
        grams.append((hashes[:-step] * (_MIX + np.uint64(2 * step)) + hashes[step:])[inside])
        owners.append(rows[step:][inside])
    return (np.concatenate(grams) * _ODD >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def learn(texts: list[bytes], labels: np.ndarray, p: Ftrl, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with weight, their weights and their sums of squared gradients; the last bucket is the intercept."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = p.l1 * min(1.0, len(texts) / p.l1_documents)
    active = []
    for part in [texts[i : i + 256] for i in range(0, len(texts), 256)]:
        grams, owners = features(part, p.bits)
        keys = np.unique(owners << p.bits | grams)
        cuts = np.searchsorted(keys >> p.bits, np.arange(len(part) + 1))
        active += [np.append(keys[a:b] & ((1 << p.bits) - 1), size - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    order = np.random.default_rng(seed)
    for _ in range(p.epochs):
        for i in order.permutation(len(active)):
            at = active[i]
            zs, ns = z[at], n[at]
            # Weights within the L1 bound are exactly 0; each coordinate has its own rate.
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((p.beta + np.sqrt(ns)) / p.alpha + p.l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / p.alpha * w
            n[at] = ns + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    used = np.flatnonzero(n)
    return used, w[used], n[used]


def _learn_shard(p: Ftrl):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "_text"])
        at, w, n = learn([bytes(t) for t in rows["_text"]], rows["_label"].to_numpy(), p)
        # Buckets without a weight count too: they pull the mean of those that other shards have.
        return pd.DataFrame({"bucket": at, "w": w * n, "n": n})

    return run


def fit(docs: DataFrame, labels: DataFrame, params: Ftrl, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, held: int = 0) -> np.ndarray:
    """Weights by bucket, the intercept last.

    Learns from a bounded sample of the labelled documents outside the held-out fold, the same in every run: ``sample`` of
    each class, by a hash of the id. Each shard learns by itself; weights are averaged by their sums of squared gradients,
    which favours the shards that saw a feature. One class alone, or none, gives no weights. The intercept is moved by
    ``prior_shift``.
    """
    chosen = sampled(docs, labels.where(F.col("toxic").isin(0, 1)), "toxic", params.sample, text, doc_id, (fold("_id", modulus) != held)).withColumn(
        "_shard", F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(params.shards)))
    learned = chosen.groupBy("_shard").applyInPandas(_learn_shard(params), "bucket long, w double, n double")
    mixed = learned.groupBy("bucket").agg((F.sum("w") / F.sum("n")).alias("w")).where(F.col("w") != 0)
    weights = np.zeros((1 << params.bits) + 1)
    for row in mixed.collect():  # at most one row a bucket; L1 leaves few
        weights[row["bucket"]] = row["w"]
    if weights.any():
        weights[-1] += prior_shift(docs, labels, params, doc_id, modulus, held)
    return weights


def prior_shift(docs: DataFrame, labels: DataFrame, params: Ftrl, doc_id: str = "doc_id", modulus: int = 5, held: int = 0) -> float:
    """Log odds of toxic to clean among all labelled documents that may be learned from, less those of the sample.

    Added to the intercept, it makes scores refer to the labels' own shares, whichever class the sample cuts; 0 where it cuts none.
    """
    allowed = allowed_labels(docs, labels.where(F.col("toxic").isin(0, 1)), "toxic", doc_id, fold("_id", modulus) != held)
    every = {r["_label"]: r["count"] for r in allowed.groupBy("_label").count().collect()}
    if len(every) < 2:
        return 0.0
    return float(np.log(every[1] / every[0]) - np.log(min(every[1], params.sample) / min(every[0], params.sample)))


def score(text: str | Column, weights, params: Ftrl) -> Column:
    """Probability that a text is toxic. ``weights`` is a broadcast pair of sorted buckets and weights, and the intercept."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        table, intercept = weights.value
        out = [np.zeros(0)]
        for part in parts(texts):
            grams, owners = features(part, params.bits)
            hit = np.flatnonzero(table[grams])
            # Only features with a weight are made distinct.
            keys = np.unique(owners[hit] << params.bits | grams[hit])
            sums = np.bincount(keys >> params.bits, weights=table[keys & ((1 << params.bits) - 1)], minlength=len(part))
            out.append(1 / (1 + np.exp(-np.clip(sums + intercept, -35, 35))))
        return pa.array(np.concatenate(out))

    return scored(as_bytes(text))


def model(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), text: str = "text", doc_id: str = "doc_id"):
    """The fitted weights, broadcast: 2 ** bits single-precision numbers, whatever the corpus."""
    weights = fit(docs, labels, params, text, doc_id)
    return docs.sparkSession.sparkContext.broadcast((weights[:-1].astype(np.float32), float(weights[-1])))


def score_documents(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Only the text is scored. Null texts are empty and score as the intercept. A null id is in no labelled row, and in fold 0.
    Labels other than 0 and 1 are not used; an id with both counts as 1. Repeated rows are scored alike; other columns are
    ignored; an empty table gives an empty result.
    """
    weights = model(docs, labels, params, text, doc_id)
    scored = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, 5) == 0).alias("held_out"), score(text, weights, params).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return docs.where(score(text, model(docs, labels, params, text, doc_id), params) < 0.5)
