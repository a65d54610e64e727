"""Quality by compression with dictionaries of good and bad text (operator 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import as_bytes, fold, parts, sampled

#: Labelled documents of each class that the dictionaries are built from, and as many for the calibration.
SAMPLE = 1500
#: Size of a dictionary, and the most that one document gives it: one text must not fill it.
DICT_BYTES, LONGEST = 400 << 10, 32 << 10
#: Texts are compressed in pieces of this size, each against the dictionaries alone: a longer history would hide them.
PIECE = 16 << 10
#: Higher levels look further back into the dictionary.
LEVEL = 6


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    built = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    built.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_content_size=False, write_checksum=False, write_dict_id=False)


def build(texts: list[bytes]) -> bytes:
    """A content dictionary: texts in their order, as many as fit; content tells classes apart better than a trained one.

    A text over LONGEST gives one piece of that size, chosen by its digest.
    """
    chosen, size = [b"\n" * 8], 8
    for text in texts:
        if len(text) > LONGEST:
            at = xxhash.xxh64_intdigest(text) % (len(text) // LONGEST) * LONGEST
            text = text[at : at + LONGEST]
        if size + len(text) < DICT_BYTES:
            chosen.append(text)
            size += len(text) + 1
    return b"\n".join(chosen)


def differences(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Compressed size of all pieces with the bad dictionary less that with the good one, over the plain size; 0 for an empty text."""

    def less(text: bytes) -> int:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces)

    return np.array([less(t) / len(t) if t else 0.0 for t in texts])


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with classes of equal weight, by Newton's method with a small ridge."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    scale = max(float(np.std(x)), 1e-6)
    u = x / scale
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -35, 35)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * u).sum() + 0.1 * a, g.sum() + 0.01 * b
        haa, hab, hbb = (h * u * u).sum() + 0.1, (h * u).sum(), h.sum() + 0.01
        det = haa * hbb - hab * hab
        step_a, step_b = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        largest = max(abs(step_a), abs(step_b), 1.0)
        a, b = a - step_a / largest, b - step_b / largest
        if max(abs(step_a), abs(step_b)) < 1e-9:
            break
    return a / scale, b


def _build_class(rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows.sort_values(["_order", "_text"])
    return pd.DataFrame({"_label": [int(ordered["_label"].iloc[0])], "_dictionary": [build([bytes(t) for t in ordered["_text"]])]})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE,
        modulus: int = 3, held: int = 1) -> tuple[bytes, bytes, float, float] | None:
    """Good and bad dictionary, slope and intercept; None without labelled documents of both classes.

    Learns from a bounded sample outside the held-out fold: of ``2 * sample`` documents of each class by a hash of the id,
    one half builds the dictionaries, the other half calibrates.
    """
    chosen = sampled(docs, labels.where(F.col("quality").isin(0, 1)), "quality", 2 * sample, text, doc_id, fold("_id", modulus) != held).withColumn(
        "_half", F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(2))).persist()
    built = {r["_label"]: bytes(r["_dictionary"]) for r in
             chosen.where("_half = 0").groupBy("_label").applyInPandas(_build_class, "_label int, _dictionary binary").collect()}
    if len(built) < 2:
        chosen.unpersist()
        return None
    pair = docs.sparkSession.sparkContext.broadcast((built[1], built[0]))
    rows = chosen.where("_half = 1").select("_label", _difference(F.col("_text"), pair).alias("x")).orderBy("_label", "x").toPandas()
    chosen.unpersist()
    a, b = calibrate(rows["x"].to_numpy(float), rows["_label"].to_numpy(float)) if rows["_label"].nunique() == 2 else (100.0, 0.0)
    return built[1], built[0], a, b


def _difference(data: Column, pair) -> Column:
    @F.arrow_udf("double")
    def measured(texts: pa.Array) -> pa.Array:
        good, bad = map(_compressor, pair.value[:2])
        return pa.array(np.concatenate([np.zeros(0), *[differences(part, good, bad) for part in parts(texts)]]))

    return measured(data)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Only the text is scored, whole, piece by piece. Empty and null texts have difference 0. Without both classes every score is 0.5. A null
    id is in no labelled row, and in fold 0. Labels other than 0 and 1 are not used; an id with both counts as 1. Repeated
    rows are scored alike; other columns are ignored; an empty table gives an empty result.
    """
    fitted = fit(docs, labels, text, doc_id)
    if fitted is None:
        score = F.lit(0.5)
    else:
        a, b = fitted[2:]
        score = 1 / (1 + F.exp(-(F.lit(a) * _difference(as_bytes(text), docs.sparkSession.sparkContext.broadcast(fitted[:2])) + F.lit(b))))
    scored = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, 3) == 1).alias("held_out"), score.alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
