"""Shared by the operators: bounded parts of texts, stored tables, joins that spread hot keys, digests."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.plans.lineage import scratch_path

#: A word in Java, Python and RE2 syntax: anything between the ASCII separators. ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task turns into words at a time; a longer text is a part by itself.
PART_BYTES = 4 << 20
#: A key with more than this share of the rows is spread; so there are at most as many hot keys.
HOT_SHARE = 256


def as_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def parts(texts: pa.Array, limit: int = PART_BYTES) -> Iterator[list[bytes]]:
    """Consecutive parts of a binary array, each of about ``limit`` bytes or one longer text."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bins = np.cumsum(sizes) // limit
    for start, end in pairwise([0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(texts)]):
        yield [t or b"" for t in texts.slice(start, end - start).to_pylist()]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither compute it again nor lose it with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, which is unique in ``right`` and null in neither.

    A key with over 1 / HOT_SHARE of the left rows is dealt to several tasks and its right row copied to each. ``left`` is
    read twice, so it should be stored. Names other than ``key`` must differ.
    """
    per_key = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = max(1, left.count() // HOT_SHARE)
    # At most HOT_SHARE rows: each stands for more than that share of all.
    hot = per_key.where(F.col("_rows") > share).select(key, F.ceil(F.col("_rows") / share).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(copies > 1, F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), copies).cast("int")).otherwise(0))
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.drop("_copies").join(copied.drop("_copies"), [key, "_salt"], "left").drop("_salt")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


#: Most bits of a filter of ids, 16 MB. Beyond some ten million ids more rows pass it. And the bits an id gets where fewer do.
FILTER_BITS, FILTER_HASHES, ID_BITS = 1 << 27, 4, 32


def _places(key: Column, bits: int) -> list[Column]:
    """Bits that stand for a key."""
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(FILTER_HASHES)]


def filter_bits(rows: int | None) -> int:
    """Bits of a filter of so many ids: whole pieces of 4 KB, a power of two. All that are allowed if the number is not known."""
    return FILTER_BITS if rows is None else min(FILTER_BITS, 1 << max(15, (rows * ID_BITS - 1).bit_length()))


def id_filter(ids: DataFrame, key: str, rows: int | None = None) -> Column:
    """Whether ``key`` may be among ``ids``: true for all that are, and for few others. Null is not.

    The bits are set in tasks and joined in pieces of 4 KB, so the driver gets 16 MB at most, whatever the number of ids; if
    their number ``rows`` is known, no more than that many need.
    """
    total = filter_bits(rows)
    # Spark counts bits and pieces from 1.
    spots = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), total))).alias("_bit")).select((F.col("_bit") + 1).alias("_bit"))
    pieces = spots.groupBy(F.bitmap_bucket_number("_bit").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    size = 4096
    bits = bytearray(total // 8)
    for row in pieces.collect():
        bits[(row["_piece"] - 1) * size : row["_piece"] * size] = row["_bits"]
    held = ids.sparkSession.sparkContext.broadcast(np.frombuffer(bits, np.uint8))

    @F.arrow_udf("boolean")
    def maybe(*places: pa.Array) -> pa.Array:
        out = np.ones(len(places[0]), bool)
        for place in places:
            at = place.to_numpy(zero_copy_only=False)
            out &= held.value[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1
        return pa.array(out)

    return F.col(key).isNotNull() & maybe(*_places(F.col(key), total))


def allowed_labels(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, where: Column) -> DataFrame:
    """``_id, _label`` of the labelled ids that ``docs`` has and ``where`` (on ``_id``) allows; of several labels the largest."""
    known = docs.select(F.col(doc_id).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    labelled = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return labelled.where(where).join(known, "_id", "left_semi")


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str, doc_id: str, where: Column) -> DataFrame:
    """``_id, _label, _order, _text`` of at most ``rows`` labelled documents of each label, the same in every run.

    Ids are chosen by a hash, among those that ``docs`` has and ``where`` (on ``_id``) allows, before any text is read. An id
    with several labels has the largest; of several documents with one id, one stands for it.
    """
    allowed = allowed_labels(docs, labels, label, doc_id, where).withColumn("_order", F.xxhash64(F.lit(1), "_id"))
    chosen = [allowed.where(F.col("_label") == value).orderBy("_order", "_id").limit(rows) for value in (0, 1)]
    # At most 2 * rows ids, a documented bound.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    body = docs.select(F.col(doc_id).alias("_id"), as_bytes(text).alias("_text")).join(ids, "_id")
    return body.groupBy("_id", "_label", "_order").agg(F.min("_text").alias("_text"))


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Row number of every element of rows with these lengths."""
    return np.repeat(np.arange(len(lengths)), lengths)
