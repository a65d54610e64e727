"""Positions of regular-expression matches as plain expressions, shared by operators 7 and 10.

Spark has no function for the positions of all matches. The pieces between the matches give them: a match ends where the
lengths of all pieces and matches up to it end. The sums run in a window over one row a match, so a text with a hundred
thousand matches costs no more than as many texts with one; texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters kept on either side of a match for its context.
CONTEXT = 60


@dataclass(frozen=True)
class Kind:
    """A named pattern in Java syntax. Kinds are listed in the order that breaks ties of equal starts."""

    name: str
    pattern: str


def _marked(text: Column, place: int, kind: Kind) -> Column:
    """One struct a piece, with the match that follows it; the last piece has none."""
    parts = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"),
    )
    return F.when(text.rlike(kind.pattern), F.transform(parts, lambda p: F.struct(
        F.lit(place).alias("kind"), F.length(p["piece"]).alias("gap"), p["hit"].alias("hit"),
        F.substring(p["piece"], -CONTEXT, CONTEXT).alias("before"), F.substring(p["piece"], 1, CONTEXT).alias("start_of_piece"),
    ))).otherwise(F.array())


def found(df: DataFrame, text: str, kinds: Sequence[Kind], keep: Sequence[Column] = ()) -> DataFrame:
    """One row a match: ``_row, kind, start, end, hit, before, after`` and, per text, a row with ``kind`` null.

    Offsets are code points, ``end`` exclusive. ``before`` and ``after`` are up to CONTEXT characters between this match and
    its neighbours of the same kind. The row with ``kind`` null carries ``keep``, which are null on the others, so wide
    columns exist once. ``_row`` numbers the rows of ``df``; all rows of a number are in one task.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("hit"),
                     F.lit("").alias("before"), F.lit("").alias("start_of_piece"))
    every = F.concat(F.array(whole), *[_marked(body, i, k) for i, k in enumerate(kinds)])
    packed = df.select(F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), every.alias("_all")).withColumn("_row", F.monotonically_increasing_id())
    rows = packed.select("_row", F.posexplode("_all").alias("_pos", "_m"), "_keep").select(
        "_row", "_pos", F.when(F.col("_pos") == 0, F.col("_keep")).alias("_keep"), "_m.*").repartition("_row")
    order = Window.partitionBy("_row", "kind").orderBy("_pos")
    size = F.coalesce(F.length("hit"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(order)
    placed = rows.select("_row", "_keep", "kind", "hit", "before", end.alias("end"), size.alias("_size"),
                         F.lead("start_of_piece").over(order).alias("after"))
    # The piece after the last match of a kind has no match of its own.
    return placed.where(F.col("hit").isNotNull() | (F.col("kind") == -1)).select(
        "_row", "_keep", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"), (F.col("end") - F.col("_size")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"), "hit", F.lower("before").alias("before"), F.lower(F.coalesce("after", F.lit(""))).alias("after"))


def named(spans: Column, kinds: Sequence[Kind]) -> Column:
    """``kind:start:end`` of sorted (start, kind, end) structs, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn sum."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0)))
    return total % 10 == 0
