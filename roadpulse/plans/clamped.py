"""Ordered smoothing as composition of clamped linear functions.

Every update of a smoothed value is ``v -> min(hi, max(lo, a + b * v))`` with
``b >= 0``, and such functions are closed under composition. Updates are
therefore combined chunk by chunk in parallel, then slice by slice and day by
day. A key with very many updates is spread over
its chunks instead of being gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.plans.lineage import cut, kept

WIDE = 1e300


def update(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def identity() -> Column:
    return update(F.lit(0.0), F.lit(1.0), F.lit(-WIDE), F.lit(WIDE))


def apply(f: Column, value: Column) -> Column:
    return F.greatest(f.lo, F.least(f.hi, f.a + f.b * value))


def then(first: Column, second: Column) -> Column:
    return update(
        second.a + second.b * first.a,
        second.b * first.b,
        apply(second, first.lo),
        apply(second, first.hi),
    )


def compose(updates: Column) -> Column:
    """One function for an array of them, applied left to right."""
    return F.aggregate(updates, identity(), then)


def _gather(df: DataFrame, keys: list[str], order: Column | str, f: str = "f") -> DataFrame:
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(f).alias("f")))).alias("_fs"))
    return listed.select(*keys, compose(F.transform("_fs", lambda x: x.f)).alias("f"))


def per_slice(df: DataFrame, keys: list[str], slot: str, chunk: str, order: list[str]) -> DataFrame:
    """One composed function per key and slice from rows with column ``f``.

    Rows are dealt by key and slice, so that the chunks of a slice, composed one by one, need no second exchange.
    """
    dealt = df.select(*dict.fromkeys([*keys, slot, chunk, *order]), "f").repartition(*keys, slot)
    chunks = _gather(dealt, [*keys, slot, chunk], F.struct(*order).alias("o"))
    return _gather(chunks, [*keys, slot], F.col(chunk))


#: Functions in a row of the tree over days.
BLOCK = 64


def _entries(value: Column, members: Column) -> Column:
    """What each of ``members(n, f)``, in order, begins with: ``_n, v``."""
    kind = "array<struct<_n:bigint,v:double>>"
    return F.aggregate(
        members,
        F.struct(value.alias("v"), F.expr(f"cast(array() as {kind})").alias("out")),
        lambda acc, x: F.struct(
            apply(x.f, acc.v).alias("v"), F.concat(acc.out, F.array(F.struct(x.n.alias("_n"), acc.v.alias("v")))).alias("out")),
        lambda acc: acc.out,
    )


def gather_from(df: DataFrame, keys: list[str], chunk: str, order: list[str], first: Column) -> DataFrame:
    """``first`` of the first row of each of ``keys``, and one function, ``rest``, for all rows with column ``f`` behind it.

    What the first row does may depend on what came before ``keys``, which is known once there is a row for each of them. Rows
    come dealt by ``keys``; what is made of a row's columns afterwards, like ``f`` and ``first``, does not move.
    """
    dealt = df.select(*dict.fromkeys([*keys, chunk, *order]), first.alias("_first"), "f")
    sorted_ = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), "f")))
    chunks = dealt.groupBy(*keys, chunk).agg(sorted_.alias("_fs"), F.min_by("_first", F.struct(*order)).alias("_first"))
    tail = lambda fs: F.slice(fs, F.lit(2), F.size(fs))
    composed = chunks.select(
        *keys, chunk, "_first", compose(F.transform("_fs", lambda x: x.f)).alias("all"), compose(F.transform(tail(F.col("_fs")), lambda x: x.f)).alias("rest"))
    parts = composed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(chunk, "all", "rest"))).alias("_cs"), F.min_by("_first", chunk).alias("first"))
    later = compose(F.transform(tail(F.col("_cs")), lambda x: x["all"]))
    return parts.select(*keys, "first", then(F.get("_cs", F.lit(0))["rest"], later).alias("rest"))


def walk(slices: DataFrame, start: DataFrame | None, keys: list[str], slot: str, per_day: int, default: float | None = None,
         carry: tuple[str, ...] = (), limits: tuple[int, int] | None = None) -> DataFrame:
    """Value at the end of each slice, beginning with ``start.v``, or with ``default`` where ``start`` has none.

    The slices of a key and day are one row, of at most ``per_day`` functions, and one function together. Days are composed in
    a tree of rows of at most BLOCK functions; down the tree every block, and at last every day, gets the value it begins
    with. So no row grows with the calendar, and the days of a key are walked side by side. Columns ``carry`` stay with their
    slice. ``limits`` are the first and last slot, where they are known; slices of a single day need no tree and are not kept.
    """
    number = F.floor((F.col(slot) - 1) / per_day).cast("long").alias("_n")
    days = slices.groupBy(*keys, number).agg(F.array_sort(F.collect_list(F.struct(slot, *carry, "f"))).alias("fs"))
    if limits is None:
        days = kept(days)
        low, high = days.agg(F.min("_n"), F.max("_n")).first()
        low, span = low or 0, (high or 0) - (low or 0)
    else:
        low, span = ((x - 1) // per_day for x in limits)
        span -= low
        days = kept(days) if span else days

    def begun_with(rows: DataFrame) -> DataFrame:
        if start is None:
            return rows.withColumn("v", F.lit(default))
        joined = rows.join(start.select(*keys, "v"), keys, "inner" if default is None else "left")
        return joined if default is None else joined.withColumn("v", F.coalesce("v", F.lit(default)))

    level = days.select(*keys, (F.col("_n") - low).alias("_n"), compose(F.transform("fs", lambda x: x.f)).alias("f"))
    blocks: list[DataFrame] = []
    while span > 0:
        listed = F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), "f"))).alias("members")
        blocks.append(cut(level.groupBy(*keys, F.floor(F.col("_n") / BLOCK).cast("long").alias("_up")).agg(listed)))
        level = blocks[-1].select(*keys, F.col("_up").alias("_n"), compose(F.transform("members", lambda x: x.f)).alias("f"))
        span //= BLOCK
    begun = None
    for block in reversed(blocks):
        # At the top a key has one row.
        entered = begun_with(block) if begun is None else block.join(begun.withColumnRenamed("_n", "_up"), [*keys, "_up"])
        begun = entered.select(*keys, F.inline(_entries(F.col("v"), F.col("members"))))
    kinds = dict(slices.dtypes)
    kind = f"array<struct<{slot}:bigint,{''.join(f'{c}:{kinds[c]},' for c in carry)}v:double>>"
    walked = F.aggregate(
        "fs",
        F.struct(F.col("v").alias("v"), F.expr(f"cast(array() as {kind})").alias("out")),
        lambda acc, x: F.struct(
            apply(x.f, acc.v).alias("v"),
            F.concat(acc.out, F.array(F.struct(x[slot].alias(slot), *[x[c].alias(c) for c in carry], apply(x.f, acc.v).alias("v")))).alias("out"),
        ),
        lambda acc: acc.out,
    )
    entered = begun_with(days) if begun is None else days.withColumn("_n", F.col("_n") - low).join(begun, [*keys, "_n"])
    return entered.select(*keys, F.inline(walked))
