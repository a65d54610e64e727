"""Near-duplicates by SimHash and a join of binary tries with themselves (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import as_bytes, lookup, parts, stored
from roadpulse.plans.components import connected_components

SHINGLE, SEED, BUDGET = 4, 42, 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of the blocks a fingerprint is cut into: one more than the budget, so that some block has no differing bit.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of one block value that a task joins at a time; larger groups are split into pairs of parts.
GROUP_ROWS = 50_000
#: Rows that a partition of the join should have.
PARTITION_ROWS = 200_000


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    """Majority bits of the XXH64 of all shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(list(map(len, words))) + np.arange(len(words))
        size = min(SHINGLE, len(words))
        starts = np.concatenate([[0], ends[: len(ends) - size] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        counts = np.zeros(64, np.int64)
        for low in range(0, len(hashes), 1 << 16):  # a long text's bits are counted in slices
            bits = np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str | Column) -> Column:
    """64-bit fingerprint as a long; 0 for a text without words and for null."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *map(_fingerprints, parts(texts))]).view(np.int64))

    return hashed(as_bytes(text))


def _rotations() -> list[tuple[int, list[int]]]:
    """For each block in front: bits to rotate left by, and the errors allowed after each bit.

    Some rotation of the blocks has no more than ``k - 1`` errors in its first ``k`` blocks, for every ``k`` at once: else
    the blocks would hold more errors together than the budget. So every link is found in one of the rotations.
    """
    found, shift = [], 0
    for front in range(len(BLOCKS)):
        allowed = []
        for k in range(len(BLOCKS)):
            allowed += [min(k, BUDGET)] * BLOCKS[(front + k) % len(BLOCKS)]
        found.append((shift, allowed))
        shift += BLOCKS[front]
    return found


ROTATIONS = _rotations()


class _Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            further = self.parent[up]
            if np.array_equal(up, further):
                return up
            self.parent[at] = further
            at = further

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            # Every root takes the smallest partner; the rest is linked in the next turn.
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _trie_join(values: np.ndarray, groups: np.ndarray, allowed: list[int], forest: _Forest) -> None:
    """Links positions whose values differ in at most BUDGET bits, within groups that share the bits of the first block.

    ``values`` are sorted inside ``groups``, so a node of the trie is a range of positions with a common prefix. Pairs of nodes
    go down together, one bit a level. A pair is dropped when its errors exceed what the level allows, or when all of both
    nodes already hang together; where the bits left cannot exceed the budget, all of both are linked at once. Budgets rise
    from 1 to BUDGET, so that close fingerprints hang together before distant pairs are tried.
    """
    size = len(values)
    for budget in range(1, BUDGET + 1):
        # Nodes of a level: starts of ranges. Level 0 are the groups.
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        left = right = np.arange(len(starts))
        errors = np.zeros(len(starts), np.int64)
        for depth in range(BLOCKS[0] - 1, 64):
            bit = (values >> np.uint64(63 - depth) & np.uint64(1)).astype(bool)
            opens = np.zeros(size, bool)
            opens[starts] = True
            opens[1:] |= bit[1:] != bit[:-1]
            below = np.flatnonzero(opens)
            # Children of a node: the first, and a second where the node holds both bits.
            first = np.searchsorted(below, starts)
            count = np.diff(np.append(first, len(below)))
            ones = bit[below]
            pairs = []
            for i in (0, 1):
                for j in (0, 1):
                    real = (count[left] > i) & (count[right] > j)
                    if i > j:  # a node with itself gives its two children once
                        real &= left != right
                    a, b = first[left[real]] + i, first[right[real]] + j
                    pairs.append((a, b, errors[real] + (ones[a] != ones[b])))
            left, right, errors = (np.concatenate(c) for c in zip(*pairs, strict=True))
            keep = errors <= min(budget, allowed[depth])
            left, right, errors, starts = left[keep], right[keep], errors[keep], below
            ends = np.append(starts[1:], size)
            # A node of one value has no pair with itself.
            keep = (left != right) | (ends[left] - starts[left] > 1)
            left, right, errors = left[keep], right[keep], errors[keep]
            if not len(left):
                break
            sure = errors + (63 - depth) <= min(budget, *allowed[depth:])
            if sure.any():
                a, b = left[sure], right[sure]
                for node in (a, b):  # all below a node hang on its first
                    lengths = ends[node] - starts[node]
                    own = np.repeat(starts[node], lengths)
                    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    forest.link(own, own + inside)
                forest.link(starts[a], starts[b])
                left, right, errors = left[~sure], right[~sure], errors[~sure]
            if len(left):
                roots = forest.roots(np.arange(size))
                low, high = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts)
                open_ = (low[left] != high[left]) | (low[right] != high[right]) | (low[left] != low[right])
                left, right, errors = left[open_], right[open_], errors[open_]


def _rotated(values: np.ndarray, shift: int) -> np.ndarray:
    return values if not shift else values << np.uint64(shift) | values >> np.uint64(64 - shift)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: a spanning forest of the links among the fingerprints of this partition's groups."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    turn, first, second, values = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("_turn", "_i", "_j", "fp"))
    del held
    values = values.view(np.uint64)
    for t, (shift, allowed) in enumerate(ROTATIONS):
        at = np.flatnonzero(turn == t)
        if len(at) < 2:
            continue
        turned = _rotated(values[at], shift)
        group = turned >> np.uint64(64 - BLOCKS[t])
        order = np.lexsort((turned, second[at], first[at], group))
        turned, i, j, group = turned[order], first[at][order], second[at][order], group[order]
        changes = (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        groups = np.concatenate([[0], np.cumsum(changes)])
        forest = _Forest(len(turned))
        _trie_join(turned, groups, allowed, forest)
        roots = forest.roots(np.arange(len(turned)))
        linked = np.flatnonzero(roots != np.arange(len(turned)))
        if len(linked):
            fps = values[at][order].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[roots[linked]])], names=["a", "b"])


def links(fingerprints: DataFrame) -> DataFrame:
    """``a, b`` whose components are those of all pairs of distinct ``fp`` that differ in at most BUDGET bits.

    Each fingerprint goes to one group per rotation, by the value of the block in front, which a link found in that rotation
    shares. A group over GROUP_ROWS rows is cut into parts and joined pair of parts by pair of parts, so no task holds more
    than two parts of one group. A task returns a tree a component, never its pairs.
    """
    spark = fingerprints.sparkSession
    turns = F.explode(F.array(*[
        F.struct(F.lit(t).alias("_turn"), F.shiftrightunsigned(_left(F.col("fp"), shift), 64 - BLOCKS[t]).alias("_block"))
        for t, (shift, _) in enumerate(ROTATIONS)])).alias("_t")
    dealt = fingerprints.select("fp", turns).select("fp", "_t.*")
    # One row a block value at most, 5 * 2 ** 13.
    large = dealt.groupBy("_turn", "_block").count().where(F.col("count") > GROUP_ROWS).select(
        "_turn", "_block", F.ceil(F.col("count") / (GROUP_ROWS / 2)).cast("int").alias("_parts"))
    placed = dealt.join(F.broadcast(large), ["_turn", "_block"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    split = placed.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        "fp", "_turn", "_block", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    rows = fingerprints.count() * len(ROTATIONS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PARTITION_ROWS + 1)
    return split.repartition(tasks, "_turn", "_block", "_i", "_j").select("_turn", "_i", "_j", "fp").mapInArrow(_joined, "a long, b long")


def _left(value: Column, bits: int) -> Column:
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, group, component_id`` of every document; the component is the smallest id that links reach.

    ``group`` is the component's smallest fingerprint, which tells components apart whatever their ids. Links are sought
    among distinct fingerprints, so copies cost nothing. Texts without words share fingerprint 0, as do nulls. Null ids are
    kept and never name a component, unless it holds no other (then it is null). Repeated rows get the same component;
    other columns are ignored; an empty table gives an empty result.
    """
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp")), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("_least")), "distinct-fingerprints")
    return labelled(marked, distinct, stored(links(distinct.select("fp")).distinct(), "fingerprint-links"))


def labelled(marked: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, fp, group, component_id`` from ``marked(doc_id, fp)``, ``distinct(fp, _least)`` and ``edges(a, b)``, all stored."""
    members = stored(connected_components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges), "fingerprint-components")
    # Only fingerprints with a link are looked up; the others are their own component.
    linked = members.join(distinct, members["node"] == distinct["fp"]).select("fp", F.col("component").alias("_group"), "_least")
    smallest = linked.groupBy("_group").agg(F.min("_least").alias("_component"))
    named = stored(lookup(stored(linked.select("fp", "_group"), "linked-fingerprints"), smallest, "_group").select("fp", "_group", "_component"), "named-fingerprints")
    labels = distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("_group", "fp").alias("group"), F.when(F.col("_group").isNull(), F.col("_least")).otherwise(F.col("_component")).alias("component_id"))
    return lookup(marked, labels, "fp").select("doc_id", "fp", "group", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 lower-case hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rule=None) -> DataFrame:
    """One document of each component, with all its columns: the one that names it.

    ``rule`` is a module with ``components`` and ``fingerprint``; without one, this one's rule of few differing bits holds.

    Rows that share an id, and rows without one, are told apart by their fingerprints: of those that name their component
    one stays, the first by text; so does one where a component has no id at all. Null and empty texts are one component.
    Other columns are kept whatever their names; an empty table gives an empty result.
    """
    grouped, marked = (rule.components, rule.fingerprint) if rule else (components, fingerprint)
    found = stored(grouped(docs, text, doc_id), "near-copies")
    counts = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("_copy"))
    side = next(n for n in (f"_other{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    repeated = stored(counts.where("_n > 1").select(F.col("doc_id").alias(side)), "repeated-ids")
    other = counts.where("_n > 1 OR _copy").select(F.col("doc_id").alias(side))
    key = F.col(doc_id)
    plain = docs.where(key.isNotNull()).join(other, key == F.col(side), "left_anti")
    unclear = docs.where(key.isNull()).unionByName(docs.join(repeated, key == F.col(side), "left_semi"))
    # Few rows in sound data; copies are put together before they are shuffled.
    packed = unclear.select(F.struct("*").alias("_doc"), key.alias("_id"), marked(text).alias("_fp"), F.struct(F.col(text), F.xxhash64(*docs.columns)).alias("_rank"))
    first = packed.groupBy("_id", "_fp").agg(F.min("_rank").alias("_best"), F.min_by("_doc", "_rank").alias("_doc"))
    groups = found.select(F.col("fp").alias("_fp"), F.col("group").alias("_group"), F.col("component_id").alias("_component")).distinct()
    named = first.join(groups, "_fp").where(F.col("_component").isNull() | F.col("_id").eqNullSafe(F.col("_component")))
    chosen = named.groupBy("_id", "_group").agg(F.min_by("_doc", "_best").alias("_doc"))
    return plain.unionByName(chosen.select("_doc.*"))
