"""Near-duplicates by the exact Jaccard similarity of word shingles (the pipeline's stage).

MinHash bands bring sets together that may be similar; inside what hangs together an exact join decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import as_bytes, id_filter, lookup, parts, ragged, stored
from roadpulse.llm.simhash import _Forest, labelled
from roadpulse.plans.components import connected_components

#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 5
#: Pairs are linked from this similarity on: 8 of 10 shingles of both together.
LEAST, OF = 8, 10
#: A pair of similarity s agrees in some band with probability 1 - (1 - s ** ROWS) ** BANDS, 0.9993 at 0.8.
BANDS, ROWS = 24, 6
#: Shingles of the sets that a task joins at a time; larger groups are split into pairs of parts.
GROUP_SHINGLES = 2_000_000
#: A group counts as large only beyond this share of all shingles, which bounds the table of large groups that is broadcast.
LARGE_GROUPS = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
PARTITION_SHINGLES = 4_000_000


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * _ODD
    return (values ^ values >> np.uint64(29)) * _MIX


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the shingles of all texts, sorted inside a text, and where each text begins (and the end)."""
    words = [t.translate(_LOWER).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    rows, starts = ragged(counts), np.concatenate([[0], np.cumsum(counts)])
    inside = np.arange(len(hashes)) - starts[rows]
    # A shingle begins at every word that has enough after it, and at the first word of a short text.
    begins = np.flatnonzero((inside + SHINGLE <= counts[rows]) | (inside == 0))
    owners = rows[begins]
    sums = np.zeros(len(begins), np.uint64)
    for step in range(SHINGLE):
        there = inside[begins] + step < counts[owners]
        sums = sums * _MIX + np.where(there, hashes[np.minimum(begins + step, len(hashes) - 1)], np.uint64(0))
    sums = _mixed(sums)
    order = np.lexsort((sums, owners))
    sums, owners = sums[order], owners[order]
    new = np.ones(len(sums), bool)
    new[1:] = (sums[1:] != sums[:-1]) | (owners[1:] != owners[:-1])
    sums, owners = sums[new], owners[new]
    return sums, np.searchsorted(owners, np.arange(len(texts) + 1))


def _digests(sums: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One number a set; 0 for the empty one."""
    return np.fromiter((xxhash.xxh64_intdigest(sums[a:b].tobytes()) if b > a else 0 for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.uint64, len(cuts) - 1)


def _bands(sums: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One key a band and non-empty set."""
    full = cuts[:-1][np.diff(cuts) > 0]
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(full), axis=1)
    if len(full):
        short = (sums >> np.uint64(32)).astype(np.uint32)
        for i, (factor, mask) in enumerate(zip(_FACTORS, _MASKS, strict=True)):
            turned = (short ^ mask) * factor
            least = np.minimum.reduceat(turned ^ turned >> np.uint32(15), full)
            keys[i // ROWS] = _mixed(keys[i // ROWS] * _ODD + least)
    return keys.T


def fingerprint(text: str | Column) -> Column:
    """Digest of a text's set of shingles as a long; 0 for a text without words and for null."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *[_digests(*_sets(part)) for part in parts(texts)]]).view(np.int64))

    return hashed(as_bytes(text))


def sketch(text: Column) -> Column:
    """Digest of a text's set of shingles, its size, and a key a band (none without words)."""

    @F.arrow_udf("struct<fp:long,n:int,bands:array<long>>")
    def sketched(texts: pa.Array) -> pa.Array:
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64))]
        for part in parts(texts):
            sums, cuts = _sets(part)
            out.append((_digests(sums, cuts), np.diff(cuts), _bands(sums, cuts)))
        prints, sizes, keys = (np.concatenate(c) for c in zip(*out, strict=True))
        ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(prints.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(
            pa.array(ends), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))], names=["fp", "n", "bands"])

    return sketched(as_bytes(text))


def _content(text: Column) -> Column:
    @F.arrow_udf("binary")
    def content(texts: pa.Array) -> pa.Array:
        out = []
        for part in parts(texts):
            sums, cuts = _sets(part)
            out += [sums[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array(out, pa.binary())

    return content(as_bytes(text))


def similar_pairs(sets: list[np.ndarray], own: np.ndarray | None = None) -> _Forest:
    """Positions of sorted sets that hang together by a Jaccard similarity of LEAST / OF or more; exact.

    Elements are ordered by how many sets hold them. Two similar sets share one among the first ``n - ceil(n * LEAST / OF) + 1``
    of both, and from the first one they share the rest of both must suffice for the overlap. What passes is counted in full,
    unless both hang together already. With ``own``, only sets of different parts are compared.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    forest = _Forest(len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[ids], owner))
    ids = rank[ids][order]
    place = np.arange(len(ids)) - starts[owner]
    first = place < (sizes + (-LEAST * sizes) // OF + 1)[owner]  # -(-n * LEAST // OF) rounds up
    lists = np.lexsort((owner[first], ids[first]))
    token, held, spot = ids[first][lists], owner[first][lists], place[first][lists]
    begins = np.searchsorted(token, np.arange(len(counts) + 1))
    # Where a set stands in the list of each of its first elements: those before it are the sets with smaller numbers.
    stands = np.empty(len(lists), np.int64)
    stands[lists] = np.arange(len(lists))
    of = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(sets)))])
    mark = np.zeros(len(counts), np.int64)
    for a in range(1, len(sets)):
        mine = stands[of[a] : of[a + 1]]
        low = begins[token[mine]]
        lengths = mine - low
        total = int(lengths.sum())
        if not total:
            continue
        at = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(total)
        others, seen = np.unique(held[at], return_index=True)
        # Elements come in their order, so the first sight of another set is the first element both share.
        rest = np.minimum(sizes[a] - np.repeat(spot[mine], lengths)[seen], sizes[others] - spot[at[seen]])
        fits = (OF + LEAST) * rest >= LEAST * (sizes[a] + sizes[others])
        if own is not None:
            fits &= own[others] != own[a]
        others = others[fits]
        if len(others):
            others = others[forest.roots(others) != forest.roots(np.array([a]))[0]]
        if not len(others):
            continue
        mark[ids[starts[a] : starts[a + 1]]] = 1
        lengths = sizes[others]
        at = np.repeat(starts[others] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.add.reduceat(mark[ids[at]], np.cumsum(lengths) - lengths)
        mark[ids[starts[a] : starts[a + 1]]] = 0
        alike = others[OF * both >= LEAST * (sizes[a] + lengths - both)]
        forest.link(np.full(len(alike), a), alike)
    return forest


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: of each set that is similar to others of its group, one that it hangs together with."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    group, fp, i, j, own = (table.column(c).to_numpy() for c in ("_group", "fp", "_i", "_j", "_own"))
    order = np.lexsort((fp, j, i, group))
    opens = np.ones(len(order), bool)
    for n, key in enumerate((group, i, j)):
        changed = key[order][1:] != key[order][:-1]
        opens[1:] = changed if n == 0 else opens[1:] | changed
    edges = np.append(np.flatnonzero(opens), len(order))
    contents = table.column("_set")
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        rows = order[start:end]
        if len(rows) < 2:
            continue
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in contents.take(pa.array(rows))]
        roots = similar_pairs(sets, own[rows] if i[rows[0]] != j[rows[0]] else None).roots(np.arange(len(rows)))
        linked = np.flatnonzero(roots != np.arange(len(rows)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows[linked]]), pa.array(fp[rows[roots[linked]]])], names=["a", "b"])


def groups(sets: DataFrame) -> DataFrame:
    """``fp, _group`` of the stored ``fp, bands`` that share a band with another set, directly or through others.

    Only fingerprints are shuffled. Every pair that shares a band is in one group, however many sets share it.
    """
    keys = stored(sets.select(F.explode("bands").alias("key"), "fp"), "band-keys")
    shared = keys.groupBy("key").agg(F.min("fp").alias("_first"), F.max("fp").alias("_last")).where("_first <> _last").select("key", "_first")
    met = lookup(keys, shared, "key").where(F.col("_first").isNotNull()).select(F.col("fp").alias("a"), F.col("_first").alias("b")).distinct()
    edges = stored(met, "band-edges")
    nodes = edges.select(F.col("a").alias("node")).distinct()  # the first of a band is among them
    return connected_components(nodes, edges.where("a <> b")).select(F.col("node").alias("fp"), F.col("component").alias("_group"))


def links(docs: DataFrame, sets: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``a, b`` that hang together as all pairs of sets with a band in common and a similarity of LEAST / OF or more do.

    ``sets`` is the stored ``fp, _least, n, bands`` of the distinct sets. Only the texts of one document of each set in a
    group are read again and sent, as sets of hashes. A group over GROUP_SHINGLES is cut into parts and joined pair of parts
    by pair of parts.
    """
    spark = docs.sparkSession
    grouped = stored(groups(sets.select("fp", "bands")), "shingle-groups")
    wanted = stored(grouped.join(sets.select("fp", "_least", "n"), "fp"), "grouped-sets")
    total, many = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    key = F.col("_id")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # The document with the least id stands for its set; of sets without any id all documents are looked at.
    found = rows.where(key.isNull() | id_filter(wanted.select(F.col("_least").alias("_id")), "_id", many))
    bodies = found.select(key, "_text", fingerprint("_text").alias("fp")).join(wanted, "fp").where(F.col("_least").eqNullSafe(key))
    content = bodies.groupBy("fp", "_group").agg(F.min("_text").alias("_text")).select("fp", "_group", _content(F.col("_text")).alias("_set"))
    # Fewer than LARGE_GROUPS rows: each stands for over 1 / LARGE_GROUPS of the shingles.
    large = wanted.groupBy("_group").agg(F.sum("n").alias("_size")).where(F.col("_size") > max(GROUP_SHINGLES, total // LARGE_GROUPS)).select(
        "_group", F.ceil(F.col("_size") / (GROUP_SHINGLES / 2)).cast("int").alias("_parts"))
    placed = content.join(F.broadcast(large), "_group", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    split = placed.withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = split.select("_group", "fp", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_set")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_SHINGLES + 1)
    return dealt.repartition(tasks, "_group", "_i", "_j").mapInArrow(_joined, "a long, b long")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, group, component_id`` as ``simhash.components`` gives them, linked by shingles instead of bits.

    Texts with the same set of shingles are one node, so copies cost nothing; texts without words, and nulls, are one too.
    Null ids are kept and never name a component, unless it holds no other. Repeated rows get the same component, texts are
    taken whole, other columns are ignored, an empty table gives an empty result.
    """
    sketched = stored(docs.select(F.col(doc_id).alias("doc_id"), sketch(F.col(text)).alias("_s")).select("doc_id", "_s.*"), "shingle-sketches")
    distinct = stored(sketched.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct-sketches")
    edges = stored(links(docs, distinct, text, doc_id), "shingle-links")
    return labelled(sketched.select("doc_id", "fp"), distinct.select("fp", "_least"), edges)
