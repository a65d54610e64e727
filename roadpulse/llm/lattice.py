"""Near copies among embeddings by hashing random projections to E8 lattice points (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import lookup, stored
from roadpulse.llm.simhash import _Forest
from roadpulse.plans.components import connected_components

#: Vectors of one cell that a task compares at a time; larger cells are split into pairs of parts.
GROUP_ROWS = 4096
#: A cell counts as large only beyond this share of all entries, which bounds the table of large cells that is broadcast.
LARGE_CELLS = 1_000_000
PARTITION_ROWS = 50_000
#: Rows of a part compared with the others at once.
SLICE = 256
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Lattice:
    """Search settings.

    A coordinate of a projection is ``width`` times a standard normal number for a random unit vector, whatever the
    dimension, so ``width`` sets how many cells there are. Every vector lies in its own cell of each table and in the
    ``probes`` neighbouring cells whose points are next to it. With the defaults a pair at cosine 0.93 is proposed with
    probability 0.98, one at 0.95 with 0.995, an unrelated pair with 0.04.
    """

    least: float = 0.93
    tables: int = 3
    probes: int = 2
    width: float = 0.5
    seed: int = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice: two entries of one, or all halves with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in enumerate(pairs):
        whole[row, [i, j]] = a, b
    halves = np.array([s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, halves])


_ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum: where rounding gives an odd one, the worst coordinate goes the other way."""
    near = np.rint(x)
    rest = x - near
    worst, row = np.abs(rest).argmax(axis=1), np.arange(len(x))
    step = np.where(rest[row, worst] >= 0, 1.0, -1.0)
    near[row, worst] += np.where(near.sum(axis=1) % 2 != 0, step, 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the even whole points and those shifted by a half; of two the whole one."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _hashed(points: np.ndarray, table: int) -> np.ndarray:
    whole = (2 * points).astype(np.int64).view(np.uint64)
    out = np.full(points.shape[:-1], table + 1, np.uint64) * _MIX
    for k in range(8):
        out = (out ^ whole[..., k]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def cells(vectors: np.ndarray, lattice: Lattice) -> np.ndarray:
    """``[table, vector, 0]`` is a vector's own cell, the further ones those it probes.

    Exact from the rounded direction on, so a vector has the same cells in whatever batch: directions are whole numbers,
    projections are sums of whole numbers, coordinates multiples of 2 ** -20.
    """
    direction = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 2.0**15)
    length = np.sqrt((direction * direction).sum(axis=1))
    out = np.zeros((lattice.tables, len(vectors), 1 + lattice.probes), np.uint64)
    for table in range(lattice.tables):
        normal = np.random.default_rng([lattice.seed, table, vectors.shape[1]]).standard_normal((vectors.shape[1], 8))
        x = direction @ np.rint(normal * 1024) * (lattice.width / 1024) / length[:, None]
        x = np.rint(x * 2.0**20) / 2.0**20
        point = decode(x)
        near = (x - point) @ _ROOTS.T
        order = np.argsort(-near, axis=1, kind="stable")[:, : lattice.probes]
        out[table] = _hashed(np.concatenate([point[:, None, :], point[:, None, :] + _ROOTS[order]], axis=1), table)
    return out


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each dimension and their vectors as doubles."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _placed(lattice: Lattice, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task function: one row a vector and cell, with the vector if ``carried``."""
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                for rows, vectors in _matrices(part.column("_vector")):
                    found = cells(vectors, lattice)
                    table, row, probe = (x.reshape(-1) for x in np.indices(found.shape))
                    columns = {"_cell": pa.array(found.reshape(-1).view(np.int64)), "_dim": pa.array(np.full(found.size, vectors.shape[1], np.int32))}
                    source = part.take(pa.array(rows[row]))
                    names = ["_label", "_node", "_copies", "_vector"] if carried else ["_label"]
                    columns |= {n: source.column(n) for n in names}
                    if carried:
                        columns |= {"_table": pa.array(table.astype(np.int32)), "_probe": pa.array(probe > 0)}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _found(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a table proposes each pair, from the cells of both."""
    return (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)


class _Group:
    """The vectors of one cell, or of two parts of a large one."""

    def __init__(self, vectors: np.ndarray, table: int, probe: np.ndarray, node: np.ndarray, copies: np.ndarray, lattice: Lattice):
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.vectors, self.table, self.probe, self.node, self.copies, self.lattice = vectors, table, probe, node, copies, lattice
        self.links, self.forest, self.cells = np.zeros(len(vectors), np.int64), _Forest(len(vectors)), None

    def compare(self, left: np.ndarray, right: np.ndarray, cell: np.uint64) -> None:
        """Links pairs of a left and a right position that no earlier table and no other cell of this table has."""
        for low in range(0, len(left), SLICE):
            rows = left[low : low + SLICE]
            near = self.unit[rows] @ self.unit[right].T >= self.lattice.least
            near &= ~(self.probe[rows][:, None] & self.probe[right][None, :])
            a, b = np.nonzero(near)
            a, b = rows[a], right[b]
            keep = self.node[a] != self.node[b]
            if left is right:
                keep &= a < b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if self.cells is None:
                self.cells = cells(self.vectors, self.lattice)
            for table in range(self.table):
                new = ~_found(self.cells[table][a], self.cells[table][b])
                a, b = a[new], b[new]
            # Where each probes the cell of the other, the smaller cell has the pair.
            x, y = self.cells[self.table][a], self.cells[self.table][b]
            both = (x == y[:, :1]).any(axis=1) & (y == x[:, :1]).any(axis=1)
            keep = ~both | (np.minimum(x[:, 0], y[:, 0]) == cell)
            a, b = a[keep], b[keep]
            size = len(self.links)
            self.links += np.bincount(a, self.copies[b], size).astype(np.int64) + np.bincount(b, self.copies[a], size).astype(np.int64)
            self.forest.link(a, b)


def _compared(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task function: of each vector with links in a cell, a vector it hangs together with and its number of new links."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        plain = {c: table.column(c).to_numpy() for c in ("_cell", "_dim", "_table", "_i", "_j", "_own", "_probe", "_copies")}
        label, node = (table.column(c).combine_chunks().dictionary_encode() for c in ("_label", "_node"))
        node, names = node.indices.to_numpy(), node.dictionary
        keys = [plain["_j"], plain["_i"], plain["_cell"], plain["_table"], plain["_dim"], label.indices.to_numpy()]
        order = np.lexsort(keys)
        opens = np.zeros(len(order), bool)
        opens[0] = True
        for key in keys:
            opens[1:] |= key[order][1:] != key[order][:-1]
        edges = np.append(np.flatnonzero(opens), len(order))
        vectors = table.column("_vector")
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            rows = order[start:end]
            if len(rows) < 2 or plain["_probe"][rows].all():
                continue
            group = _Group(next(_matrices(vectors.take(pa.array(rows))))[1], plain["_table"][rows[0]], plain["_probe"][rows], node[rows], plain["_copies"][rows], lattice)
            cell = plain["_cell"][rows[:1]].view(np.uint64)[0]
            own, (i, j) = plain["_own"][rows], (plain["_i"][rows[0]], plain["_j"][rows[0]])
            if i == j:
                every = np.arange(len(rows))
                group.compare(every, every, cell)
            else:
                group.compare(np.flatnonzero(own == i), np.flatnonzero(own == j), cell)
            linked = np.flatnonzero(group.links)
            if len(linked):
                roots = group.forest.roots(linked)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(group.node[linked])), names.take(pa.array(group.node[roots])), pa.array(group.links[linked])], names=["a", "b", "n"])

    return run


def links(vectors: DataFrame, lattice: Lattice) -> DataFrame:
    """``a, b, n`` from distinct ``_node, _label, _copies, _vector``, which must be stored.

    ``n`` summed over ``a`` counts the rows that ``a`` links with, and ``a, b`` hang together as all links do. A pair is
    counted by the first table that proposes it, in one cell, so no pair leaves its task and none is counted twice. A cell
    over GROUP_ROWS vectors is cut into parts and compared pair of parts by pair of parts.
    """
    spark = vectors.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    sizes = vectors.select("_label", "_vector").mapInArrow(_placed(lattice, False), f"_cell long, _dim int, _label {kind['_label']}")
    rows = vectors.count() * lattice.tables * (1 + lattice.probes)
    key = ["_label", "_dim", "_cell"]
    # Fewer than LARGE_CELLS rows: each stands for over 1 / LARGE_CELLS of the entries.
    large = sizes.groupBy(*key).count().where(F.col("count") > max(GROUP_ROWS, rows // LARGE_CELLS)).select(
        *key, F.ceil(F.col("count") / (GROUP_ROWS / 2)).cast("int").alias("_parts"))
    entries = vectors.select("_label", "_node", "_copies", "_vector").mapInArrow(
        _placed(lattice, True), f"_cell long, _dim int, _label {kind['_label']}, _node binary, _copies long, _vector {kind['_vector']}, _table int, _probe boolean")
    placed = entries.join(F.broadcast(large), key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    split = placed.withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = split.select("*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")).drop("_other", "_parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PARTITION_ROWS + 1)
    return dealt.repartition(tasks, *key, "_i", "_j").mapInArrow(_compared(lattice), "a binary, b binary, n long")


def _usable(vector: Column, label: Column) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & sound & F.exists(numbers, lambda x: x != 0), F.lit(False))


def near_copies(vectors: DataFrame, lattice: Lattice = Lattice(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:  # noqa: B008
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors of one label and dimension link when their cosine in doubles is ``lattice.least`` or more and some table
    proposes the pair; none below it link. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id that links reach, ``kept`` says whether that is the row's own. Equal vectors of a label are compared once,
    as one with a number of copies. Null labels, and vectors that are null, empty, zero or hold a null, NaN or infinite component, link with nothing.
    Rows without id count as others, are never kept and name no component (null where a component has no id). Repeated rows
    link with each other. Other columns are ignored; an empty table gives an empty result.
    """
    usable = _usable(F.col(embedding), F.col(label))
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(label, embedding), F.xxhash64(F.lit(1), label, embedding))]
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, F.unhex(F.concat(*halves))).alias("_node"), F.col(label).alias("_label"), F.col(embedding).alias("_vector"))
    distinct = stored(named.where(F.col("_node").isNotNull()).groupBy("_node").agg(
        F.min("vec_id").alias("_least"), F.count(F.lit(1)).alias("_copies"), F.first("_label").alias("_label"), F.first("_vector").alias("_vector")), "distinct-vectors")
    found = stored(links(distinct, lattice), "lattice-links")
    edges = found.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    linked = found.groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_links"))
    members = stored(connected_components(linked.select(F.col("_node").alias("node")), edges), "lattice-components")
    with_id = members.join(distinct.select(F.col("_node").alias("node"), "_least"), "node")
    smallest = with_id.groupBy("component").agg(F.min("_least").alias("_component"))
    component = lookup(stored(with_id, "lattice-members"), smallest, "component").select(F.col("node").alias("_node"), "_component")
    about = distinct.select("_node", "_least", "_copies").join(linked, "_node", "left").join(component, "_node", "left")
    told = about.select("_node", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"),
                        F.when(F.col("_links").isNull(), F.col("_least")).otherwise(F.col("_component")).alias("component_id"))
    narrow = stored(named.select("vec_id", "_node"), "vector-nodes")
    single = narrow.where(F.col("_node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = lookup(narrow.where(F.col("_node").isNotNull()), told, "_node").select("vec_id", "n_links", "component_id").unionByName(single)
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
