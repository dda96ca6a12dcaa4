"""Near-duplicate vectors by a pivot-permutation index.

Vectors whose cosine is ``THRESHOLD`` or more are linked; the components of the links are the groups.

1. Equal vectors are one node. Pivots, at most ``PIVOTS``, are taken from a bounded sample, no two of
   them nearer than ``APART``: a crowd of near copies holds one pivot, and the order of the others is
   the same for all of the crowd. A node is described by its nearest pivots. How many are taken is
   calibrated on vectors moved away from sampled ones to the threshold exactly, until ``RECALL`` of
   them share ``SHARED`` pivots with where they came from.
2. Inverted lists: a node is in the list of every pair of its nearest pivots, so nodes that meet share
   two pivots at least. A list longer than ``BLOCK`` is cut into chunks that meet two at a time. A pair
   counts in the list of its two least shared pivots only, so none counts twice.
3. First look: the lists carry one byte a component, with what that leaves out, so a pair's cosine is
   known within a bound. Nodes without a partner that may reach the threshold go no further.
4. Verification: the others meet again, in fewer and shorter lists, with their whole vectors. A block
   gives, for each node, how many vectors it is linked to, and a spanning forest of its links, not the links.
   Components of the forests follow.

Scale: the tables of step 2 and 3 are a small multiple of the vectors; the plan of chunks has a row
for each pair of pivots at most, and is broadcast. A crowd of n near copies costs n * n / 2 comparisons,
since all its links are counted, block by block over many tasks; at most one row per node and block is
written. Recall is measured in the tests and in the README; links found are verified in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; a vector links only with vectors of its own length; each row is a vector, so rows that are repeated
link with each other; the component of rows that all have a null id is null, and null ids never win
against others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkscrub.llm.common import cosines, shared
from sparkscrub.llm.near_dup import components

THRESHOLD = 0.95
SAMPLE, PIVOTS, APART = 20_000, 512, 0.7
SHARED, FEWEST, MOST = 2, 4, 12
RECALL = 0.99
BLOCK = 1024
ROWS = 256


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length one; norms of huge or tiny components stay finite."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fitted(m: np.ndarray, dim: int) -> np.ndarray:
    """Rows cut or filled up with zeros to a length."""
    return m[:, :dim] if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


@dataclass(frozen=True)
class Pivots:
    """Reference vectors of length one, and how many of them describe a vector."""

    at: np.ndarray
    take: int

    def describe(self, unit: np.ndarray, take: int = 0) -> np.ndarray:
        """The numbers of the nearest pivots of each row, nearest first; ties to the smaller number."""
        near = fitted(unit, self.at.shape[1]) @ self.at.T
        return np.argsort(-near, axis=1, kind="stable")[:, :take or self.take]


def choose_pivots(sample: np.ndarray, threshold: float = THRESHOLD, seed: int = 12) -> Pivots:
    """Sampled vectors that lie apart, and how many nearest ones to take, by what moved vectors share."""
    chosen = np.empty((0, sample.shape[1]))
    for row in sample:
        if len(chosen) < PIVOTS and (not len(chosen) or (chosen @ row).max() < APART):
            chosen = np.vstack([chosen, row])
    rng = np.random.default_rng(seed)
    here = sample[rng.permutation(len(sample))[:512]]
    away = rng.normal(size=here.shape)
    away -= (away * here).sum(axis=1, keepdims=True) * here
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    moved = threshold * here + np.sqrt(1 - threshold**2) * away
    most = min(MOST, len(chosen))
    index = Pivots(chosen, most)
    a, b = index.describe(here), index.describe(moved)
    for take in range(min(FEWEST, most), most):
        common = (a[:, :take, None] == b[:, None, :take]).sum(axis=(1, 2))
        if (common >= SHARED).mean() >= RECALL:
            return Pivots(chosen, take)
    return index


def _nodes(rows: DataFrame) -> DataFrame:
    """node, v, n (rows) and label (smallest id) of every distinct vector."""
    return rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("label"))


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v and node of every row; a vector that takes no part has no node."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    node = F.concat_ws(".", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))
    return rows.withColumn("node", F.when(F.col("v").isNotNull(), node))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of an Arrow column of lists, for each length that occurs."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    begins, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[begins[at][:, None] + np.arange(dim)]


def _described(nodes: DataFrame, pivots: Pivots) -> DataFrame:
    """node, n, dim, pivots (ascending), sketch, scale, rest and v."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                size = part.num_rows
                near, sketch, scale, rest, dims = np.empty((size, pivots.take), np.int32), [b""] * size, np.empty(size), np.empty(size), np.empty(size, np.int32)
                for at, m in _matrices(part.column(2)):
                    u = units(m)
                    near[at] = np.sort(pivots.describe(u), axis=1)
                    step = np.abs(u).max(axis=1) / 127
                    bytes_ = np.rint(u / step[:, None]).astype(np.int8)
                    scale[at], rest[at], dims[at] = step, np.linalg.norm(u - bytes_ * step[:, None], axis=1), m.shape[1]
                    for i, row in zip(at.tolist(), bytes_):
                        sketch[i] = row.tobytes()
                ends = pa.array(np.arange(0, size * pivots.take + 1, pivots.take, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(dims), pa.ListArray.from_arrays(ends, pa.array(near.ravel())),
                     pa.array(sketch, pa.binary()), pa.array(scale), pa.array(rest), part.column(2)],
                    names=["node", "n", "dim", "pivots", "sketch", "scale", "rest", "v"])

    return nodes.select("node", "n", "v").mapInArrow(
        run, "node string, n long, dim int, pivots array<int>, sketch binary, scale double, rest double, v array<double>")


def _lists(take: int) -> Column:
    """The numbers of the lists of a node: one for each pair of its pivots, or one for all if there is one pivot."""
    p = [F.col("pivots")[i].cast("long") for i in range(take)]
    return F.array(*[a * PIVOTS + b for a, b in itertools.combinations(p, SHARED)]) if take >= SHARED else F.array(F.lit(0).cast("long"))


def _meetings(listed: DataFrame, block: int) -> DataFrame:
    """The rows (list, node, ...) of every list with two nodes or more, in the blocks (list, lo, hi) where they meet."""
    counts = listed.groupBy("list").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    plan = F.broadcast(counts.select("list", F.ceil(F.col("members") / block).cast("int").alias("chunks")))  # a row per pair of pivots at most
    cut = listed.join(plan, "list").withColumn("chunk", F.pmod(F.xxhash64("list", "node"), F.col("chunks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("chunks", "other")
    return met.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi", "node")


def _blocks(batches) -> Iterator[pa.Table]:
    """The rows of each block of a partition sorted by (list, lo, hi)."""
    parts: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in ("list", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((np.diff(names) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(names[:, lo].tolist())
            if parts and now != key:
                yield pa.Table.from_batches(parts)
                parts = []
            key = now
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _pairs(block: pa.Table, similar: Callable[[np.ndarray, slice], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs of a block that count there: of both its chunks, of equal length, of which ``similar`` (places, rows -> a
    matrix of truth) holds and of which these are the least shared pivots."""
    near = np.array(block.column("pivots").to_pylist(), np.int32)
    list_, lo, hi = (block.column(c)[0].as_py() for c in ("list", "lo", "hi"))
    chunk, dim = block.column("chunk").to_numpy(), block.column("dim").to_numpy()
    last = list_ % PIVOTS if near.shape[1] >= SHARED else PIVOTS
    early = np.where(near < last, near, -1)
    for begin in range(0, len(near), ROWS):
        rows = slice(begin, min(begin + ROWS, len(near)))
        of = np.arange(rows.start, rows.stop)
        allowed = (dim[of][:, None] == dim) & (of[:, None] < np.arange(len(near)))
        if lo != hi:
            allowed &= chunk[of][:, None] != chunk
        if not allowed.any():
            continue
        i, j = np.nonzero(allowed & similar(of, rows))
        i += begin
        if near.shape[1] >= SHARED:  # of the pivots before the list's second one, they share the first only
            good = np.zeros(len(i), bool)
            for s in range(0, len(i), 65_536):
                a, b = early[i[s:s + 65_536]], early[j[s:s + 65_536]]
                good[s:s + 65_536] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).sum(axis=(1, 2)) == SHARED - 1
            i, j = i[good], j[good]
        yield i, j


def _by_dim(dim: np.ndarray, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One matrix for rows of different lengths, filled up with zeros."""
    out = np.zeros((len(dim), dim.max()))
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        out[at, :d] = rows_of(at)
    return out


def _first_look(meetings: DataFrame, threshold: float) -> DataFrame:
    """(list, node) of the nodes that may have a partner in a list."""
    def run(batches):
        for block in _blocks(batches):
            nodes, raw = block.column("node").to_pylist(), block.column("sketch").to_pylist()
            dim, rest = block.column("dim").to_numpy(), block.column("rest").to_numpy()
            m = _by_dim(dim, lambda at: np.array([np.frombuffer(raw[i], np.int8) for i in at])) * block.column("scale").to_numpy()[:, None]
            size = np.linalg.norm(m, axis=1)

            def similar(of, rows):
                most = m[rows] @ m.T + size[rows, None] * rest + rest[rows, None] * size + rest[rows, None] * rest
                return most >= threshold - 1e-9

            found = np.zeros(len(nodes), bool)
            for i, j in _pairs(block, similar):
                found[i] = found[j] = True
            at = np.flatnonzero(found).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([block.column("list")[0].as_py()] * len(at), pa.int64()), pa.array([nodes[i] for i in at], pa.string())],
                                             names=["list", "node"])

    return meetings.mapInArrow(run, "list long, node string").distinct()


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix of links connects."""
    waiting, links = linked.any(axis=1), []
    for start in np.flatnonzero(waiting).tolist():
        if not waiting[start]:
            continue
        waiting[start], ahead = False, [start]
        while ahead:
            x = ahead.pop()
            new = np.flatnonzero(linked[x] & waiting)
            waiting[new] = False
            links += [(x, y) for y in new.tolist()]
            ahead += new.tolist()
    return links


def _verified(meetings: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): with b, a link of a block's forest; without, so many vectors that a is linked to there."""
    def run(batches):
        for block in _blocks(batches):
            nodes, raw = block.column("node").to_pylist(), block.column("v").to_pylist()
            dim, weight = block.column("dim").to_numpy(), block.column("n").to_numpy()
            u = _by_dim(dim, lambda at: units(np.array([raw[i] for i in at])))

            def similar(of, rows):
                near = u[rows] @ u.T
                for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-9)):  # too close for the order in which products are added up
                    near[i, j] = cosines(np.array(raw[of[i]]), np.array([raw[j]]))[0] if dim[of[i]] == dim[j] else 0
                return near >= threshold

            count, linked = np.zeros(len(nodes), np.int64), np.zeros((len(nodes), len(nodes)), bool)
            for i, j in _pairs(block, similar):
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                linked[i, j] = linked[j, i] = True
            at, links = np.flatnonzero(count).tolist(), _forest(linked)
            yield pa.RecordBatch.from_arrays([
                pa.array([nodes[i] for i in at] + [nodes[i] for i, _ in links], pa.string()),
                pa.array([None] * len(at) + [nodes[j] for _, j in links], pa.string()),
                pa.array([int(count[i]) for i in at] + [0] * len(links), pa.int64())], names=["a", "b", "n"])

    return meetings.mapInArrow(run, "a string, b string, n long")


def _sample(nodes: DataFrame, dim: int) -> np.ndarray:
    """Unit vectors of at most ``SAMPLE`` nodes of a length, by hash."""
    rows = nodes.where(F.size("v") == dim).select("v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    return units(np.array([r["v"] for r in rows]))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    rows = shared(_rows(vectors, id_col, vector_col), "pivot-rows")
    nodes = shared(_nodes(rows), "pivot-nodes")
    lengths = nodes.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        alone = F.lit(0).cast("long")
        return rows.select(F.col("id").alias("vec_id"), alone.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = choose_pivots(_sample(nodes, lengths[0]["dim"]), threshold)
    described = shared(_described(nodes, pivots), "pivot-described")
    listed = described.select("node", "dim", "pivots", "sketch", "scale", "rest", F.explode(_lists(pivots.take)).alias("list"))
    asked = shared(_first_look(_meetings(listed, block), threshold), "pivot-asked")
    whole = shared(asked.join(described.select("node", "n", "dim", "pivots", "v").hint("merge"), "node"), "pivot-whole")
    links = shared(_verified(_meetings(whole, block), threshold), "pivot-links")
    labels = components(shared(links.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pivot-edges"))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    told = nodes.select("node", "n", "label").join(labels, "node", "left").join(counts, "node", "left").select(
        "node", "label", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    told = shared(told, "pivot-told")
    least = told.groupBy("component").agg(F.min("label").alias("component_id"))
    groups = shared(told.join(least, "component").select("node", "n_links", "component_id"), "pivot-groups")
    done = rows.select("id", "node").join(groups.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return done.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                       F.col("id").eqNullSafe(component).alias("kept"))
