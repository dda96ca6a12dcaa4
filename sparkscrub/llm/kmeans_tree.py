"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver to a sample of at most ``SAMPLE`` vectors (spherical k-means,
``BRANCHES`` children a node, until a leaf has ``LEAF`` sample vectors or fewer); every vector of the
table is then dealt to its leaf. A query walks the tree through a priority queue, always opening the
node whose centre is nearest, until it has reached so many leaves; that number is widened until the
recall against brute force, over a sample of at most ``CALIBRATION`` queries, reaches the target.

Scale: equal vectors are one entry with their few smallest ids (no more than the answer can use), so
a vector that fills a third of the table is one row. What a query visits are (leaf, chunk) blocks:
leaves are cut into chunks of ``CHUNK`` entries and the queries at a leaf into blocks of ``BLOCK``,
so each group that is compared has a bound on both sides. A block returns each query's best few - all
that rounding might put among them are scored exactly - and a window with a rank limit merges them. The brute force for calibration is a fixed set of queries
against all rows, block by block. The tree's size is bounded by the sample.

Scores are cosines of the original vectors in double precision: the sum of products over the product
of the norms, in one fixed order of summation. Ties go to the smaller id.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; with fewer candidates than asked all are returned; an id with several vectors
is one candidate, and one query, by the best of its scores; null ids take no part; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkscrub.llm.common import cosines, shared

SAMPLE = 20_000
BRANCHES = 8
LEAF = 160
CHUNK, BLOCK = 16_384, 16_384
#: Queries that are held against a chunk at once, and what rounding may add to a cosine.
TILE, ROUNDING = 256, 1e-9
CALIBRATION = 128
TARGET_RECALL = 0.97


@dataclass
class Tree:
    """Nodes by number: centre (unit length), children, and the number of the leaf (-1 inside)."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest child, level by level."""
        out = np.zeros(len(units), np.int32)
        stack = [(0, np.arange(len(units)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            nearest = np.argmax(units[rows] @ self.centres[kids].T, axis=1)
            stack += [(kid, rows[nearest == j]) for j, kid in enumerate(kids)]
        return out

    def best_bins(self, unit: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves that a best-bin-first walk reaches."""
        near = self.centres @ unit
        queue, found = [(-1.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
            else:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-float(near[kid]), kid))
        return found


def _k_means(units: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Group of each unit vector after spherical k-means, seeded far apart."""
    centres = [units[rng.integers(len(units))]]
    gap = 1 - units @ centres[0]
    while len(centres) < k:
        weight = np.maximum(gap, 0) ** 2
        if weight.sum() <= 1e-12:
            break
        centres.append(units[rng.choice(len(units), p=weight / weight.sum())])
        gap = np.minimum(gap, 1 - units @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        group = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return np.argmax(units @ centres.T, axis=1)


def fit_tree(units: np.ndarray, leaf_rows: int = LEAF, branches: int = BRANCHES, seed: int = 3) -> Tree:
    """A tree over a sample of unit vectors; a single leaf if there are few."""
    rng = np.random.default_rng(seed)
    dim = units.shape[1] if len(units) else 1
    centres, children, leaf, leaves = [np.zeros(dim)], [[]], [-1], 0
    stack = [(0, np.arange(len(units)))]
    while stack:
        node, rows = stack.pop()
        group = _k_means(units[rows], branches, rng) if len(rows) > leaf_rows else None
        if group is None or len(np.unique(group)) == 1:
            leaf[node], leaves = leaves, leaves + 1
            continue
        for g in np.unique(group):
            part = rows[group == g]
            centre = units[part].sum(axis=0)
            norm = np.linalg.norm(centre)
            centres.append(centre / norm if norm > 0 else units[part[0]])
            children.append([])
            leaf.append(-1)
            children[node].append(len(centres) - 1)
            stack.append((len(centres) - 1, part))
    return Tree(np.array(centres), children, leaf)


def _matrix(values) -> np.ndarray:
    return np.array(list(values), dtype=np.float64).reshape(len(values), -1)


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # norms of huge or tiny components stay finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double) and its 128-bit key, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


@dataclass
class Index:
    tree: Tree
    entries: DataFrame  # leaf, chunk, uid, v, ids
    chunks: dict[int, int]  # leaf -> number of chunks


def build_index(vectors: DataFrame, k: int, sample: int = SAMPLE) -> Index:
    """Every distinct vector in its leaf, with its 2k + 2 smallest ids; ``vectors`` as from valid_vectors."""
    few = Window.partitionBy("h1", "h2").orderBy("id")  # up to k of an entry's ids may be told by nearer ones, and one be the query's
    ranked = vectors.dropDuplicates(["id", "h1", "h2"]).withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= 2 * k + 2)
    entries = shared(ranked.groupBy("h1", "h2").agg(F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")),
                     "knn-entries")
    n = entries.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = entries.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else entries
    rows = drawn.select("v").orderBy("h2").limit(sample).collect()
    tree = fit_tree(_units(_matrix([r["v"] for r in rows])) if rows else np.zeros((0, 1)))

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(_units(_matrix(batch.column(0).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.columns], names=["leaf", "v", "ids"])

    dealt = entries.select("v", "ids").mapInArrow(deal, "leaf int, v array<double>, ids array<long>")
    dealt = shared(dealt.withColumn("uid", F.col("ids")[0]), "knn-leaves")
    sizes = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # bounded by the sample
    return Index(tree, dealt, {leaf: -(-c // CHUNK) for leaf, c in sizes.items()})


def _best(queries: np.ndarray, members: np.ndarray, uids: np.ndarray, ids: list, k: int, own: list | None = None):
    """(query, member, score) of the nearest members of each query, by exact scores: as many as it takes to name k + 1 ids.

    ``own`` holds an id for each query; members that have no other are left out."""
    units = _units(members)
    for lo in range(0, len(queries), TILE):
        rough = _units(queries[lo:lo + TILE]) @ units.T
        for i, near in enumerate(rough):
            q, take = lo + i, min(4 * (k + 2), len(uids))
            while True:  # what may be among the first, by the rough score, is scored exactly
                least = np.partition(near, len(near) - take)[len(near) - take]
                at = np.flatnonzero(near >= least - ROUNDING)
                score = cosines(queries[q], members[at])
                named, found = set(), []
                for j in np.lexsort((uids[at], -score)):
                    if len(named) > k and (score[j] < found[-1][2] or sum(s == score[j] for _, _, s in found) > k):
                        break  # of equal scores the smaller ids come first
                    fresh = set(ids[at[j]])
                    if own is not None and fresh == {own[q]} or fresh <= named:
                        continue
                    named |= fresh
                    found.append((q, int(at[j]), float(score[j])))
                if len(named) > k or len(at) == len(near):
                    break
                take = min(4 * take, len(near))
            yield from found


def _exact(index: Index, own: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """Brute force of a fixed set of queries against all entries: q, uid, score, leaf of the k best that are not the query's."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            uids, ids, leaves = (batch.column(i).to_pylist() for i in (0, 3, 2))
            got = list(_best(queries, _matrix(batch.column(1).to_pylist()), np.array(uids), ids, k, own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, _, _ in got], pa.int64()), pa.array([uids[j] for _, j, _ in got], pa.int64()),
                 pa.array([s for _, _, s in got], pa.float64()), pa.array([leaves[j] for _, j, _ in got], pa.int32())], names=["q", "uid", "score", "leaf"])

    found = index.entries.select("uid", "v", "leaf", "ids").mapInArrow(run, "q long, uid long, score double, leaf int")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "uid")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def calibrate(index: Index, queries: DataFrame, k: int, target: float = TARGET_RECALL, sample: int = CALIBRATION) -> tuple[int, float]:
    """The fewest leaf visits at which the sample's true neighbours are reached, and the recall there."""
    rows = queries.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not rows or index.tree.leaves == 1:
        return 1, 1.0
    vectors = _matrix([r["v"] for r in rows])
    truth = _exact(index, [r["id"] for r in rows], vectors, k).select("q", "leaf").collect()  # sample * k rows
    order = [{leaf: i for i, leaf in enumerate(index.tree.best_bins(u, index.tree.leaves))} for u in _units(vectors)]
    ranks = np.sort([order[r["q"]][r["leaf"]] for r in truth])
    visits = 1
    while visits < index.tree.leaves and np.searchsorted(ranks, visits) < target * len(ranks):
        visits += max(1, visits // 8)  # widened step by step
    visits = min(visits, index.tree.leaves)
    return visits, float(np.searchsorted(ranks, visits) / len(ranks))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of all other vectors, as found."""
    held = shared(valid_vectors(vectors, id_col, vector_col), "knn-vectors")
    index = build_index(held, k)
    asked = shared(valid_vectors(queries, id_col, vector_col).dropDuplicates(["id", "h1", "h2"]), "knn-queries")
    once = shared(asked.groupBy("h1", "h2").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")), "knn-asked")
    visits, _ = calibrate(index, once, k, target)
    tree, chunks = index.tree, index.chunks

    def walk(batches):
        for batch in batches:
            q, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not q:
                continue
            leaves = [tree.best_bins(u, visits) for u in _units(_matrix(v))]
            at = [i for i, found in enumerate(leaves) for _ in found]
            flat = [leaf for found in leaves for leaf in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q[i] for i in at], pa.int64()), pa.array([v[i] for i in at], pa.list_(pa.float64())), pa.array(flat, pa.int32()),
                 pa.array([chunks.get(leaf, 0) for leaf in flat], pa.int32())], names=["q", "v", "leaf", "chunks"])

    visited = once.select(F.col("id").alias("q"), "v").mapInArrow(walk, "q long, v array<double>, leaf int, chunks int").where("chunks > 0")
    visited = shared(visited, "knn-visits")
    per_leaf = {r["leaf"]: -(-r["count"] // BLOCK) for r in visited.groupBy("leaf").count().collect()}  # bounded by the sample
    spark = vectors.sparkSession
    plan = spark.createDataFrame([(leaf, chunks[leaf], blocks) for leaf, blocks in per_leaf.items()], "leaf int, chunks int, blocks int")
    members = (index.entries.join(F.broadcast(plan), "leaf")
               .withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "chunk", "block", "uid", "v", "ids"))
    asking = (visited.drop("chunks").join(F.broadcast(plan), "leaf")
              .withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("leaf", "chunk", "block", "q", "v"))

    def compare(qs: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ms):
            return pd.DataFrame({"q": [], "ids": [], "score": []})
        keys, ids = qs.q.tolist(), [x.tolist() for x in ms.ids]
        got = list(_best(_matrix(qs.v), _matrix(ms.v), ms.uid.to_numpy(), ids, k))
        return pd.DataFrame({"q": [keys[q] for q, _, _ in got], "ids": [ids[j] for _, j, _ in got], "score": [s for _, _, s in got]})

    key = ["leaf", "chunk", "block"]
    found = asking.groupBy(key).cogroup(members.groupBy(key)).applyInPandas(compare, "q long, ids array<long>, score double")
    # an id may have several vectors: its best one counts
    named = found.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    few = named.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    few = shared(few.join(once.select(F.col("id").alias("q"), "h1", "h2"), "q").select("h1", "h2", "score", "vec_id"), "knn-found")
    pairs = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(few, ["h1", "h2"]).where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
