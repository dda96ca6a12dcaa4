"""Near-duplicate documents by an LSH forest over word shingles.

A text's set is that of its distinct five-word shingles (A-Z lower-cased). Two texts are linked if
their sets have a Jaccard similarity of 0.75 or more; the components of the links are the groups.

1. One pass over the text makes, for each document, the size of its set, the set's 128-bit hash and
   a signature of ``TREES * DEPTH`` min-hashes (two bytes each, 240 bytes a document). Documents of
   equal sets form one node, so thousands of exact copies are one row from here on.
2. The forest: in each of ``TREES`` orders a node's place is a slice of its signature. The nodes that
   share the first ``START`` values of a slice are a region of that order: its longest common prefix
   is the region's depth. Regions of more than ``REGION_ROWS`` nodes are divided by further values,
   each as deep as it needs, and at the full depth by the node's hash, in each order another one. The
   parts of a divided region share ``ANCHORS`` nodes, which connect most of it: those nearest to what
   most of the region are copies of, and some by hash; step 6 finds the rest. Two texts at 0.75 share
   no region, divided or not, with probability (1 - 0.75^3)^20 = 2e-5.
3. Within a region the candidates are a maximum spanning forest of the estimated similarities (at
   least ``LEAST_ESTIMATE``, four deviations below 0.75): at most one pair per node, and none in
   vain between nodes that are connected already.
4. Candidates are confirmed on the full sets, which are made anew from the texts of those nodes;
   the components of the confirmed links follow.
5. Where a region still holds several components that the estimates do not keep apart, the nodes in
   question meet with their full sets, and the links that connect components are found exactly,
   through lists of who has a shingle. So a failed candidate hides no link. Components are made again.
6. The nodes of a divided region that still holds several components are joined exactly: shingles are
   put in order from rare to common, and of two linked sets the first quarters (``_postings``) share one.
   Nodes of different components that share such a shingle, and whose sizes and places in the order
   allow a link, are confirmed on the full sets. First each node is held against one of each other
   component only; then, with components made again, against all that are left.

Scale: a region writes fewer pairs than it has nodes; the largest region is bounded; all tables that feed a join are written, so AQE can split hot keys, and a lost executor
costs no more than the step at work. Step 6 takes the nodes of mixed divided regions only, and its pairs
are those between components: a crowd of copies that is one component writes none.

Defined results: null and empty texts, and those without words, have an empty set and are linked
with nothing; fewer than five words are one shingle; repeated rows are one node; the component of
rows that all have a null id is null, and null ids never win against others; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sparkscrub.llm.common import WORD, discard, shared, texts_of
from sparkscrub.operators import hash_filter

TREES, DEPTH, START = 20, 6, 3
HASHES = TREES * DEPTH
REGION_ROWS = 2048
ANCHORS, ANCHOR_SAMPLE = 32, 512
LEAST_ESTIMATE = 0.60
SHINGLE = 5

_UPPER = {c: c + 32 for c in range(65, 91)}
_RNG = np.random.default_rng(20)
_MULTIPLIERS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_FACTORS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of lower-cased words, kept for words that come again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.translate(_UPPER).encode("utf-8", "surrogatepass"))
        return value


def shingle_set(text: str | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = WORD.findall(text or "")
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return h
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x += h[i:len(h) - width + 1 + i] * _WORD_FACTORS[i]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(x)


def signature(shingles: np.ndarray) -> bytes:
    """The low two bytes of the smallest product of each multiplier with the shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, np.multiply.outer(_MULTIPLIERS, shingles[i:i + 4096]).min(axis=1), out=least)
    return least.astype("<u2").tobytes()


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set; null if empty) and signature."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for text in texts_of(batch.column(1)):
                s = shingle_set(text, hashes)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "node", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node binary, signature binary")


def _sets(docs: DataFrame) -> DataFrame:
    """node and its set, from texts."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes) for t in texts_of(batch.column(0))]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node binary, shingles array<long>")


def forest_regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(region, node): the regions with several nodes, over all orders, none much above ``REGION_ROWS``; and
    (region, node) of the regions that were divided, as they were before."""
    def prefix(depth):
        place = F.col("tree") * (2 * DEPTH) + 1
        return F.xxhash64("tree", F.lit(depth), F.substring("signature", place, F.lit(2 * depth)))

    rows = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    parents, crowded, done = None, None, []
    for depth in range(START, DEPTH + 2):
        if depth <= DEPTH:
            keyed = rows.withColumn("region", prefix(depth))
            if parents is None:  # the signature would be carried TREES times: only the keys are dealt
                keyed = keyed.select("region", "tree", "node")
        else:  # at the full depth, the node's hash divides what is left
            keyed = rows.withColumn("region", F.xxhash64("parent", F.pmod(F.xxhash64("tree", "node"), F.col("parts"))))
        least = 1 if parents is not None else 2  # a lone node of a divided region still meets the anchors
        counted = shared(keyed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "forest-counts")
        fits = counted.where(F.col("n") <= REGION_ROWS) if depth <= DEPTH else counted
        done.append(keyed.join(fits.select("region"), "region", "left_semi").select("region", "node"))
        if parents is not None:
            links = keyed.select("parent", "region").distinct()
            done.append(links.join(parents, "parent").select("region", "node"))
        if depth > DEPTH:
            break
        large = counted.where(F.col("n") > REGION_ROWS)
        if large.isEmpty():
            break
        crowd = keyed.select("node", "tree", "region").join(large, "region").join(nodes.select("node", "signature"), "node")
        rows = shared(crowd.select("node", "signature", "tree", F.col("region").alias("parent"),
                                   F.ceil(F.col("n") / REGION_ROWS).alias("parts")), "forest-crowd")
        crowded = crowded or rows.select(F.col("parent").alias("region"), "node")
        parents = shared(_anchors(rows), "forest-anchors")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return shared(out.distinct() if len(done) > 1 else out, "forest-regions"), crowded


def _anchors(rows: DataFrame) -> DataFrame:
    """(parent, node): a few nodes of each crowded region. Half of them are by hash; half are those that agree
    most with the region's commonest signature, which is that of the text most others are copies of."""
    slot = F.pmod(F.xxhash64("node"), F.lit(ANCHOR_SAMPLE))
    sample = shared(rows.groupBy("parent", slot.alias("slot")).agg(F.min(F.struct("node", "signature")).alias("s"))
                    .select("parent", "slot", "s.node", "s.signature"), "forest-sample")

    def commonest(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.frombuffer(b"".join(pdf.signature), "<u2").reshape(-1, HASHES)
        mode = np.array([np.bincount(values[:, i]).argmax() for i in range(HASHES)], "<u2")
        return pd.DataFrame({"parent": pdf.parent[:1], "mode": [mode.tobytes()]})

    def agreement(batches):
        for batch in batches:
            own, mode = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((own == mode).mean(axis=1))],
                                             names=["parent", "node", "agreement"])

    modes = shared(sample.groupBy("parent").applyInPandas(commonest, "parent long, mode binary"), "forest-modes")
    scored = rows.join(modes, "parent").select("parent", "node", "signature", "mode").mapInArrow(agreement, "parent long, node binary, agreement double")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("agreement"), "node"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= ANCHORS // 2).select("parent", "node")
    few = sample.where(F.col("slot") < ANCHORS // 2 + ANCHORS % 2).select("parent", "node")
    return best.unionByName(few).distinct()


def _region_groups(batches) -> Iterator[tuple[int, list[list]]]:
    """Each region of a partition sorted by region, with its other columns as lists."""
    parts: list[pa.RecordBatch] = []
    key = None

    def whole():
        return int(key), [[x for p in parts for x in p.column(i).to_pylist()] for i in range(1, parts[0].num_columns)]

    for batch in batches:
        regions = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(regions)) + 1).tolist(), len(regions)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if parts and regions[lo] != key:
                yield whole()
                parts = []
            key = regions[lo]
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield whole()


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u2").reshape(-1, HASHES)


def _estimates(signatures: np.ndarray, sizes: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Estimated similarity of node i to all; 0 where the sizes alone rule a link out."""
    e = (signatures == signatures[i]).mean(axis=1)
    e[100 * np.minimum(sizes, sizes[i]) < percent * np.maximum(sizes, sizes[i])] = 0
    return e


def spanning_pairs(signatures: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A maximum spanning forest of the estimates that reach ``LEAST_ESTIMATE`` (Prim's way)."""
    m = len(sizes)
    best, parent, waiting = np.full(m, -1.0), np.zeros(m, int), np.ones(m, bool)
    pairs, now = [], 0
    for _ in range(m):
        waiting[now] = False
        e = _estimates(signatures, sizes, now, percent)
        better = waiting & (e > best)
        best[better], parent[better] = e[better], now
        if not waiting.any():
            break
        now = int(np.argmax(np.where(waiting, best, -2)))
        if best[now] >= LEAST_ESTIMATE:
            pairs.append((int(parent[now]), now))
        best[now] = -1
    return pairs


def suspects(signatures: np.ndarray, sizes: np.ndarray, components: list, percent: int) -> np.ndarray:
    """The nodes of a region that may be linked to one of another component, by the estimates."""
    _, number = np.unique(np.array([c.hex() for c in components]), return_inverse=True)
    sizes_of = np.bincount(number)
    found = np.zeros(len(sizes), bool)
    for i in np.flatnonzero(number != np.argmax(sizes_of)) if len(sizes_of) > 1 else ():
        near = (number != number[i]) & (_estimates(signatures, sizes, i, percent) >= LEAST_ESTIMATE)
        found |= near
        found[i] |= near.any()
    return np.flatnonzero(found)


def exact_links(sets: list[np.ndarray], components: list, percent: int) -> list[tuple[int, int]]:
    """Links between the components of a region, as many as connect what can be connected: every node outside
    the largest component is held against all others on the full sets, through lists of who has a shingle."""
    _, number = np.unique(np.array([c.hex() for c in components]), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    has = owner[np.argsort(shingle, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    root, links = number.copy(), []
    for i in np.flatnonzero(number != np.argmax(np.bincount(number))):
        own = shingle[ends[i]:ends[i + 1]]
        lengths = begin[own + 1] - begin[own]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - begin[own], lengths)
        common = np.bincount(has[at], minlength=len(sets))
        linked = 100 * common >= percent * (sizes + sizes[i] - common)
        while len(rest := np.flatnonzero(linked & (root != root[i]))):
            links.append((int(i), int(rest[0])))
            root[root == root[rest[0]]] = root[i]
    return links


def _by_region(rows: DataFrame, fn, schema: str, width: int) -> DataFrame:
    """``fn`` over the rows of each region; it gives tuples of ``width`` columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        found: list[tuple] = []

        def out():
            kinds = [pa.int64() if "long" in part else pa.binary() for part in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(width)], names=names)

        for region, columns in _region_groups(batches):
            if len(columns[0]) > 1:
                found += fn(region, columns)
            if len(found) >= 10_000:
                yield out()
                found = []
        yield out()

    return rows.repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, schema)


def _spanning(members: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a < b) of all regions (region, node, signature, n)."""
    def pairs(_, columns):
        names = columns[0]
        at = spanning_pairs(_matrix(columns[1]), np.array(columns[2]), percent)
        return [(min(names[i], names[j]), max(names[i], names[j])) for i, j in at]

    return _by_region(members, pairs, "a binary, b binary", 2).distinct()


def _suspects(told: DataFrame, percent: int) -> DataFrame:
    """(region, node, component) of the nodes to be held against each other on full sets."""
    def rows(region, columns):
        names, components = columns[0], columns[3]
        return [(region, names[i], components[i]) for i in suspects(_matrix(columns[1]), np.array(columns[2]), components, percent)]

    return _by_region(told, rows, "region long, node binary, component binary", 3)


def _exact(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a region (region, node, component, shingles)."""
    def links(_, columns):
        names, components = columns[0], columns[1]
        sets = [np.array(x, np.int64) for x in columns[2]]
        return [(names[i], names[j]) for i, j in exact_links(sets, components, percent)]

    return _by_region(rows, links, "a binary, b binary", 2).distinct()


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, made anew from the text of one document of each.

    A filter of bounded size tells which texts to move; plans are the same at every size."""
    wanted = shared(wanted.select("node").distinct().join(nodes.select("node", "label"), "node").withColumn("hash", F.xxhash64("label")), "near-wanted")
    ids = wanted.select("hash", "label").distinct().hint("merge")
    moved = hash_filter.prune(docs.withColumn("hash", F.xxhash64("doc_id")), "hash", hash_filter.build(wanted, "hash"))
    texts = moved.join(ids, (moved["hash"] == ids["hash"]) & moved["doc_id"].eqNullSafe(ids["label"]), "left_semi").select("text")
    sets = _sets(texts).join(wanted.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    return shared(sets, "near-sets")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    links = shared(_similar(pairs, sets, percent), "near-links")
    discard(sets)
    return links


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, at, shingle): the shingles of each set that a linked set must share one of, and their places in
    the set, rare ones first. Shingles of one set only have a place but are left out: nothing meets there."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    known = (each.join(counts.hint("merge"), "shingle").groupBy("node")
             .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("known")))
    lone = F.col("n") - F.size("known")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1  # so many of n hold one of any percent of them
    taken = known.select("node", "n", lone.alias("lone"), F.posexplode(F.slice("known", F.lit(1), F.greatest(first - lone, F.lit(0)))).alias("k", "x"))
    return taken.select("node", "n", (F.col("lone") + F.col("k")).alias("at"), "x.shingle")


def _between(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, other, bound): nodes of different components that share a shingle of ``postings`` and may be linked by
    their sizes and by what is left of their sets from there on. Where the shingle is the first that both
    have, ``bound`` is no less than what they have in common, so that no link is missed."""
    held = shared(postings.join(labels, "node"), "near-postings")
    kinds = (held.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("often"))
             .groupBy("shingle").agg(F.max(F.struct("often", "component")).alias("main"), F.count(F.lit(1)).alias("kinds"))
             .where("kinds > 1").select("shingle", F.col("main.component").alias("main")))
    mixed = shared(held.join(kinds.hint("merge"), "shingle"), "near-mixed")
    a = mixed.where("component != main").select("shingle", F.col("node").alias("a"), F.col("component").alias("own"), F.col("n").alias("na"), F.col("at").alias("ia"))
    b = mixed.select("shingle", F.col("node").alias("b"), F.col("component").alias("other"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    bound = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return (a.join(b.hint("merge"), "shingle").where("own != other")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .where((100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "other", bound.alias("bound")))


def _crowded_labels(crowded: DataFrame, links: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``labels``, the components of ``links``, made anew with the links between nodes of divided regions that it
    holds in different components."""
    def with_component(rows):
        return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    told = shared(with_component(crowded), "near-crowded")
    mixed = told.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("region")
    wanted = shared(told.join(mixed, "region", "left_semi").select("node").distinct(), "near-crowd")
    if wanted.isEmpty():
        return labels
    sets = _sets_of(wanted, nodes, docs)
    postings = shared(_postings(sets, percent), "near-prefixes")
    for all_pairs in (False, True):
        pairs = _between(postings, with_component(wanted), percent)
        if not all_pairs:
            pairs = pairs.groupBy("a", "other").agg(F.max(F.struct("bound", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        pairs = shared(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-crowd-pairs")
        more = shared(_similar(pairs, sets, percent), "near-crowd-links")
        if not more.isEmpty():
            links = shared(links.unionByName(more), "near-links")
            labels = components(links)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b): roots hook to their least neighbour, edges are
    contracted to roots, until none is left. The number of rounds is logarithmic."""
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        for _ in range(2):  # four steps up in one round
            hook = hook.join(hook.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p"))
        hook = shared(hook, "cc-roots")
        if labels is None:
            labels = hook.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            labels = labels.join(hook, labels["component"] == hook["v"], "left").select("node", F.coalesce("p", "component").alias("component"))
        edges = (edges.join(hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
                 .join(hook.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
                 .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        edges = shared(edges, "cc-edges")
        if edges.isEmpty():
            return shared(labels, "cc-labels")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = shared(_signed(docs), "near-signed")
    nodes = shared(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("label"), F.min("n_shingles").alias("n"), F.min("signature").alias("signature")), "near-nodes")
    regions, crowded = forest_regions(nodes)
    members = shared(regions.join(nodes.select("node", "signature", "n"), "node").select("region", "node", "signature", "n"), "near-members")
    links = _confirmed(shared(_spanning(members, percent), "near-pairs"), nodes, docs, percent)
    labels = components(links)
    told = members.join(labels, "node", "left").select("region", "node", "signature", "n", F.coalesce("component", "node").alias("component"))
    doubtful = shared(_suspects(told, percent), "near-suspects")
    discard(members)
    if not doubtful.isEmpty():
        sets = _sets_of(doubtful, nodes, docs)
        more = shared(_exact(doubtful.join(sets.hint("merge"), "node").select("region", "node", "component", "shingles"), percent), "near-links")
        discard(sets)
        if not more.isEmpty():
            links = shared(links.unionByName(more), "near-links")
            labels = components(links)
    if crowded is not None:
        labels = _crowded_labels(crowded, links, labels, nodes, docs, percent)
    grouped = nodes.join(labels, "node", "left").select("node", "label", F.coalesce("component", "node").alias("component"))
    least = shared(grouped.groupBy("component").agg(F.min("label").alias("component_id")), "near-least")
    result = shared(grouped.join(least, "component").select("node", "component_id"), "near-components")
    done = signed.join(result, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
