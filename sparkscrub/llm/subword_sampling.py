"""Sampled SentencePiece segmentations without replacement, by a perturbed best-first search.

A text's lattice holds every way to cut it into pieces of a public vocabulary (characters outside it
fall back to their bytes). A piece of merge rank r weighs as (r + ``SHIFT``) to the power ``-alpha``, and
a segmentation as the product of its pieces; that is the distribution sampled from. Gumbel noise added
to the log-probability of every segmentation and the k largest sums taken give k distinct samples
without replacement. They are found without listing segmentations: the search keeps regions of the
lattice's tree of prefixes, each with the maximum of its noisy sums. The best region is opened: its
best segmentation is drawn arc by arc from the backward sums, and what the region holds besides - at
each arc taken, the other arcs of that place - goes back as new regions, with maxima drawn from
Gumbels truncated at the opened one. Regions below ``e**-NEGLIGIBLE`` of the whole are not kept: their
maxima are beyond double precision.

Each sample has its log-probability, its noisy sum and its log inclusion probability given the
(k+1)-th noisy sum as threshold. All random numbers are hashes of seed, row key, sample and place, so
a row's samples depend on nothing else: not on batches, partitions or repeated tasks.

Pieces never cross a blank, so the lattice falls into blocks. Distinct blocks are built once and kept
in an arena of bounded size, which the tasks of a worker share; all blocks of a batch are walked at once with numpy. One pass over the
table, no shuffle, whole texts.

Defined results: null and empty texts have one segmentation without pieces, with inclusion 1; a text
with fewer than k segmentations gives all it has, with inclusion 1; a null key is a key of its own;
repeated rows get the same samples; an empty table gives an empty result; other columns are ignored.
Decoding gives the text back, byte for byte, also where it is no UTF-8 (a literal U+2581 becomes a blank, as in the
vocabulary's own decoder).
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
ALPHA, SHIFT = 1.0, 10.0
NEGLIGIBLE = 40.0
MOST_ARCS = 5_000_000
#: Blocks that are walked at once.
WALK = 400_000

#: Cut at spaces, which texts hold as one byte; the vocabulary's blank stands for them in the lattice.
_BLOCK = re.compile(" *[^ ]+| +")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a model file with ids and log-weights, and a hash table of all their prefixes."""

    def __init__(self, file: bytes, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.encoded = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            self.encoded[i] = bytes([b])
        self.encoded_array = pa.array(self.encoded, pa.large_binary())
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranks = sorted(plain, key=lambda i: (-model.get_score(i), i))
        weights = (np.arange(len(ranks)) + SHIFT) ** -alpha
        self.log_weight = np.zeros(size)
        self.log_weight[ranks] = np.log(weights / weights.sum())
        self.fallback = float(self.log_weight.min()) - math.log(10)
        self.longest = max(len(self.pieces[i]) for i in plain)
        entries: dict[int, int] = {}  # hash of a prefix -> id of the piece, or -1
        for i in plain:
            h = 0
            for n, c in enumerate(self.pieces[i], 1):
                h = ((h ^ ord(c)) * int(_M1) + n) & 0xFFFFFFFFFFFFFFFF
                if n == len(self.pieces[i]):
                    entries[h] = i
                else:
                    entries.setdefault(h, -1)
        self.keys = np.array(list(entries), np.uint64)
        self.ids = np.array(list(entries.values()), np.int64)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.next = np.full(len(self.keys), -1, np.int32)
        for n, slot in enumerate((self.keys >> np.uint64(44)).tolist()):
            self.next[n], self.slots[slot] = self.slots[slot], n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the entry of each hash, or -1."""
        at = self.slots[hashes >> np.uint64(44)]
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = self.next[at[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[at[wrong]] != hashes[wrong])]
        return at

    def decode(self, ids) -> bytes:
        """The text of a sequence of ids, in UTF-8."""
        return b"".join(map(self.encoded.__getitem__, ids))[1:]

    def decoded_crc32(self, ids: np.ndarray, ends: np.ndarray) -> list[int]:
        """crc32 of what each sequence decodes to: the ids between two of the ends, the first of which is 0."""
        taken = self.encoded_array.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        if data is None:
            return [0] * (len(ends) - 1)
        cuts = np.frombuffer(offsets, np.int64)[taken.offset:][ends].tolist()
        text = memoryview(data)
        return [zlib.crc32(text[a + 1:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def vocabulary(file: bytes, alpha: float) -> Vocabulary:
    return Vocabulary(file, alpha)


@lru_cache(maxsize=1)
def shared_arena(file: bytes, alpha: float) -> Arena:
    """One arena for all tasks of a Python worker; what it holds changes no result."""
    return Arena(vocabulary(file, alpha))


class Arena:
    """Lattices of distinct blocks, built many at once.

    A node is a place in a block, an arc a piece that starts there. Nodes are numbered by distance from
    the end of their block, so backward sums go level by level over all blocks together. Per block:
    ``start`` (node). Per node: ``first`` (arc) and ``head`` (begins a block). Per arc: ``reach``
    (cumulative probability within the node), ``target`` (node, -1 at the end), ``piece`` (id; minus code point minus
    one for bytes), ``logp`` (given the node) and ``logrest`` (of the node's other arcs together)."""

    _KINDS = {"start": np.int64, "first": np.int64, "head": bool, "reach": np.float64, "target": np.int32, "piece": np.int32,
              "logp": np.float64, "logrest": np.float32}

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._held = {k: np.empty(1 << 16, kind) for k, kind in self._KINDS.items()}
        self.reset()

    def reset(self) -> None:
        """Forget all blocks; the memory is kept for the next ones."""
        self.number: dict[str, int] = {}
        self._used = dict.fromkeys(self._KINDS, 0)
        self.nodes = self.arcs = 0

    def numbers(self, blocks: list[str]) -> np.ndarray:
        """The number of every block; new ones are built."""
        out = np.fromiter(map(self.number.get, blocks, repeat(-1)), np.int64, len(blocks))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list(dict.fromkeys([blocks[i] for i in missing]))
            order = np.argsort(-np.fromiter(map(len, new), np.int64, len(new)), kind="stable")
            self._build([new[i] for i in order.tolist()])
            out[missing] = [self.number[blocks[i]] for i in missing]
        return out

    def _append(self, name: str, x: np.ndarray) -> None:
        used, held = self._used[name], self._held[name]
        if used + len(x) > len(held):
            grown = np.empty(max(used + len(x), 2 * len(held)), held.dtype)
            grown[:used] = held[:used]
            held = self._held[name] = grown
        held[used:used + len(x)] = x
        self._used[name] = used + len(x)

    def views(self) -> dict[str, np.ndarray]:
        self._append("first", np.array([self.arcs]))  # the end of the last node, overwritten by the next block
        v = {k: x[:self._used[k]] for k, x in self._held.items()}
        self._used["first"] -= 1
        return v

    def _build(self, new: list[str]) -> None:
        vocab = self.vocab
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[codes == ord(" ")] = ord(BLANK)
        lengths = np.array([len(b) for b in new], np.int64)  # falling
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        block = np.repeat(np.arange(len(new)), lengths)
        left = np.repeat(begins + lengths, lengths) - np.arange(len(codes))  # characters from here to the block's end
        # blocks of ``r`` characters or more come first, so a block's rank is the same in every level
        level = np.concatenate([[0], np.cumsum(len(new) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1)))])
        node = level[left - 1] + block

        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []  # places, pieces, length
        for n in range(1, vocab.longest + 1):
            h = (h ^ codes[at + n - 1]) * _M1 + np.uint64(n)
            entry = vocab.find(h)
            piece = np.where(entry >= 0, vocab.ids[entry], -1)
            if n == 1:  # every character has an arc
                found.append((at, np.where(piece >= 0, piece, -1 - codes.astype(np.int64)), 1))
            else:
                hit = piece >= 0
                found.append((at[hit], piece[hit], n))
            on = (entry >= 0) & (left[at] > n)
            at, h = at[on], h[on]
            if not len(at):
                break
        count = np.zeros(len(codes), np.int64)
        for places, _, _ in found:
            count[node[places]] += 1
        first = np.concatenate([[0], np.cumsum(count)])
        total = int(first[-1])
        piece, target, filled = np.empty(total, np.int64), np.empty(total, np.int64), first[:-1].copy()
        for places, pieces, n in found:
            here = node[places]
            slot = filled[here]
            filled[here] += 1
            piece[slot] = pieces
            rest = left[places] - n
            target[slot] = np.where(rest > 0, level[rest - 1] + block[places], -1)
        value = np.where(piece >= 0, vocab.log_weight[np.maximum(piece, 0)], vocab.fallback)
        back = np.zeros(len(codes) + 1)  # log backward sums; the last is the end's
        for r in range(len(level) - 1):
            lo, hi = first[level[r]], first[level[r + 1]]
            value[lo:hi] += back[target[lo:hi]]
            back[level[r]:level[r + 1]] = np.logaddexp.reduceat(value[lo:hi], first[level[r]:level[r + 1]] - lo)
        value -= np.repeat(back[:-1], count)
        # the likeliest arc of each node goes first: a walk mostly stops there
        top = np.flatnonzero(np.repeat(np.maximum.reduceat(value, first[:-1]), count) == value)
        owner = np.searchsorted(first, top, side="right") - 1
        top = top[np.concatenate([[True], owner[1:] != owner[:-1]])]
        for x in (piece, target, value):
            x[first[:-1]], x[top] = x[top], x[first[:-1]]
        p = np.exp(value)
        sums = np.cumsum(p)
        reach = sums - np.repeat(np.concatenate([[0], sums])[first[:-1]], count)
        reach[first[1:] - 1] = 2.0
        rest = 1 - p
        p[first[:-1]] = 0
        rest[first[:-1]] = np.add.reduceat(p, first[:-1])
        with np.errstate(divide="ignore"):
            logrest = np.log(np.maximum(rest, 0))
        head = np.zeros(len(codes), bool)
        starts = node[begins]
        head[starts] = True
        made = {"start": starts + self.nodes, "first": first[:-1] + self.arcs, "head": head, "reach": reach,
                "target": np.where(target >= 0, target + self.nodes, -1), "piece": piece, "logp": value, "logrest": logrest}
        for k, x in made.items():
            self._append(k, x)
        known = len(self.number)
        self.number.update((b, known + i) for i, b in enumerate(new))
        self.nodes += len(codes)
        self.arcs += total


def walk(v: dict[str, np.ndarray], blocks: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One segmentation of every block, drawn by its probability: arcs, and where each block's arcs begin."""
    at, active, steps, salt = v["start"][blocks], np.arange(len(blocks)), [], 0
    count = np.zeros(len(blocks), np.int64)
    while len(active):
        u = (_mix(seeds + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        arc = v["first"][at]
        on = np.flatnonzero(u >= v["reach"][arc])
        while len(on):
            arc[on] += 1
            on = on[u[on] >= v["reach"][arc[on]]]
        steps.append((active, arc))
        count[active] += 1
        at = v["target"][arc].astype(np.int64)
        on = at >= 0
        active, at, seeds = active[on], at[on], seeds[on]
        salt = (salt + int(_M1)) & 0xFFFFFFFFFFFFFFFF
    begin = np.concatenate([[0], np.cumsum(count)])
    arcs = np.empty(begin[-1], np.int64)
    for k, (who, arc) in enumerate(steps):
        arcs[begin[who] + k] = arc
    return arcs, begin


class _Path:
    """A segmentation of a document, its noisy sum, and the place where it left its parent."""

    __slots__ = ("arcs", "value", "opened")

    def __init__(self, arcs: np.ndarray, value: float, opened: int):
        self.arcs, self.value, self.opened = arcs, value, opened


def _uniforms(key: int, salt: int, n: int) -> np.ndarray:
    """n numbers in (0, 1) that depend on the key and the salt only."""
    x = _mix(np.arange(1, n + 1, dtype=np.uint64) * _M3 + np.uint64((key + salt * int(_M1)) & 0xFFFFFFFFFFFFFFFF))
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sample_document(key: int, k: int, v: dict[str, np.ndarray], blocks: int, fresh: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[_Path], float]:
    """Up to k distinct segmentations by falling noisy sum, and the threshold (the next noisy sum).

    ``fresh[s]`` holds arcs drawn for sample s, and where each block of the document begins in them."""
    logp, first, reach, target = v["logp"], v["first"], v["reach"], v["target"]
    heap: list[tuple] = []  # (-maximum, path, place, arcs taken there)
    paths = [_Path(fresh[0][0], float(-np.log(-np.log(_uniforms(key, 0, 1)[0]))), 0)]

    def nodes(arcs: np.ndarray) -> np.ndarray:
        return np.searchsorted(first, arcs, side="right") - 1

    def add_regions(taken: frozenset) -> None:
        """What the region just opened holds besides its best path; of these the k + 1 best can matter."""
        path, number = paths[-1], len(paths) - 1
        near = 256
        while True:  # log mass of the prefix at each place, as far as it counts
            before = np.concatenate([[0.0], np.cumsum(logp[path.arcs[:min(path.opened + near, len(path.arcs)) - 1]])])[path.opened:]
            if before[-1] < -NEGLIGIBLE or path.opened + near >= len(path.arcs):
                break
            near *= 4
        before = before[:np.searchsorted(-before, NEGLIGIBLE, side="right")]
        location = before + v["logrest"][path.arcs[path.opened:path.opened + len(before)]]
        taken = taken | {int(path.arcs[path.opened])}
        if len(taken) > 1:  # where the path left its parent, several arcs are gone
            node = int(nodes(path.arcs[path.opened]))
            rest = sum(math.exp(logp[a]) for a in range(first[node], first[node + 1]) if a not in taken)
            location[0] = before[0] + math.log(rest) if rest > 0 else -math.inf
        u = _uniforms(key, 2 * number + 1, len(location))
        with np.errstate(over="ignore"):  # Gumbels at ``location``, truncated at the path's own sum
            best = location - np.log(np.exp(np.minimum(location - path.value, 700)) - np.log(u))
        for d in np.argsort(-best, kind="stable")[:k + 1]:
            if best[d] > -math.inf:
                place = path.opened + int(d)
                heapq.heappush(heap, (-float(best[d]), number, place, taken if d == 0 else frozenset((int(path.arcs[place]),))))

    if blocks:
        add_regions(frozenset())
    while len(paths) < k and heap:
        best, parent, d, gone = heapq.heappop(heap)
        old = paths[parent].arcs
        above = nodes(old[:d + 1])
        free = [a for a in range(first[above[d]], first[above[d] + 1]) if a not in gone]
        u = _uniforms(key, 2 * len(paths), 64).tolist()
        weights = np.cumsum(np.exp(logp[free]))
        path = [*old[:d].tolist(), free[min(len(free) - 1, int(np.searchsorted(weights, u[0] * weights[-1])))]]
        node, drawn = int(target[path[-1]]), 1
        while node >= 0:
            if drawn == len(u):  # a long block
                u += _uniforms(key, (2 * len(paths) + 1) << 32 | drawn, drawn).tolist()
            a, last = int(first[node]), int(first[node + 1]) - 1
            a += int(np.searchsorted(reach[a:last + 1], u[drawn], side="right"))
            path.append(a)
            node, drawn = int(target[a]), drawn + 1
        arcs, begin = fresh[len(paths)]
        rest = arcs[begin[int(v["head"][above].sum())]:]  # the blocks after this one
        paths.append(_Path(np.concatenate([np.array(path, np.int64), rest]), -best, d))
        add_regions(gone)
    return paths, -heap[0][0] if heap else -math.inf


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Log of the probability that a segmentation's noisy sum passes the threshold."""
    if threshold == -math.inf:
        return 0.0
    x = log_prob - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def sample_texts(arena: Arena, keys: list, texts: list, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: ids, log-probability, noisy sum, log inclusion."""
    if arena.arcs > MOST_ARCS:
        arena.reset()
    cut = [_BLOCK.findall(" " + (t.replace(BLANK, " ") if BLANK in t else t)) if t else [] for t in texts]
    flat = arena.numbers([b for blocks in cut for b in blocks])
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in cut])]).astype(np.int64)
    row_keys = [xxhash.xxh3_64_intdigest(f"{seed}:{key}".encode()) for key in keys]
    v = arena.views()
    sizes = np.diff(bounds)
    place = (np.arange(len(flat)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64)
    per_block = np.repeat(np.array(row_keys, np.uint64), sizes) + place * _M3
    rounds = [walk(v, flat, _mix(per_block + np.uint64((s + 1) * int(_M2) & 0xFFFFFFFFFFFFFFFF))) for s in range(k)]
    code_points = v["piece"]
    out = []
    for i, key in enumerate(row_keys):
        lo, hi = bounds[i], bounds[i + 1]
        fresh = [(arcs[begin[lo]:begin[hi]], begin[lo:hi + 1] - begin[lo]) for arcs, begin in rounds]
        paths, threshold = sample_document(key, k, v, hi - lo, fresh)
        rows = []
        for path in paths:
            ids = _with_bytes(arena.vocab, code_points[path.arcs])
            log_prob = float(v["logp"][path.arcs].sum())
            rows.append((ids, log_prob, path.value, log_inclusion(log_prob, threshold)))
        out.append(rows)
    return out


def _with_bytes(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Ids with every character outside the vocabulary (a negative number) as the ids of its bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    bytes_ = [[vocab.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "surrogateescape")] for p in ids[odd].tolist()]
    widths = np.ones(len(ids), np.int64)
    widths[odd] = [len(b) for b in bytes_]
    out = np.repeat(ids, widths)
    out[out < 0] = [x for b in bytes_ for x in b]
    return out


def _portions(batch: pa.RecordBatch, rows: int = 256):
    """Keys and texts of a batch, with about ``WALK`` blocks at a time, or one row. Bytes that are no UTF-8 stay as they are."""
    keys, texts, weight = [], [], 0
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        for key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            text = None if raw is None else raw.decode("utf-8", "surrogateescape")
            own = (text or "").count(" ") + 1
            if keys and weight + own > WALK:
                yield keys, texts
                keys, texts, weight = [], [], 0
            keys.append(key)
            texts.append(text)
            weight += own
    if keys:
        yield keys, texts


def read_model(path: str) -> bytes:
    """The vocabulary file, some 500 KB; the driver reads it."""
    with open(path, "rb") as f:
        return f.read()


def sample_segmentations(df: DataFrame, k: int = 2, seed: int = 10, alpha: float = ALPHA, tokenizer: str = TOKENIZER,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (from 1), ids, log_prob, noisy_sum, log_inclusion, and crc32 of what the ids decode to: up to k rows per text."""

    model = df.sparkSession.sparkContext.broadcast(read_model(tokenizer))

    def run(batches):
        arena = shared_arena(model.value, alpha)
        for batch in batches:
            for keys, texts in _portions(batch):
                got = sample_texts(arena, keys, texts, k, seed)
                rows = [(key, n + 1, *row) for key, own in zip(keys, got) for n, row in enumerate(own)]
                ends = np.cumsum([0] + [len(r[2]) for r in rows])
                flat = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))),
                     *(pa.array([r[c] for r in rows], pa.float64()) for c in (3, 4, 5)),
                     pa.array(arena.vocab.decoded_crc32(flat, ends), pa.int64())],
                    names=["doc_id", "sample", "ids", "log_prob", "noisy_sum", "log_inclusion", "decoded_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(
        run, "doc_id long, sample int, ids array<int>, log_prob double, noisy_sum double, log_inclusion double, decoded_crc32 long")


def decode(df: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER, out_col: str = "decoded") -> DataFrame:
    """All columns and the text of the ids, byte for byte; null for null ids."""
    shape = StructType([*df.schema.fields, StructField(out_col, BinaryType())])
    model = df.sparkSession.sparkContext.broadcast(read_model(tokenizer))

    def run(batches):
        vocab = vocabulary(model.value, ALPHA)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(part.schema.get_field_index(ids_col))
                texts = [x.values.to_numpy() if x.is_valid else None for x in ids]
                decoded = [None if x is None else vocab.decode(x.tolist()) for x in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, shape).withColumn(out_col, F.col(out_col).cast("string"))
