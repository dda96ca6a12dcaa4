"""Phrase collocations by Rabin-Karp fingerprints.

Texts, A-Z lower-cased, are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words. f(phrase)
counts all occurrences of one to five words within a piece, by language; n counts all words. Phrases of
two to five words that occur ``LEAST`` times or more are candidates, scored by the cut that tells
least for them, floor(1000 * f * n / (f(first part) * f(rest))).

1. A task numbers words, keeps the numbers of up to ``FLUSH_WORDS`` words, and makes the
   fingerprints of all n-grams at once from prefix polynomials over the words' 64-bit hashes (modulo
   2^64), turned by their language. Equal fingerprints of a flush are counted together after their
   words are compared; each gives one row of 16 bytes: fingerprint and count.
2. A shuffle adds up the counts by fingerprint. Fingerprints below ``LEAST`` hold no frequent phrase.
   This goes by levels: single words, then pairs of words, then longer ones; an n-gram gives a
   row only if all its words, or pairs, may be frequent, which a filter of bounded size tells.
   No frequent phrase is lost, as each part of one is as frequent.
3. The last scans spell out: a task counts the phrases whose fingerprint may be frequent, and gives one row
   for each of a flush: language, phrase, count. Counts are added up by language and phrase, so that two
   phrases of one fingerprint, in one flush or in two, are counted apart: the counts are exact.
   Words and pairs are spelt out in the scan that counts longer n-grams, and those in one more.
4. Cuts and contained phrases are equi-joins of the frequent phrases.

Scale: texts are read four times and never moved; no n-gram's text is shuffled unless its fingerprint may be
frequent; a word that is a third of all words is one row per flush. Scores are decimals of 38 digits.

Defined results: a null text is empty; a null language is ``und``; texts that are repeated count each
time; an empty table, or one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkscrub.llm.common import SLICE_ROWS, discard, shared
from sparkscrub.operators import hash_filter

LEAST, TOP = 100, 2000
#: Lengths that are counted in one scan; the first of a level is what the next one is filtered by.
LEVELS = ((1,), (2,), (3, 4, 5))
#: The filter between levels has so many bits for the slot of 64 of them: 8 MB.
FILTER_SLOT_BITS = 20
FLUSH_WORDS = 2_000_000

#: A word, or one character that ends a piece.
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
_BREAKS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]
#: What is spelt out: lengths, the filter of base-grams they pass, and the filter their fingerprints are in.
Spelt = Iterable[tuple[tuple[int, ...], int, np.ndarray | None, np.ndarray]]
_BASE = np.uint64(0x9E3779B97F4A7C15)

_GRAMS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("print", pa.int64()), ("count", pa.int64()), ("phrase", pa.binary())])


def tokens_of(text: bytes | None) -> list[bytes]:
    return TOKEN.findall(text.lower()) if text else []  # lower() of bytes changes A-Z only


def lang_seed(lang: str) -> int:
    """What a language's fingerprints are turned by."""
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class _Numbers(dict):
    """Number of each word, from 0 in order of appearance; -1 for what ends a piece."""

    def __init__(self):
        super().__init__(dict.fromkeys(_BREAKS, -1))
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(word_hash(word))
        return n


def prefix_polynomials(hashes: np.ndarray) -> np.ndarray:
    """P[i] = sum of hashes[j] * BASE^j over j < i, modulo 2^64."""
    powers = np.cumprod(np.full(len(hashes), _BASE, np.uint64)) if len(hashes) else np.empty(0, np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    for by, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    return x


def back_shifts(n: int) -> np.ndarray:
    """What the part of a prefix polynomial that begins at each place is multiplied by, so that places do not count."""
    return np.cumprod(np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64))


def fingerprints(prefix: np.ndarray, size: int, at: np.ndarray | None = None, shifts: np.ndarray | None = None) -> np.ndarray:
    """Fingerprint of the run of ``size`` hashes at each place: the polynomial's part, shifted back, mixed."""
    at = np.arange(max(0, len(prefix) - size)) if at is None else at
    shifts = back_shifts(len(prefix)) if shifts is None else shifts
    return _mixed((prefix[at + size] - prefix[at]) * shifts[at] + np.uint64(size))


def count_words(numbers: np.ndarray, hashes: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, count, place) of all words."""
    at = np.flatnonzero(numbers >= 0)
    counts, place = np.bincount(numbers[at], minlength=len(hashes)), np.zeros(len(hashes), np.int64)
    place[numbers[at][::-1]] = at[::-1]
    known = np.flatnonzero(counts)
    return _mixed(hashes[known] + np.uint64(1)) ^ np.uint64(seed), counts[known], place[known]


def count_grams(numbers: np.ndarray, prefix: np.ndarray, size: int, seed: int = 0, base: int = 0,
                may: np.ndarray | None = None, shifts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, count, place of one) of all n-grams of a length, from the words' numbers and prefix polynomials;
    those of one fingerprint whose words differ are told apart. With ``may``, a filter of ``base``-grams, only n-grams
    all of whose ``base``-grams it may hold."""
    shifts = back_shifts(len(prefix)) if shifts is None else shifts
    inside = numbers >= 0
    if may is not None:  # places where a base-gram begins that may be frequent
        good = _runs(inside, base)
        at = np.flatnonzero(good)
        good[at] = hash_filter.holds(may, fingerprints(prefix, base, at, shifts) ^ np.uint64(seed))
        whole = np.flatnonzero(_runs(good, size - base + 1))
    else:
        whole = np.flatnonzero(_runs(inside, size))
    prints = fingerprints(prefix, size, whole, shifts) ^ np.uint64(seed)
    order = np.argsort(prints)
    prints, places = prints[order], whole[order]
    starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(prints)]]))
    first = np.repeat(places[starts], counts)
    differ = np.zeros(len(places), bool)
    for i in range(size):
        differ |= numbers[places + i] != numbers[first + i]
    if not differ.any():
        return prints[starts], counts, places[starts]
    apart: dict[tuple, list] = {}
    for p, place in zip(prints[differ].tolist(), places[differ].tolist()):
        apart.setdefault((p, tuple(numbers[place:place + size].tolist())), [0, place])[0] += 1
    counts = np.add.reduceat((~differ).astype(np.int64), starts)
    return (np.concatenate([prints[starts], np.array([p for p, _ in apart], np.uint64)]),
            np.concatenate([counts, [c for c, _ in apart.values()]]), np.concatenate([places[starts], [x for _, x in apart.values()]]))


def _runs(good: np.ndarray, length: int) -> np.ndarray:
    """Where ``length`` true values in a row begin."""
    out = np.zeros(len(good), bool)
    n = len(good) - length + 1
    if n > 0:
        out[:n] = good[:n]
        for i in range(1, length):
            out[:n] &= good[i:n + i]
    return out


class _Flush:
    """The token numbers of some texts, by language."""

    def __init__(self):
        self.words, self.numbers = 0, _Numbers()
        self.texts: dict[str, list] = {}

    def add(self, lang: str, text_hash: int, text: bytes | None) -> None:
        found = tokens_of(text)
        if found:
            ids = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
            self.texts.setdefault(lang, []).append((text_hash, ids))
            self.words += len(found)

    def rows(self, sizes: Iterable[int], base: int, may: np.ndarray | None, spelt: Spelt = ()) -> Iterator[pa.RecordBatch]:
        """Fingerprints and counts of the n-grams of ``sizes`` that ``may`` lets through; then, spelt out, the phrases
        of each (sizes, base, may, filter) of ``spelt`` whose fingerprints may be in the filter."""
        hashes = np.array(self.numbers.hashes, np.uint64)
        words = None
        for lang, texts in self.texts.items():
            stop = np.array([-1], np.int32)
            ids = np.concatenate([x for _, t in texts for x in (t, stop)])
            prefix = prefix_polynomials(np.where(ids >= 0, np.append(hashes, np.uint64(0))[ids], np.uint64(0)))
            shifts, seed = back_shifts(len(prefix)), lang_seed(lang)

            def counted(size, base, may):
                return count_words(ids, hashes, seed) if size == 1 else count_grams(ids, prefix, size, seed, base, may, shifts)

            for size in sizes:
                prints, counts, _ = counted(size, base, may)
                yield from _batches(lang, size, prints, counts)
            for some, under, through, known in spelt:
                for size in some:
                    prints, counts, places = counted(size, under, through)
                    good = hash_filter.holds(known, prints)
                    prints, counts, places = prints[good], counts[good], places[good]
                    if words is None:
                        words = pa.array([w for w, n in self.numbers.items() if n >= 0], pa.binary())
                    parts = [words.take(pa.array(ids[places + i])) for i in range(size)]
                    yield from _batches(lang, size, prints, counts, pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0])


def _batches(lang: str, size: int, prints: np.ndarray, counts: np.ndarray, phrases: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    phrases = pa.nulls(len(prints), pa.binary()) if phrases is None else phrases
    for i in range(0, len(prints), 100_000):
        part = slice(i, i + 100_000)
        n = len(prints[part])
        yield pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(np.full(n, size, np.int32)), pa.array(prints[part].view(np.int64)),
            pa.array(counts[part].astype(np.int64)), phrases.slice(i, n)], schema=_GRAMS)


def _slices(batch: pa.RecordBatch) -> Iterator[list[list]]:
    for i in range(0, batch.num_rows, SLICE_ROWS):
        yield [c.to_pylist() for c in batch.slice(i, SLICE_ROWS).columns]


def partial_counts(texts: DataFrame, sizes: Iterable[int], base: int = 0, may: np.ndarray | None = None, spelt: Spelt = (),
                   flush_words: int = FLUSH_WORDS) -> DataFrame:
    """lang, size, print, count, phrase: one row for each flush and n-gram of ``texts`` (lang, text) that ``may``, a filter
    of ``base``-grams, lets through, without its phrase; and one for each that is to be spelt out, with it."""
    sizes, spelt = tuple(sizes), tuple(spelt)
    shared_filters = texts.sparkSession.sparkContext.broadcast((may, spelt))

    def run(batches):
        through, spell = shared_filters.value
        flush = _Flush()
        for batch in batches:
            for columns in _slices(batch):
                for lang, text in zip(*columns):
                    flush.add(lang, 0, text)
                    if flush.words >= flush_words:
                        yield from flush.rows(sizes, base, through, spell)
                        flush = _Flush()
        yield from flush.rows(sizes, base, through, spell)

    return texts.select("lang", F.col("text").cast("binary")).mapInArrow(run, "lang string, size int, print long, count long, phrase binary")


def _filter_of_frequent(grams: DataFrame, least: int) -> np.ndarray:
    """A filter of the fingerprints that occur ``least`` times or more."""
    frequent = grams.groupBy("print").agg(F.sum("count").alias("all")).where(F.col("all") >= least)
    return hash_filter.as_array(hash_filter.build(frequent, "print", FILTER_SLOT_BITS), FILTER_SLOT_BITS)


def frequent_phrases(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", flush_words: int = FLUSH_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of one to five words with f >= least; and (lang, n) of all words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    one, two, more = LEVELS
    grams = shared(partial_counts(texts, one, flush_words=flush_words), "phrase-grams")
    words = shared(grams.groupBy("lang").agg(F.sum("count").alias("n")), "phrase-words")
    singles = _filter_of_frequent(grams, least)
    discard(grams)
    pairs = _filter_of_frequent(partial_counts(texts, two, 1, singles, flush_words=flush_words).select("print", "count"), least)
    grams = shared(partial_counts(texts, more, 2, pairs, [(one, 0, None, singles), (two, 1, singles, pairs)], flush_words), "phrase-grams")
    longer = _filter_of_frequent(grams.where("phrase IS NULL").select("print", "count"), least)
    spelt = partial_counts(texts, (), spelt=[(more, 2, pairs, longer)], flush_words=flush_words)
    found = grams.where("phrase IS NOT NULL").unionByName(spelt).select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "count")
    counted = shared(found.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least), "phrase-counts")
    discard(grams)
    return counted, words


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ", -1)


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates: the cut of the lowest score, the first of several."""
    candidates = phrases.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), _words(F.col("phrase")).alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("first"),
                       _joined(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    f = phrases.select("lang", "phrase", "f")
    cut = (cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")).hint("merge"), ["lang", "first"])
           .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")).hint("merge"), ["lang", "rest"])
           .join(words, "lang"))
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "n", "l", "r")}
    over = F.lit(1000).cast("decimal(4,0)") * (exact["a"] * exact["n"])
    score = F.call_function("div", over, exact["l"] * exact["r"]).cast("long")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    return worst.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): phrases of two words or more that lie in a longer candidate, and its largest f."""
    longer = phrases.where("size >= 3").select("lang", "size", "f", _words(F.col("phrase")).alias("words"))
    spans = longer.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    parts = spans.select("lang", "f", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("size") - F.col("length") + 1), lambda i: _joined(F.col("words"), i, F.col("length")))).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", flush_words: int = FLUSH_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best candidates not told by a longer one."""
    phrases, words = frequent_phrases(docs, least, text_col, lang_col, flush_words)
    all_ = shared(scored(phrases, words), "phrase-scores")
    kept = all_.join(contained(phrases).hint("merge"), ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
