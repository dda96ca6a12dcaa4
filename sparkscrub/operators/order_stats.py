"""Exact column statistics that never gather a column in one task: mean, median, mode."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions.columns import col, dtype, is_numeric, is_text, nan_to_null
from sparkscrub.functions.numbers import parse_double

SMALL = 1 << 20
"""Up to this many values an order statistic is read off directly."""

_ACCURACY = 10_000


def numeric_form(c: Column, dt: T.DataType) -> Column:
    """The column as DOUBLE: text is parsed, other types have no numeric value."""
    if is_numeric(dt):
        return nan_to_null(c.cast("double"), T.DoubleType())
    if is_text(dt):
        return parse_double(c)
    return F.lit(None).cast("double")


def _numeric(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([numeric_form(col(n), dtype(df, n)).alias(f"v{i}") for i, n in enumerate(names)])


def column_means(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Mean of every named column, in one pass."""
    if not names:
        return {}
    values = _numeric(df, names)
    row = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    return {n: row[f"v{i}"] for i, n in enumerate(names)}


def column_medians(df: DataFrame, names: list[str], small: int | None = None) -> dict[str, float | None]:
    """Exact median of every named column: the middle ranks of all columns are searched together."""
    plain = lambda n: col(n).cast("double") if is_numeric(dtype(df, n)) else numeric_form(col(n), dtype(df, n))  # noqa: E731  NaN is left out later
    return _medians(df.select([plain(n).alias(f"v{i}") for i, n in enumerate(names)]), names, small)


def _medians(values: DataFrame, names: list[str], small: int | None) -> dict[str, Any]:
    """Mean of the one or two middle values of columns v0, v1, ... by name; None where there are no values."""
    if not names:
        return {}
    searches = []
    for r in _extents(values):
        scale, n = getattr(values.schema[r["column"]].dataType, "scale", None), r["n"]
        least, most = _code(r["least"], scale), _code(r["most"], scale)
        bits = 64 if scale is None else 128
        depth = (bits - (least ^ most).bit_length()) // _WINDOW  # what all values begin with is not searched
        searches += [_Search(r["column"], scale, k, n, depth, least >> (bits - depth * _WINDOW)) for k in sorted({(n - 1) // 2, n // 2})]
    _find(values, searches, SMALL if small is None else small)
    found = {c: [s.found for s in searches if s.column == c] for c in values.columns}
    return {name: sum(found[c]) / len(found[c]) if found[c] else None for name, c in zip(names, values.columns)}


_WINDOW = 16
"""Bits of a number's code that one round looks at."""


@dataclass
class _Search:
    """One rank that is searched among ``inside`` values whose codes begin with the ``depth`` windows of ``prefix``.

    A code is an unsigned number in the order of the values: 64 bits for DOUBLE, 128 for DECIMAL, whose scale is given."""

    column: str
    scale: int | None
    rank: int
    inside: int
    depth: int = 0
    prefix: int = 0
    found: Any = None

    @property
    def group(self) -> tuple[str, int, int]:
        return self.column, self.depth, self.prefix

    @property
    def whole(self) -> bool:
        return self.depth * _WINDOW == (64 if self.scale is None else 128)

    def settle(self, code: int) -> None:
        if self.scale is None:
            bits = code ^ (1 << 63) if code >> 63 else code ^ ((1 << 64) - 1)
            self.found = struct.unpack("<d", struct.pack("<Q", bits))[0]
        else:
            self.found = Decimal(f"{code - (1 << 127)}E-{self.scale}")


def _code(words: Row, scale: int | None) -> int:
    """The code that two signed numbers in its order stand for."""
    high, low = words["high"] + (1 << 63), words["low"] + (1 << 63)
    return high if scale is None else high << 64 | low


def _words(high: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes as two signed numbers in their order."""
    sign = np.uint64(1 << 63)
    return (high ^ sign).view(np.int64), np.full(len(high), -1 << 63, np.int64) if low is None else (low ^ sign).view(np.int64)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """The codes of the values present in a column without NaN: their upper 64 bits and, for DECIMAL, the lower ones."""
    if pa.types.is_decimal(column.type):
        present = column.drop_null()
        words = np.frombuffer(present.buffers()[1] or b"", np.uint64).reshape(-1, 2)[present.offset:present.offset + len(present)]
        return words[:, 1] ^ np.uint64(1 << 63), words[:, 0]
    x = column.to_numpy(zero_copy_only=False)
    bits = (x[~np.isnan(x)] + 0.0).view(np.int64)  # one zero
    return (bits ^ ((bits >> 63) | np.int64(-1 << 63))).view(np.uint64), None


def _inside(high: np.ndarray, low: np.ndarray | None, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The codes that begin with ``depth`` windows."""
    upper = min(depth, 64 // _WINDOW)
    rest = depth - upper
    if not upper:
        return high, low
    fits = high >> np.uint64(64 - upper * _WINDOW) == np.uint64(prefix >> (rest * _WINDOW))
    if rest:
        fits &= low >> np.uint64(64 - rest * _WINDOW) == np.uint64(prefix & ((1 << rest * _WINDOW) - 1))
    return high[fits], None if low is None else low[fits]


def _find(values: DataFrame, searches: list[_Search], small: int) -> None:
    """Settle all searches together: a round counts, in one scan, the values of each by the next window of their
    codes, and goes on in the window's value that holds the rank. There are at most four rounds for DOUBLE and eight for
    DECIMAL, whatever the values are; what is left, at most ``small`` values each, is sorted by search."""
    for s in searches:
        if s.whole:  # all values are the same
            s.settle(s.prefix)
    while open_ := [s for s in searches if s.found is None and s.inside > small]:
        groups = list(dict.fromkeys(s.group for s in open_))
        counts = _window_counts(values, groups).groupBy("group", "bin").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("group").orderBy("bin")))
        here = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)
        held = upto.select("*", F.explode(F.filter(_ranks(groups, open_), here)).alias("rank")).collect()
        at = {(groups[r["group"]], r["rank"]): r for r in held}
        for s in open_:
            r = at[s.group, s.rank]
            s.rank, s.inside = s.rank - (r["upto"] - r["n"]), r["n"]
            s.depth, s.prefix = s.depth + 1, s.prefix << _WINDOW | r["bin"]
            if s.whole:
                s.settle(s.prefix)
    left = [s for s in searches if s.found is None]
    if left:
        groups = list(dict.fromkeys(s.group for s in left))
        lists = _held_codes(values, groups).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("v"))
        rows = lists.select("group", "v", F.explode(_ranks(groups, left)).alias("rank")).select("group", "rank", F.get("v", F.col("rank").cast("int")).alias("v")).collect()
        at = {(groups[r["group"]], r["rank"]): r["v"] for r in rows}
        for s in left:
            s.settle(_code(at[s.group, s.rank], s.scale))


def _ranks(groups: list[tuple], searches: list[_Search]) -> Column:
    """The ranks that are searched in a row's group."""
    return F.get(F.array(*[F.array(*[F.lit(r).cast("long") for r in sorted({s.rank for s in searches if s.group == g})]) for g in groups]), F.col("group"))


_TOGETHER = 8
"""Columns that go through one scan: the code Spark makes for more may be too long for the JVM to compile."""


def _scanned(values: DataFrame, groups: list[tuple], each_task: Callable, schema: str) -> DataFrame:
    """``each_task(batches, groups of each column)`` over the columns of the groups, each as (number, depth, prefix)."""
    columns, parts = list(dict.fromkeys(c for c, _, _ in groups)), []
    for i in range(0, len(columns), _TOGETHER):
        some = columns[i:i + _TOGETHER]
        own = [[(g, depth, prefix) for g, (c, depth, prefix) in enumerate(groups) if c == column] for column in some]
        parts.append(values.select(*some).mapInArrow(lambda batches, own=own: each_task(batches, own), schema))
    return reduce(DataFrame.unionByName, parts)


def _extents(values: DataFrame) -> list[Row]:
    """column, n, and the codes of the least and the most value of the columns that have values."""
    def run(batches, own):
        found = {g: [] for (g, _, _), in own}
        for batch in batches:
            for column, ((g, _, _),) in zip(batch.columns, own):
                high, low = _codes(column)
                if len(high):
                    ends = [high.min(), high.max()]
                    lows = [None if low is None else low[high == ends[0]].min(), None if low is None else low[high == ends[1]].max()]
                    found[g].append((len(high), *[int(w[0]) for e, x in zip(ends, lows) for w in _words(np.array([e]), None if x is None else np.array([x]))]))
        for g, rows in found.items():
            if rows:
                n, a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_pylist([dict(zip(names, (g, sum(n), *min(zip(a, b)), *max(zip(c, d)))))], schema=shape)

    names = ("group", "n", "high", "low", "high2", "low2")
    shape = pa.schema([("group", pa.int32())] + [(n, pa.int64()) for n in names[1:]])
    ends = _scanned(values, [(c, 0, 0) for c in values.columns], run, "group int, n long, high long, low long, high2 long, low2 long")
    each = ends.groupBy("group").agg(F.sum("n").alias("n"), F.min(F.struct("high", "low")).alias("least"),
                                     F.max(F.struct(F.col("high2").alias("high"), F.col("low2").alias("low"))).alias("most"))
    return each.select(F.get(F.array(*[F.lit(c) for c in values.columns]), F.col("group")).alias("column"), "n", "least", "most").collect()


def _window_counts(values: DataFrame, groups: list[tuple]) -> DataFrame:
    """group, bin, n: how many values of a group have each value of its next window, by task."""
    def run(batches, own):
        counts = {g: np.zeros(1 << _WINDOW, np.int64) for some in own for g, _, _ in some}
        for batch in batches:
            for column, some in zip(batch.columns, own):
                codes = _codes(column)
                for g, depth, prefix in some:
                    word, at = divmod(depth * _WINDOW, 64)
                    bins = _inside(*codes, depth, prefix)[word] >> np.uint64(64 - _WINDOW - at) & np.uint64((1 << _WINDOW) - 1)
                    np.add.at(counts[g], bins.astype(np.int64), 1)
        for g, found in counts.items():
            bins = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bins), g, np.int32)), pa.array(bins.astype(np.int32)), pa.array(found[bins])], names=["group", "bin", "n"])

    return _scanned(values, groups, run, "group int, bin int, n long")


def _held_codes(values: DataFrame, groups: list[tuple]) -> DataFrame:
    """group, high, low: the codes of all values in the groups, as signed numbers in their order."""
    def run(batches, own):
        for batch in batches:
            for column, some in zip(batch.columns, own):
                codes = _codes(column)
                for g, depth, prefix in some:
                    high, low = _words(*_inside(*codes, depth, prefix))
                    if len(high):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), g, np.int32)), pa.array(high), pa.array(low)], names=["group", "high", "low"])

    return _scanned(values, groups, run, "group int, high long, low long")


def exact_means(df: DataFrame, names: list[str]) -> dict[str, Decimal | None]:
    """Means of whole-number and DECIMAL columns in decimal arithmetic, in one pass."""
    if not names:
        return {}
    row = df.agg(*[F.avg(col(n).cast(_decimal(dtype(df, n)))).alias(f"v{i}") for i, n in enumerate(names)]).first()
    return dict(zip(names, row))


def exact_medians(df: DataFrame, names: list[str], small: int | None = None) -> dict[str, Decimal | None]:
    """Medians of whole-number and DECIMAL columns in decimal arithmetic."""
    return _medians(df.select([col(n).cast(_decimal(dtype(df, n))).alias(f"v{i}") for i, n in enumerate(names)]), names, small)


def _decimal(dt: T.DataType) -> T.DataType:
    return dt if isinstance(dt, T.DecimalType) else T.DecimalType(20, 0)


def nth_value(values: DataFrame, n: int, k: int, small: int | None = None) -> float:
    """The ``k``-th smallest (from 0) of the ``n`` non-null numbers (or times) in column ``v``."""
    small = SMALL if small is None else small
    v = F.col("v")
    rounded = isinstance(dtype(values, "v"), (T.LongType, T.DecimalType))
    lo = hi = None
    below, inside = 0, n
    while True:
        part = values
        if lo is not None:
            part = part.filter(v > lo)
        if hi is not None:
            part = part.filter(v < hi)
        rank = k - below
        if inside <= small:
            return part.orderBy(v).offset(rank).limit(1).first()[0]
        share, slack = rank / inside, 2 / _ACCURACY
        ends = [max(0.0, share - slack), min(1.0, share + slack)]
        a, b = part.agg(F.percentile_approx(v, ends, _ACCURACY)).first()[0]
        if rounded:  # the sketch works in DOUBLE: take the nearest values that are there
            a, b = part.agg(
                F.coalesce(F.max(F.when(v <= a, v)), F.min(v)), F.coalesce(F.min(F.when(v >= b, v)), F.max(v))
            ).first()
        under, at_a, between, at_b = part.agg(
            F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)),
            F.count_if((v == b) & F.lit(b > a)),
        ).first()
        if rank < under:
            hi, inside = a, under
        elif rank < under + at_a:
            return a
        elif rank < under + at_a + between:
            lo, hi, below, inside = a, b, below + under + at_a, between
        elif rank < under + at_a + between + at_b:
            return b
        else:
            passed = under + at_a + between + at_b
            lo, below, inside = b, below + passed, inside - passed


_STEP = 7
"""Bytes of a text that are searched at once: as many as fit a BIGINT above zero."""


def nth_text(values: DataFrame, n: int, k: int, small: int | None = None) -> str:
    """The ``k``-th smallest (from 0) of the ``n`` non-null texts in column ``v``, by their bytes.

    Some bytes at a time are read as a number and its rank is searched; only the texts that share
    them go on, until few are left or their ends are reached.
    """
    small = SMALL if small is None else small
    raw, rows, done = F.col("v").cast("binary"), values, 0
    while n > small:
        part = F.rpad(F.hex(F.substring(raw, done + 1, _STEP)), 2 * _STEP, "0")
        code = F.conv(part, 16, 10).cast("bigint")
        at = nth_value(rows.select(code.alias("v")), n, k, small)
        before, n, longest = rows.agg(
            F.count_if(code < at), F.count_if(code == at), F.max(F.when(code == at, F.octet_length("v")))
        ).first()
        rows, k, done = rows.filter(code == at), k - before, done + _STEP
        if longest <= done:  # they differ at most in zero bytes at the end
            length = nth_value(rows.select(F.octet_length("v").alias("v")), n, k, small)
            return rows.filter(F.octet_length("v") == length).first()[0]
    return rows.orderBy("v").offset(k).limit(1).first()[0]


def column_mode(df: DataFrame, name: str) -> Any | None:
    """The most frequent non-missing value, the smallest of several: a top-1 over value counts."""
    value = nan_to_null(col(name), dtype(df, name))
    top = (
        df.select(value.alias("v"))
        .filter("v IS NOT NULL")
        .groupBy("v")
        .count()
        .orderBy(F.desc("count"), F.asc("v"))
        .limit(1)
        .collect()
    )
    return top[0]["v"] if top else None
