"""A recipe is a list of cleaning steps; running a prefix of it gives any earlier version.

DataFrames never change, so there is nothing to copy and nothing to undo: ``replay(df, 0)``
is the raw table, ``replay(df, k)`` the table after ``k`` steps. The audit is counted on the
rows themselves, not by accumulators, so a task that runs twice is not counted twice.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.functions.columns import ROW_INDEX, col, dtype, is_numeric, is_text
from sparkscrub.operators.cleaned import Cleaner, bind, clean
from sparkscrub.operators.contacts import contact_cleaner
from sparkscrub.operators.convert import type_converter
from sparkscrub.operators.dates import date_cleaner
from sparkscrub.operators.dedupe import remove_duplicates
from sparkscrub.operators.emails import email_cleaner
from sparkscrub.operators.names import name_cleaner
from sparkscrub.operators.nulls import blanks_to_null, drop_null_rows, fill_cleaner, statistic_fills, with_gaps
from sparkscrub.operators.ordered_fill import ordered_fill
from sparkscrub.operators.strings import all_text, empty_to_null_cleaner, string_cleaner

# The counters of an audit.
COUNTERS = (
    "duplicate_rows_removed",
    "null_values_handled",
    "whitespace_issues_fixed",
    "name_values_cleaned",
    "contact_values_cleaned",
    "email_values_cleaned",
    "date_values_converted",
    "data_types_fixed",
)

_CELL_OPS = {
    "clean_strings": (string_cleaner, "whitespace_issues_fixed"),
    "empty_to_null": (empty_to_null_cleaner, "null_values_handled"),
    "clean_names": (name_cleaner, "name_values_cleaned"),
    "clean_contacts": (contact_cleaner, "contact_values_cleaned"),
    "clean_emails": (email_cleaner, "email_values_cleaned"),
    "clean_dates": (date_cleaner, "date_values_converted"),
    "convert": (type_converter, "data_types_fixed"),
    "fill": (fill_cleaner, "null_values_handled"),
}

_FRAME_OPS = {
    "clean_all_strings": "whitespace_issues_fixed",
    "dedupe": "duplicate_rows_removed",
    "drop_nulls": "null_values_handled",
    "mean": "null_values_handled",
    "median": "null_values_handled",
    "mode": "null_values_handled",
    "ffill": "null_values_handled",
    "bfill": "null_values_handled",
    "impute": "null_values_handled",
}

_FLAG = "_changed_"
_TEXT_GAP = "Unknown"


@dataclass(frozen=True)
class Step:
    op: str
    column: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.op not in _CELL_OPS and self.op not in _FRAME_OPS:
            raise ValueError(f"unknown step {self.op!r}")

    @property
    def counter(self) -> str:
        return _CELL_OPS[self.op][1] if self.op in _CELL_OPS else _FRAME_OPS[self.op]

    @property
    def drops_rows(self) -> bool:
        return self.op in ("dedupe", "drop_nulls")

    def cleaners(self, df: DataFrame, index: str) -> dict[str, Cleaner]:
        """The step as cell cleaners. Fills by a statistic measure ``df`` first."""
        if self.op in _CELL_OPS:
            return {self.column: _CELL_OPS[self.op][0](**self.options)}
        if self.op == "clean_all_strings":
            return all_text(df, **self.options)
        names = [c for c in df.columns if c != index and not c.startswith(_FLAG)]
        if self.op == "impute":
            # Only columns with gaps are measured, so that complete ones keep their type.
            numbers = with_gaps(df, [n for n in names if is_numeric(dtype(df, n))])
            texts = {n: fill_cleaner(_TEXT_GAP) for n in names if is_text(dtype(df, n))}
            return texts | statistic_fills(df, numbers, "median", fallback=None)
        wanted = [self.column] if self.column else names
        return statistic_fills(df, wanted, self.op, **self.options)

    def apply(self, df: DataFrame, index: str) -> DataFrame:
        if self.op == "dedupe":
            return remove_duplicates(df, index=index, **self.options)
        if self.op == "drop_nulls":
            return drop_null_rows(blanks_to_null(df, [self.column] if self.column else None), self.column)
        if self.op in ("ffill", "bfill"):
            return ordered_fill(df, self._fill_columns(df, index), self.op == "bfill", index)
        return clean(df, self.cleaners(df, index))

    def _fill_columns(self, df: DataFrame, index: str) -> list[str]:
        return [self.column] if self.column else [c for c in df.columns if c != index and not c.startswith(_FLAG)]

    def apply_flagged(self, df: DataFrame, index: str, flag: str) -> DataFrame:
        """Apply a step that keeps all rows, with the number of changed cells per row in ``flag``."""
        if self.op in ("ffill", "bfill"):
            names = self._fill_columns(df, index)
            was = {f"{flag}_was_{i}": col(n) for i, n in enumerate(names)}
            after = ordered_fill(df.withColumns(was), names, self.op == "bfill", index)
            changed = [(~col(n).eqNullSafe(F.col(w))).cast("int") for n, w in zip(names, was)]
            return after.withColumn(flag, _add(changed)).drop(*was)
        bound = bind(df, self.cleaners(df, index))
        changed = [F.coalesce(c.changed, F.lit(False)).cast("int") for c in bound.values()]
        return df.withColumns({n: c.value for n, c in bound.items()} | {flag: _add(changed)})


def _add(parts):
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()
    index: str = ROW_INDEX

    def add(self, op: str, column: str | None = None, **options: Any) -> Recipe:
        return Recipe((*self.steps, Step(op, column, options)), self.index)

    def replay(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """The table after the first ``upto`` steps (all by default; 0 is the raw table)."""
        for step in self.steps[:upto]:
            df = step.apply(df, self.index)
        return df

    def run_flagged(self, df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The final table with a change flag per step, and the frames before each row drop.

        Each frame carries the flags of the steps since the row drop before it.
        """
        frames = []
        for i, step in enumerate(self.steps):
            if step.drops_rows:
                frames.append(df)
                df = step.apply(df.drop(*_flags(df)), self.index)
            else:
                df = step.apply_flagged(df, self.index, f"{_FLAG}{i}")
        return df, [*frames, df]

    def audit(self, df: DataFrame) -> DataFrame:
        """One row per step, in order: what it did to how many cells, rows before and after."""
        _, frames = self.run_flagged(df)
        return audit_rows(self.steps, frames)

    @property
    def streamable(self) -> bool:
        return all(s.op in _CELL_OPS or s.op == "clean_all_strings" for s in self.steps)


def _flags(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(_FLAG)]


def strip_flags(df: DataFrame) -> DataFrame:
    return df.drop(*_flags(df))


def audit_rows(steps: Iterable[Step], frames: list[DataFrame]) -> DataFrame:
    """Count the flags: one aggregation per frame, each giving one row of sums."""
    steps = list(steps)
    spark = frames[0].sparkSession
    totals = []
    for frame in frames:
        flags = _flags(frame)
        sums = [F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in flags]
        totals.append(frame.agg(F.count(F.lit(1)).alias("rows"), *sums).first().asDict())
    lines, at = [], 0
    for i, step in enumerate(steps):
        before = totals[at]["rows"]
        if step.drops_rows:
            at += 1
            cells = before - totals[at]["rows"]
        else:
            cells = totals[at][f"{_FLAG}{i}"]
        counted = (1 if cells else 0) if step.counter == "data_types_fixed" else cells
        lines.append((i + 1, step.op, step.column, step.counter, cells, counted, before, totals[at]["rows"]))
    schema = (
        "step int, op string, column string, counter string, cells_changed bigint, counted bigint, "
        "rows_in bigint, rows_out bigint"
    )
    return spark.createDataFrame(lines, schema)


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: the eight counters, rows before and after, number of actions that did something."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("counted"))), F.lit(0)).alias(c) for c in COUNTERS
    ]
    return audit.agg(
        *sums,
        F.min_by("rows_in", "step").alias("rows_before"),
        F.max_by("rows_out", "step").alias("rows_after"),
        F.count_if(F.col("cells_changed") > 0).alias("actions"),
    )
