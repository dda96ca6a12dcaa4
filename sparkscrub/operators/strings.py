"""Text cleaner, all-text cleaner, empty and placeholder text to null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkscrub.functions import text
from sparkscrub.functions.columns import data_columns, dtype, is_text, text_columns
from sparkscrub.operators.cleaned import Cleaned, Cleaner, clean, differs

# The characters that count as special.
SPECIAL = r"(?U)[^a-zA-Z0-9\s\-_\.]"

# Texts that stand for a missing value.
PLACEHOLDERS = (
    "n/a", "na", "null", "none", "nan", "-", "--", "---", "?", "nil",
    "missing", "unknown", "undefined", "#n/a", "#na", "empty",
)


def string_cleaner(
    trim_whitespace: bool = True,
    remove_extra_spaces: bool = True,
    case_transform: str | None = None,
    remove_special_chars: bool = False,
    custom_regex_replace: tuple[str, str] | None = None,
    empty_to_null: bool = True,
) -> Cleaner:
    """Strip, collapse, change case, drop special characters, replace by regex, blank to null.

    ``custom_regex_replace`` is (Java pattern, replacement with ``$1`` groups).
    """

    def cleaner(c: Column, dt: DataType) -> Cleaned:
        old = new = c.cast("string")
        if trim_whitespace:
            new = text.strip(new)
        if remove_extra_spaces:
            new = text.collapse_spaces(new)
        new = text.apply_case(new, case_transform)
        if remove_special_chars:
            new = F.regexp_replace(new, SPECIAL, "")
        if custom_regex_replace and custom_regex_replace[0]:
            new = F.regexp_replace(new, *custom_regex_replace)
        if empty_to_null:
            # Only dropping or replacing characters can blank a text that was not blank before.
            asked = new if remove_special_chars or custom_regex_replace else old
            new = text.blank_to_null(asked, new)
        return Cleaned(new, differs(old, new))

    return cleaner


def all_text(df: DataFrame, **options) -> dict[str, Cleaner]:
    """The string cleaner for every text column, ready for ``clean`` and ``count_changes``."""
    return {name: string_cleaner(**options) for name in text_columns(df)}


def clean_all_strings(df: DataFrame, **options) -> DataFrame:
    return clean(df, all_text(df, **options))


def empty_to_null_cleaner(
    include_whitespace: bool = True,
    include_placeholders: bool = True,
    custom_placeholders: Iterable[str] | None = None,
) -> Cleaner:
    """Null for blank text and placeholder words. Only text columns are touched.

    Without ``include_whitespace`` nothing is trimmed: only ``""`` is empty and a
    placeholder must fill the cell exactly (in any case).
    """
    words = set(PLACEHOLDERS) if include_placeholders else set()
    words |= {w.lower().strip() for w in custom_placeholders or () if w}

    def cleaner(c: Column, dt: DataType) -> Cleaned:
        if not is_text(dt):
            return Cleaned(c, F.lit(False))
        seen = text.strip(c) if include_whitespace else c
        hit = seen == ""
        if words:
            hit = text.is_any_of(F.lower(seen), words | {""})
        return Cleaned(F.when(~hit, c), hit)

    return cleaner


def replace_empty_with_null(df: DataFrame, columns: Iterable[str] | None = None, **options) -> DataFrame:
    names = [n for n in data_columns(df, columns) if is_text(dtype(df, n))]
    return clean(df, {name: empty_to_null_cleaner(**options) for name in names})
