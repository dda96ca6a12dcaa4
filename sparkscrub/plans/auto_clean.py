"""Profile, decide, clean, impute: the one-call cleaning of a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from sparkscrub.functions.columns import ROW_INDEX
from sparkscrub.operators.cleaned import Cleaner
from sparkscrub.operators.quality import Profile, profile_dataset
from sparkscrub.operators.strings import string_cleaner
from sparkscrub.plans.recipe import Recipe, Step, audit_rows, strip_flags
from sparkscrub.session import written_table


@dataclass(frozen=True)
class AutoClean:
    data: DataFrame
    recipe: Recipe
    before: Profile
    after: Profile
    frames: list[DataFrame]
    """The raw table and the cleaned one with the change flags of its steps."""

    @cached_property
    def audit(self) -> DataFrame:
        """One row per step; counted when first asked for."""
        return audit_rows(self.recipe.steps, self.frames)


_TEN_DIGITS = {"normalize_10_digits": True, "country_code": "91"}

# What a profile finding asks for: by its action, else by the detected type. (step, options, toggle of auto_clean)
_FIXES: dict[str, tuple[str, dict, str | None]] = {
    **dict.fromkeys(("Clean Names", "Clean Name", "Name"), ("clean_names", {}, "names")),
    **dict.fromkeys(("Clean Email", "Email"), ("clean_emails", {}, "emails")),
    **dict.fromkeys(("Clean Contact", "Clean Phone", "Phone"), ("clean_contacts", _TEN_DIGITS, "contacts")),
    **dict.fromkeys(("Fix Date", "Date"), ("clean_dates", {}, "dates")),
    **{f"Convert to {t}": ("convert", {"target_type": t}, "types") for t in ("Integer", "Float", "Boolean", "Date", "String")},
}
_PLAIN_FIX = ("clean_strings", {}, None)


def _fix(detected_type: str, action: str | None) -> tuple[str, dict, str | None]:
    return _FIXES.get(action or "") or _FIXES.get(detected_type) or _PLAIN_FIX


def quick_fix(column: str, detected_type: str, action: str | None) -> Step:
    """The step a profile finding asks for. What the table does not know gets the text cleaner."""
    op, options, _ = _fix(detected_type, action)
    return Step(op, column, dict(options))


def quick_fix_cleaner(detected_type: str, action: str | None) -> Cleaner:
    step = quick_fix("c", detected_type, action)
    return step.cleaners(None, ROW_INDEX)["c"] if step.op != "clean_strings" else string_cleaner()


def plan_columns(types: Iterable[Mapping], allowed: set[str]) -> list[Step]:
    """One targeted step per column that needs it. Names are always tidied, others if flagged."""
    steps = []
    for t in types:
        if t["action"] in (None, "Trim Spaces") and t["detected_type"] != "Name":
            continue
        if _fix(t["detected_type"], t["action"])[2] in allowed:
            steps.append(quick_fix(t["column"], t["detected_type"], t["action"]))
    return steps


def auto_clean(
    df: DataFrame,
    duplicates: bool = True,
    strings: bool = True,
    names: bool = True,
    emails: bool = True,
    contacts: bool = True,
    dates: bool = True,
    nulls: bool = True,
    types: bool = True,
    mode: str = "full",
    index: str = ROW_INDEX,
) -> AutoClean:
    """Drop duplicate rows, clean each column by its detected type, tidy text, fill gaps.

    Numeric gaps get the median, text gaps ``Unknown``; gaps in other types stay. The table
    is written once to the shared folder after the cell cleaners: the medians, the audit and
    the second profile then read single columns of it and repeat no earlier work.
    """
    before = profile_dataset(df, index=index, mode=mode)
    found = before.types.orderBy("position").collect()
    allowed = {
        k for k, on in dict(names=names, emails=emails, contacts=contacts, dates=dates, types=types).items() if on
    }
    recipe = Recipe(index=index)
    if duplicates:
        recipe = recipe.add("dedupe")
    recipe = Recipe((*recipe.steps, *plan_columns(found, allowed)), index)
    if strings:
        recipe = recipe.add("clean_all_strings")
    flagged, frames = recipe.run_flagged(df)
    staged = written_table(flagged, "auto-clean")
    frames[-1] = staged
    data = staged
    if nulls:
        fill = Step("impute")
        recipe = Recipe((*recipe.steps, fill), index)
        data = fill.apply_flagged(staged, index, f"_changed_{len(recipe.steps) - 1}")
        frames[-1] = data
    result = strip_flags(data)
    after = profile_dataset(result, index=index, mode=mode)
    return AutoClean(result, recipe, before, after, frames)
