"""Name cleaner: letters only, single spaces, title case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkscrub.functions import text
from sparkscrub.operators.cleaned import Cleaned, Cleaner, differs


# What parts names, and what is dropped from them.
DELIMITERS = r"[_\-/]+"
NO_LETTERS_OR_SPACE, NO_LETTERS = r"(?U)[^a-zA-Z\s]+", "[^a-zA-Z]+"


def name_cleaner(
    alphabets_only: bool = True, case_transform: str | None = "title", allow_spaces: bool = True
) -> Cleaner:
    """Delimiters become spaces, other non-letters go. ASCII letters only, may leave ``""``."""

    def cleaner(c: Column, dt: DataType) -> Cleaned:
        old = new = c.cast("string")
        if alphabets_only:
            new = F.regexp_replace(new, DELIMITERS, " ")
            new = F.regexp_replace(new, NO_LETTERS_OR_SPACE if allow_spaces else NO_LETTERS, "")
        new = text.strip(text.collapse_spaces(new))
        if case_transform == "title" and alphabets_only:
            # Only letters and single spaces are left, where initcap is the same and cheaper.
            new = F.initcap(new)
        elif case_transform in ("title", "upper", "lower"):
            new = text.apply_case(new, case_transform)
        return Cleaned(new, differs(old, new))

    return cleaner
