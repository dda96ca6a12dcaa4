"""Phone number cleaner."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkscrub.operators.cleaned import Cleaned, Cleaner, differs

# Output styles, and the lengths that pass.
STYLES = ("digits_only", "hyphenated", "international")
MIN_DIGITS, MAX_DIGITS = 7, 15


def contact_cleaner(
    strip_non_digits: bool = True,
    normalize_10_digits: bool = False,
    format_style: str = "digits_only",
    country_code: str = "91",
    strict: bool = False,
) -> Cleaner:
    """Keep digits, drop country code or trunk zero on request, then format.

    Lengths outside 7 to 15 are rejected but kept. A number without any digit becomes ``""``
    and is rejected only under ``strict``.
    """
    if format_style not in STYLES:
        raise ValueError(f"format_style must be one of {STYLES}")
    cc = re.escape(country_code)

    def cleaner(c: Column, dt: DataType) -> Cleaned:
        old = c.cast("string")
        digits = F.regexp_replace(old, "[^0-9]+", "") if strip_non_digits else F.when(old == "nan", "").otherwise(old)
        if normalize_10_digits:
            digits = F.regexp_replace(digits, f"^(?:{cc}(?=.{{10}}$)|0(?=.{{10}}$))", "")
        new = digits
        if format_style == "hyphenated":
            new = F.regexp_replace(new, "^(.{5})(.{5})$", "$1-$2")
        elif format_style == "international":
            new = F.regexp_replace(new, "^(.{5})(.{5})$", f"+{country_code} $1 $2")
            longer = f"^(?=.{{11}}){cc}(.{{0,5}})(.*)$"
            new = F.regexp_replace(new, longer, f"+{country_code} $1 $2")
        length = F.length(digits)
        odd = ~length.between(MIN_DIGITS, MAX_DIGITS)
        rejected = odd if strict else odd & (length > 0)
        why = F.concat(F.lit("Unusual digit length ("), length.cast("string"), F.lit(")"))
        why = F.when(length == 0, F.lit("empty")).otherwise(why)
        return Cleaned(new, differs(old, new), rejected, why, shown=digits)

    return cleaner
