"""Date cleaner: mixed date texts to one format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import dates, text
from sparkscrub.operators.cleaned import Cleaned, Cleaner

# Reject reason.
UNPARSEABLE = "Could not parse date with specified rules"


def date_cleaner(
    input_format: str | None = None,
    output_format: str = "YYYY-MM-DD",
    day_first: bool = True,
    as_date: bool = False,
) -> Cleaner:
    """Rewrite dates in ``output_format``; null words become null, the rest is rejected and kept.

    ``as_date`` gives a DATE column instead of text; rejects are then null.
    """

    def cleaner(c: Column, dt: T.DataType) -> Cleaned:
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            parsed, old = c, c.cast("string")
            rejected = None
        else:
            old = text.strip(c.cast("string"))
            parsed = dates.parse_date(old, input_format, day_first)
            rejected = ~dates.is_null_word(old) & parsed.isNull()
        written = dates.write_date(parsed, output_format)
        if as_date:
            value = parsed.cast("date")
        else:
            value = F.coalesce(written, F.when(~dates.is_null_word(old), old))
        return Cleaned(value, written != old, rejected, F.lit(UNPARSEABLE), shown=old)

    return cleaner
