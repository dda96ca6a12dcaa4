"""Text functions (strip, collapse, case, set membership, splitting)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character with the Unicode white space property, NBSP included.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# (?U) makes \s and \S follow the same property; plain \s misses NBSP.
_SPACE_RUN = r"(?U)\s+"
_VISIBLE = r"(?U)\S"

CASES = ("lower", "upper", "title", "capitalize")


def strip(c: Column) -> Column:
    """Both ends without white space. Looks at the ends only, where a regex reads all."""
    return F.btrim(c, F.lit(SPACES))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE_RUN, " ")


def drop_spaces(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE_RUN, "")


def is_blank(c: Column) -> Column:
    """True where the text has no visible character; null stays null."""
    return ~c.rlike(_VISIBLE)


def blank_to_null(c: Column, value: Column | None = None) -> Column:
    """Null where ``c`` is blank, else ``value`` (``c`` itself by default)."""
    return F.when(c.rlike(_VISIBLE), c if value is None else value)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters: ``o'neil`` gives ``O'Neil``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def is_title_case(c: Column) -> Column:
    """The same as ``c == title_case(c)``, answered at the first letter that breaks the rule."""
    return ~c.rlike(r"(?<!\p{L})\p{Ll}|\p{L}\p{Lu}")


def apply_case(c: Column, case: str | None) -> Column:
    if case is None:
        return c
    if case not in CASES:
        raise ValueError(f"case must be one of {CASES} or None, not {case!r}")
    return {"lower": F.lower, "upper": F.upper, "title": title_case, "capitalize": capitalize}[case](c)


def is_any_of(c: Column, words: Iterable[str]) -> Column:
    return c.isin(*sorted(words))


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def iso_text(c: Column) -> Column:
    """Date or timestamp as ISO text."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

