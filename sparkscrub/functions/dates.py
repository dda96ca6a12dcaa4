"""Reading and writing dates as text.

Free-form dates are brought to one canonical ``y-m-d time`` text by the signature of their
numbers and separators, looked up in a table of shapes, then cast. A failed cast costs no exception, unlike a list of formatter
attempts, so a column of mixed formats stays cheap to parse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscrub.functions.text import strip

# Output names, each with its pattern.
NAMED_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "DD-MM-YYYY": "dd-MM-yyyy",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "YYYY/MM/DD": "yyyy/MM/dd",
    "DD Mon YYYY": "dd MMM yyyy",
    "YYYY-MM-DD HH:MM:SS": "yyyy-MM-dd HH:mm:ss",
}

# Strftime codes and the pattern letters that mean the same.
STRFTIME_CODES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%j": "DDD",
    "%%": "%",
}

# Texts that stand for a missing date.
NULL_WORDS = ("nan", "nat", "null", "none")

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# A month's name stands alone: short, whole, or "sept".
_MONTH_WORD = (
    r"(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
)

_ZONE = r"\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
_CLOCK = r"(?:t|\s+|,\s*)(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)" + _ZONE
_DAY_NAME = r"^(?:(?:mon|fri|sun)(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|sat(?:urday)?)\.?,?\s+"


def _shapes() -> dict[str, str]:
    """Signature of a date to the places of year, month and day among its numbers.

    In a signature y is a number of four digits, d one of one or two, m a month by name, and a blank any
    separators beside such a month. The places of a text that begins with two short numbers are those
    of day-first text.
    """
    found = {}
    for sep in "-/. ":
        found |= {f"y{sep}d{sep}d": "123", f"d{sep}d{sep}y": "321", f"d{sep}d{sep}d": "321"}
    for sep in ("", " "):
        found |= {f"y{sep}m{sep}d": "123", f"m{sep}d{sep}y": "312", f"m{sep}d{sep}d": "312", f"d{sep}m{sep}y": "321", f"d{sep}m{sep}d": "321"}
    return found


def _to_24_hours(s: Column) -> Column:
    """``3:04 pm`` and ``3pm`` at the end of the text become ``15:04`` and ``15:00``."""
    clock = r"^(.*[\s,t])(0?\d|1[0-2])((?::[0-9.]+)*)\s*([ap])m$"
    hour = F.regexp_extract(s, clock, 2).try_cast("int") % 12 + F.when(s.endswith("pm"), 12).otherwise(0)
    rest = F.regexp_extract(s, clock, 3)
    rebuilt = F.concat(F.regexp_extract(s, clock, 1), hour.cast("string"), F.when(rest == "", ":00").otherwise(rest))
    return F.when(s.endswith("m") & s.rlike(clock), rebuilt).otherwise(s)


def _spaced_out(s: Column) -> Column:
    """``20200102`` and ``20200102T030405`` with their separators."""
    compact = r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?" + _ZONE[:-1] + ")?$"
    hour, second = F.regexp_extract(s, compact, 4), F.regexp_extract(s, compact, 6)
    clock = F.when(hour == "", "").otherwise(F.concat(
        F.lit(" "), hour, F.lit(":"), F.regexp_extract(s, compact, 5), F.when(second == "", "").otherwise(F.concat(F.lit(":"), second))))
    return F.when(s.rlike(compact), F.concat(F.regexp_replace(s, compact, "$1-$2-$3"), clock)).otherwise(s)


def _number_months(s: Column) -> Column:
    """The first month word becomes ``#5#``; letters that are left fit no shape."""
    word = F.regexp_extract(s, _MONTH_WORD, 1)
    number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.left(word, F.lit(3)))
    numbered = F.regexp_replace(s, F.concat(F.lit("(?<![a-z])"), word, F.lit("(?![a-z])")), F.concat(F.lit("#"), number.cast("string"), F.lit("#")))
    return F.when(s.rlike(_MONTH_WORD), numbered).otherwise(s)


def parse_free_date(c: Column, day_first: bool = True) -> Column:
    """Text as TIMESTAMP_NTZ, null where no shape fits or the day does not exist.

    The text is cut into date and clock, and the date's signature looked up. ``day_first`` is a
    preference: where it gives a month above 12, day and month change places, so ``08/23/1995`` is
    still read. Year-first text and months by name are read one way only.
    """
    spaced = _number_months(_spaced_out(_to_24_hours(F.lower(strip(c)))))
    # One-row arrays name what is used more than once, so that each step is computed once.
    cut = F.transform(F.array(spaced), lambda s: F.struct(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _CLOCK, ""), _DAY_NAME, ""), r"(?<=\d)(?:st|nd|rd|th)\b(?:\s+of\b)?", "").alias("date"),
        F.regexp_extract(s, _CLOCK, 1).alias("clock")))
    short = [F.lit(x) for pair in _shapes().items() for x in pair]
    swapped = "^d([-/. ])d\\1[dy]$"

    def read(x: Column) -> Column:
        signed = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["date"], r"#\d{1,2}#\.?", "m"), r"(?<!\d)\d{4}(?!\d)", "y"), r"(?<!\d)\d{1,2}(?!\d)", "d")
        signed = F.when(signed.contains("m"), F.regexp_replace(signed, r"[-/.,\s]+", " ")).otherwise(signed)
        return F.struct(signed.alias("signature"), F.regexp_extract_all(x["date"], F.lit(r"\d+"), F.lit(0)).alias("numbers"), x["clock"].alias("clock"))

    def placed(x: Column) -> Column:
        def part(k: int) -> Column:
            order = F.try_element_at(F.create_map(*short), x["signature"])
            return F.try_element_at(x["numbers"], F.substring(order, k, 1).try_cast("int"))

        return F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day"), x["clock"].alias("clock"), F.regexp_like(x["signature"], F.lit(swapped)).alias("either"))

    def written(x: Column) -> Column:
        over = 12 < (x["month"] if day_first else x["day"]).cast("int")
        turn = x["either"] & (over if day_first else ~over)
        month, day = F.when(turn, x["day"]).otherwise(x["month"]), F.when(turn, x["month"]).otherwise(x["day"])
        # two-digit years: 00-68 are 20xx, 69-99 are 19xx
        year = F.when(F.length(x["year"]) == 2, F.concat(F.when(x["year"] < "69", "20").otherwise("19"), x["year"])).otherwise(x["year"])
        return F.concat(F.when(F.length(year) == 4, year), F.lit("-"), month, F.lit("-"), day, F.lit(" "), x["clock"])

    return F.transform(F.transform(F.transform(cut, read), placed), written)[0].try_cast("timestamp_ntz")


def parse_date(c: Column, input_format: str | None = None, day_first: bool = True) -> Column:
    """Free-form parse, tried after the named ``input_format`` where one is given."""
    free = parse_free_date(c, day_first)
    if input_format is None:
        return free
    exact = F.try_to_timestamp(strip(c), F.lit(input_pattern(input_format)))
    return F.coalesce(exact.cast("timestamp_ntz"), free)


def write_date(c: Column, output_format: str = "YYYY-MM-DD") -> Column:
    return F.date_format(c, output_pattern(output_format))


def output_pattern(name: str) -> str:
    """Pattern for a named format, or for a custom strftime text."""
    if name in NAMED_FORMATS:
        return NAMED_FORMATS[name]
    parts = re.split(r"(%.)", name)
    return "".join(STRFTIME_CODES.get(p) or _quoted(p) for p in parts)


def _quoted(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", literal) else literal


def input_pattern(name: str) -> str:
    """Like the output pattern, but separated one-digit days, months and hours are read too."""
    return re.sub(r"(?<![A-Za-z])([dMHhms])\1(?![A-Za-z])", r"\1", output_pattern(name))


def is_null_word(c: Column) -> Column:
    s = F.lower(strip(c))
    return (s == "") | s.isin(*NULL_WORDS)
