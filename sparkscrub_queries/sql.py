"""Pieces of checking SQL."""

from __future__ import annotations

from sparkscrub.functions.numbers import CURRENCY
from sparkscrub.operators.emails import DOMAIN_FIXES, NULL_WORDS, VALID_EMAIL  # noqa: F401  (fixed values, stated once)
from sparkscrub.operators.names import DELIMITERS
from sparkscrub.operators.strings import PLACEHOLDERS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({strip(x)}, '\\s+', ' ', 'g')"


def title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[a-zA-Z]+|[^a-zA-Z]+')"
    return f"array_to_string(list_transform({runs}, lambda t: upper(t[1:1]) || lower(t[2:])), '')"


def no_blank(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN NULL ELSE {x} END"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def name(x: str) -> str:
    letters = f"regexp_replace(regexp_replace({x}, '{DELIMITERS}', ' ', 'g'), '[^a-zA-Z\\s]', '', 'g')"
    return title(squeeze(letters))


def ten_digits(x: str) -> str:
    d = digits(x)
    return (
        f"CASE WHEN length({d}) = 12 AND starts_with({d}, '91') THEN substr({d}, 3) "
        f"WHEN length({d}) = 11 AND starts_with({d}, '0') THEN substr({d}, 2) ELSE {d} END"
    )


def email(x: str) -> str:
    plain = f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
    cases = " ".join(f"WHEN '{w}' THEN '{r}'" for w, r in DOMAIN_FIXES.items())
    domain = f"split_part({plain}, '@', 2)"
    return (
        f"CASE WHEN lower({x}) IN {in_list(('', *NULL_WORDS))} THEN {x} "
        f"WHEN contains({plain}, '@') THEN split_part({plain}, '@', 1) || '@' || "
        f"CASE {domain} {cases} ELSE {domain} END ELSE {plain} END"
    )


DATE_FORMATS = "['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%b %d %Y', '%d %b %Y %I%p', '%d%b%Y', '%Y%m%dT%H%M%S', '%Y %m %d']"


def date(x: str) -> str:
    return f"try_strptime({x}, {DATE_FORMATS})"


def number(x: str) -> str:
    return f"TRY_CAST(regexp_replace({x}, '{CURRENCY}', '', 'g') AS DOUBLE)"


def in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def is_empty(x: str) -> str:
    return f"(lower({strip(x)}) IN {in_list(('', *PLACEHOLDERS))})"


def with_(views: str | list[str], body: str) -> str:
    views = [views] if isinstance(views, str) else views
    return f"WITH {', '.join(views)} {body}"
