"""E-mail cleaner."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkscrub.functions import text
from sparkscrub.operators.cleaned import Cleaned, Cleaner

# Misspelt domains and what they should be.
DOMAIN_FIXES = {
    "gmai.com": "gmail.com",
    "gamil.com": "gmail.com",
    "gmial.com": "gmail.com",
    "gmaill.com": "gmail.com",
    "gmaik.com": "gmail.com",
    "yaho.com": "yahoo.com",
    "yahooo.com": "yahoo.com",
    "yaho.co.in": "yahoo.co.in",
    "hotmial.com": "hotmail.com",
    "hotmaill.com": "hotmail.com",
    "outlok.com": "outlook.com",
    "outloo.com": "outlook.com",
}

# The accepted form of an address, and texts that stand for none.
VALID_EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
NULL_WORDS = ("nan", "null", "none", "n/a")

# Reject reasons.
NO_AT = "Missing '@' symbol"
NO_EXTENSION = "Missing domain extension (e.g. .com)"
BAD_SYNTAX = "Invalid email characters/syntax"


def _fix_domain(email: Column) -> Column:
    """One replacement per right domain, for all its misspellings after the first ``@``."""
    for right in sorted(set(DOMAIN_FIXES.values())):
        wrong = "|".join(re.escape(w) for w, r in DOMAIN_FIXES.items() if r == right)
        email = F.regexp_replace(email, rf"^([^@]*)@(?:{wrong})\z", f"$1@{right}")
    return email


def email_cleaner(
    lowercase: bool = True,
    trim_spaces: bool = True,
    remove_inner_spaces: bool = True,
    fix_domain_typos: bool = True,
) -> Cleaner:
    """Normalise an address; rejects keep their value and get a reason."""

    def cleaner(c: Column, dt: DataType) -> Cleaned:
        old = c.cast("string")
        email = old
        if remove_inner_spaces:
            email = text.drop_spaces(email)
        elif trim_spaces:
            email = text.strip(email)
        if lowercase:
            email = F.lower(email)
        if fix_domain_typos:
            email = _fix_domain(email)
        passed = F.lower(old).isin("", *NULL_WORDS)
        new = F.when(passed, old).otherwise(email)
        why = (
            F.when(~new.contains("@"), F.lit(NO_AT))
            .when(~text.after_last(new, "@").contains("."), F.lit(NO_EXTENSION))
            .otherwise(F.lit(BAD_SYNTAX))
        )
        return Cleaned(new, old != new, ~passed & ~new.rlike(VALID_EMAIL), why)

    return cleaner


def is_valid_email(c: Column) -> Column:
    return c.rlike(VALID_EMAIL)
