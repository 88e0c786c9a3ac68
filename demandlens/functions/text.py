"""Column helpers for text: strip, split, letters, years, and the text gate."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens import rules


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def strip(c) -> Column:
    """Remove white space of every kind from both ends (plain ``trim`` removes spaces only)."""
    return F.trim(as_col(c), F.lit(rules.WHITESPACE))


def normalize_skill(c) -> Column:
    return F.lower(strip(c))


def has_odd_space(c) -> Column:
    """Whether white space other than the plain space occurs.

    Trimming spaces alone is many times faster than ``strip``, so lists are tested once as a whole
    and their items stripped only where it makes a difference.
    """
    return F.coalesce(as_col(c).rlike(rules.ODD_SPACE_PATTERN), F.lit(False))


def split_skills(c) -> Column:
    """A comma list as an array: items stripped, empty ones dropped, order and repeats kept."""
    items = F.split(F.coalesce(as_col(c), F.lit("")), ",")
    stripped = F.when(has_odd_space(c), F.transform(items, strip)).otherwise(F.transform(items, lambda s: F.trim(s)))
    return F.filter(stripped, lambda s: s != "")


def letters(c) -> Column:
    """How many letters, in any script, the text has."""
    return F.length(F.regexp_replace(as_col(c), r"[^\p{L}]+", ""))


def is_valid_text(c) -> Column:
    """The intake gate: at least 200 characters once stripped, and more than 100 letters."""
    c = as_col(c)
    long_enough = F.length(strip(c)) >= rules.MIN_TEXT_CHARS
    # Stops at the letter that decides, where counting would go through the whole text.
    enough_letters = c.rlike(rf"(?:\p{{L}}[^\p{{L}}]*+){{{rules.MIN_LETTERS_EXCLUSIVE + 1}}}")
    return F.coalesce(long_enough & enough_letters, F.lit(False))


def max_years(lowered) -> Column:
    """The largest "N years" in lowercase text, 0 if there is none."""
    lowered = as_col(lowered)
    found = F.regexp_extract_all(lowered, F.lit(rules.YEARS_PATTERN), F.lit(1))
    numbers = F.transform(found, lambda d: F.coalesce(d.try_cast("int"), F.lit(rules.OVERFLOW_YEARS)))
    # Most text says nothing of years: a plain substring test spares it the regular expression.
    return F.coalesce(F.when(lowered.contains("year"), F.array_max(numbers)), F.lit(0))


def replace_all(c, pairs) -> Column:
    """Literal replacements, one after the other."""
    c = as_col(c)
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def fill(template: str, **columns) -> Column:
    """A ``str.format`` template with columns in place of its fields.  Null columns read as empty."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(as_col(columns[field]).cast("string"), F.lit("")))
    return F.concat(*parts)
