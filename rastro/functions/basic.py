"""Small Column helpers: blanks, whitespace, membership, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in source texts.
SPACES = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE_RUN = "[" + SPACES + "]+"
# What has to be replaced for every run of white space to become one plain space.
UNTIDY_SPACE = "[" + SPACES + "]{2,}|[" + SPACES[1:] + "]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def nonblank(c) -> Column:
    """NULL and the empty string are both "missing"."""
    return col(c).isNotNull() & (col(c) != "")


def blank(c) -> Column:
    return col(c).isNull() | (col(c) == "")


def filled(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*cols) -> Column:
    """The first value that is neither NULL nor empty; the last argument is returned as it is."""
    *head, tail = [col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], tail)


def low(c) -> Column:
    return F.lower(col(c))


def contains_any(c, words) -> Column:
    """True when the lower-cased text contains one of the plain words."""
    return F.lower(col(c)).rlike("|".join(words))


def let(value, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.transform(F.array(col(value)), use)[0]


def rate(part, whole, digits: int = 1) -> Column:
    """Percentage rounded half-even; NULL when the whole is zero."""
    return F.bround(100 * (col(part) / F.nullif(col(whole), F.lit(0))), digits)


def half_up_pct(part, whole) -> Column:
    """Whole percentage rounded half-up; zero when the whole is zero."""
    ratio = col(part) / F.nullif(col(whole), F.lit(0))
    return F.coalesce(F.floor(ratio * 100 + F.lit(0.5)), F.lit(0)).cast("bigint")


def count_if(cond) -> Column:
    return F.count_if(cond)
