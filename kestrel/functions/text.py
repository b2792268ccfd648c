"""String Column functions (cleaning, keys, redaction, pattern tests)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strip(x) -> Column:
    """Strip leading/trailing Unicode whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")


def title_case(x) -> Column:
    """Capitalise the first letter of every letter run, lower-case the rest.

    Matches Python ``str.title``: a letter after any non-letter starts a new
    word, so ``d'oeste`` -> ``D'Oeste`` and ``mogi-guacu`` -> ``Mogi-Guacu``
    (``initcap`` only splits on spaces).
    """
    runs = F.regexp_extract_all(_c(x), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))),
        "",
    )


def clean_city(x) -> Column:
    return title_case(strip(x))


def clean_state(x) -> Column:
    """Upper-case, first two characters."""
    return F.substring(F.upper(_c(x)), 1, 2)


def zfill(x, width: int = 5) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole (``lpad`` would cut)."""
    s = _c(x).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


# What Python's str.split() treats as whitespace (Unicode
# White_Space plus the ASCII separators 0x1C-0x1F), and ASCII punctuation.
WHITESPACE_RUN = r"(?U)[\s\x{1C}-\x{1F}]+"
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"


def collapse_ws(x) -> Column:
    """Collapse whitespace runs to one space and trim (``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(_c(x), WHITESPACE_RUN, " "))


def question_key(x) -> Column:
    """Cache key of a question: lower, drop ASCII punctuation, collapse whitespace."""
    return collapse_ws(F.regexp_replace(F.lower(_c(x)), ASCII_PUNCT, ""))


def normalize_answer(x) -> Column:
    """Collapse all Unicode whitespace to one space, then lower-case."""
    return F.lower(collapse_ws(x))


def redact(x) -> Column:
    """First 12 hex chars of SHA-256; NULL or empty -> ``-``."""
    c = _c(x).cast("string")
    return F.when(c.isNull() | (c == ""), F.lit("-")).otherwise(F.substring(F.sha2(c, 256), 1, 12))


# Fixed value: the date-like text pattern (YYYY, YYYY-MM, YYYY-MM-DD).
DATE_LIKE = r"^\d{4}(-\d{2})?(-\d{2})?$"


def looks_like_date(x) -> Column:
    return F.coalesce(strip(_c(x).cast("string")).rlike(DATE_LIKE), F.lit(False))


def truncate(x, n: int) -> Column:
    return F.substring(_c(x).cast("string"), 1, n)
