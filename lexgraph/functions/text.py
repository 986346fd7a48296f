"""Text column functions: sentences, words, tokens.

The patterns avoid look-behind and use only classes that Java regex and RE2
read the same way, so DuckDB reproduces every result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (the pinned text model):
#   whitespace  = tab, newline, vertical tab, form feed, carriage return, space
#   sentence    = up to a run of terminators . ! ? before whitespace or the end
#                 (with that whitespace), or the rest of the text
#   token       = a run of letters or digits, after lower-casing
WS = r"[\t\n\x0B\f\r ]"
SENTENCE_RE = r"(?s).+?[.!?]+(?:[\t\n\x0B\f\r ]+|\z)|.+\z"
TOKEN_RE = r"[\p{L}\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading and trailing whitespace (all six characters)."""
    return F.regexp_replace(_c(col), F.lit(f"^{WS}+|{WS}+$"), F.lit(""))


def words(col) -> Column:
    """Non-empty pieces of the text split on whitespace runs."""
    return F.filter(F.split(_c(col), f"{WS}+"), lambda w: w != F.lit(""))


def word_count(col) -> Column:
    return F.size(words(col))


def sentences(col) -> Column:
    """Stripped, non-empty sentence strings in text order."""
    raw = F.regexp_extract_all(_c(col), F.lit(SENTENCE_RE), 0)
    return F.filter(F.transform(raw, strip_ws), lambda s: s != F.lit(""))


def tokens(col) -> Column:
    """Lower-cased letter/digit runs (the hashed embedder's vocabulary)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_RE), 0)


def count_char(col, ch: str) -> Column:
    """Occurrences of a single character."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
