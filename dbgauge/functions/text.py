"""Text expressions. Every function takes a Column and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Unicode white space without the (?U) flag, which would also widen (?i) beyond ASCII.
WS = r"\p{IsWhite_Space}"
NON_WS = r"\P{IsWhite_Space}"
# The characters with the Unicode property White_Space.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The output length kept, and the mark put behind a shortened output.
OUTPUT_CHARS = 4000
OUTPUT_MARK = "\n...[truncated]"

# The words that switch a setting on.
TRUTHY = ["on", "1", "true", "yes"]


def strip_ws(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes only spaces)."""
    return F.trim(text, F.lit(WS_CHARS))


def ascii_lower(text: Column) -> Column:
    """Lowercase A-Z only (``lower`` also folds other scripts)."""
    return F.translate(text, UPPER, LOWER)


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def is_truthy(text: Column) -> Column:
    return ascii_lower(strip_ws(text)).isin(TRUTHY)


def clip_output(text: Column) -> Column:
    """Strip; empty becomes NULL; more than OUTPUT_CHARS characters are cut and marked."""
    body = strip_ws(text)
    return F.when(
        F.length(body) > OUTPUT_CHARS, F.concat(F.left(body, F.lit(OUTPUT_CHARS)), F.lit(OUTPUT_MARK))
    ).otherwise(null_if_empty(body))
