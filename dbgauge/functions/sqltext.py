"""SQL statement fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dbgauge.functions.text import WS, ascii_lower

_LITERALS = r"""'[^']*+'|"[^"]*+"|[0-9][0-9.]*+"""
_OPEN_QUOTE = r"""(?s)['"].*\z"""


def fingerprint(sql: Column) -> Column:
    """Statement shape: literals become ``?``, white space one space, A-Z lowercase.

    Quoted spans have no escapes (``'it''s'`` gives ``??``), an unterminated quote hides the rest,
    and digits count as literals inside identifiers too (``t1`` gives ``t?``).
    """
    shape = F.regexp_replace(sql, _LITERALS, "?")
    shape = F.regexp_replace(shape, _OPEN_QUOTE, "")
    shape = F.trim(F.regexp_replace(shape, rf"{WS}++", " "))
    return ascii_lower(shape)
