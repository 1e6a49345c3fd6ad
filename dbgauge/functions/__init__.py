from dbgauge.functions.numbers import parse_double, parse_unsigned, unsigned_or_zero
from dbgauge.functions.sqltext import fingerprint
from dbgauge.functions.text import ascii_lower, clip_output, is_truthy, strip_ws
from dbgauge.functions.values import as_text, text_or_empty

__all__ = [
    "as_text",
    "ascii_lower",
    "clip_output",
    "fingerprint",
    "is_truthy",
    "parse_double",
    "parse_unsigned",
    "strip_ws",
    "text_or_empty",
    "unsigned_or_zero",
]
