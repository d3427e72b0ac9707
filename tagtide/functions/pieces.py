"""Word -> subword pieces, as SQL lambda text usable inside ``transform``.

The built-in splitter cuts a word into fixed-width pieces of at most ``width``
characters (``(?s)`` so that every character counts).  It is a pure
expression: JVM-side, and checkable against any SQL engine with regex lists.
"""

from __future__ import annotations

DEFAULT_WIDTH = 4

# Special pieces around and after a sentence.
START_PIECE = "[CLS]"
END_PIECE = "[SEP]"
PAD_PIECE = "[PAD]"


def fixed_width_sql(word: str, width: int = DEFAULT_WIDTH) -> str:
    """SQL text: array of pieces of ``word``."""
    return f"regexp_extract_all({word}, '(?s).{{1,{int(width)}}}', 0)"
