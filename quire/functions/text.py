"""Scalar text expressions. Lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() has it, as a Java character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: A text with more than white space.
NOT_BLANK = f"[^{SPACE}]"
#: Marks that end a sentence, marks skipped after one, and symbol-only lines.
SENTENCE_END = "。．！？!?」』”)］】〉》…‥"
TRAIL_SKIP = " \t\r\n　「」『』（）()［］[]｛｝{}〈〉《》…‥、，,．.。!！?？"
SYMBOL_ONLY = r"^[\s＊*☆★※─—ー＝=・･+＋#＃~～〈〉《》「」『』\[\]()（）]+\z"
VOLUME = r"^第[一二三四五六七八九十]+部\z"
IDEOGRAPHIC_SPACE = "　"
NOT_HAN = "[^一-鿿㐀-䶿々〆〇]+"


def strip(x: Column) -> Column:
    """Remove white space at both ends, as Python's str.strip() does."""
    return F.regexp_replace(F.regexp_replace(x, f"^[{SPACE}]+", ""), f"[{SPACE}]+\\z", "")


def strip_end_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\n+\\z", "")


def tail_newlines(x: Column) -> Column:
    return F.length(x) - F.length(strip_end_newlines(x))


def clipped(x: Column, n: int) -> Column:
    """At most n characters of a text, for messages."""
    return F.left(x, F.lit(n))


def without_bom(x: Column) -> Column:
    """Up to two byte-order marks go: one of the encoding, one that was written as text."""
    return F.regexp_replace(x, "^﻿{1,2}", "")


def line_ending(x: Column) -> Column:
    """LF, CRLF, MIXED or NONE."""
    crlf = F.regexp_count(x, F.lit("\r\n"))
    lf = F.regexp_count(x, F.lit("\n")) - crlf
    return F.when((crlf > 0) & (lf > 0), "MIXED").when(crlf > 0, "CRLF").when(lf > 0, "LF").otherwise("NONE")


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def han_only(x: Column) -> Column:
    """The Han characters of a text, with iteration, closing and zero marks: inline readings drop out."""
    return F.regexp_replace(x, NOT_HAN, "")


def is_symbol_or_short(x: Column) -> Column:
    """Lines of at most 3 code points, or without letters and digits."""
    return (F.length(x) <= 3) | x.rlike(r"^[^\p{L}\p{N}]+\z")
