"""Segmentation: a text becomes its non-blank lines with offsets, separators and hashes.

A text is one row (key, text). Its lines, offsets and separators are made inside the row; only the finished units are
exploded, so segmentation needs no exchange, and texts of any key spread over tasks as their rows do. Texts in pieces
(see pieces) are segmented by a fold over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import pieces

#: Offsets are summed by blocks of so many lines and within a block, so the work grows with the lines, not their square.
_RUN = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; an expression used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lens: Column) -> Column:
    """The sum of all lengths before each element."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)
    n = F.size(lens)
    runs = F.transform(F.sequence(F.lit(0), ((n - 1) / F.lit(_RUN)).cast("int")), lambda r: total(F.slice(lens, r * _RUN + 1, F.lit(_RUN))))
    heads = F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    at = lambda i: (i / F.lit(_RUN)).cast("int")
    return _let(heads, lambda h: F.transform(lens, lambda x, i: F.get(h, at(i)) + total(F.slice(lens, at(i) * _RUN + 1, i - at(i) * _RUN))))


def _unit_array(text: Column) -> Column:
    """The non-blank lines of a text as structs (ln, start_char, text, sep); sep counts the newlines since the last line that was not empty."""

    def placed(lines: Column, starts: Column) -> Column:
        rows = F.transform(lines, lambda x, i: F.struct(i.alias("ln"), F.get(starts, i).alias("start_char"), x.alias("text")))
        return F.filter(rows, lambda x: F.length(x["text"]) > 0)

    def spaced(rows: Column) -> Column:
        sep = lambda x, i: x["ln"] - F.when(i > 0, F.get(rows, i - 1)["ln"])
        return F.transform(rows, lambda x, i: F.struct(x["ln"].alias("ln"), x["start_char"].alias("start_char"), x["text"].alias("text"), sep(x, i).alias("sep")))

    lens = lambda lines: F.transform(lines, lambda x: F.length(x) + 1)
    made = _let(F.split(text, "\n", -1), lambda ls: _let(lens(ls), lambda n: _let(_starts(n), lambda st: _let(placed(ls, st), spaced))))
    return F.filter(made, lambda x: F.length(T.strip(x["text"])) > 0)


def units(texts: DataFrame, key: str = "source") -> DataFrame:
    """(key, ln, idx, start_char, end_char, char_count, sha256, sep_newlines, blank_before, text).

    ln counts all lines from 0, idx a text's units from 1. sep_newlines is the run of newlines just before the line; it is 0 for a
    text's first unit. A line of white space only is no unit, yet it ends such a run.
    """
    if pieces.in_pieces(texts):
        rows, sep = pieces.fold(texts, key, pieces.Units, pieces.Units.FIELDS), F.col("sep")
    else:
        rows = texts.select(key, F.posexplode(_unit_array(F.col("text"))).alias("i", "u"))
        rows = rows.select(key, (F.col("i") + 1).alias("idx"), "u.*")
        sep = F.when(F.col("idx") == 1, 0).otherwise(F.col("sep"))
    return measured(rows, sep, key)


def measured(rows: DataFrame, sep: Column, *keys: str) -> DataFrame:
    """The columns of units from keys, ln, idx, start_char, sep and text."""
    n = F.length("text")
    return rows.select(
        *keys, "ln", "idx", "start_char", (F.col("start_char") + n).alias("end_char"), n.alias("char_count"),
        T.sha256(F.col("text")).alias("sha256"), sep.cast("int").alias("sep_newlines"), F.greatest(sep - 1, F.lit(0)).cast("int").alias("blank_before"), "text",
    )


def is_heading(text: Column, blank_before: Column, strong: int = 5) -> Column:
    """A short line after many blank ones that is neither symbols, indented, nor a sentence."""
    t = T.strip(text)
    return F.length(t).between(1, 40) & ~t.rlike(T.SYMBOL_ONLY) & ~text.startswith(T.IDEOGRAPHIC_SPACE) & ~t.rlike("[。、．]\\z") & (blank_before >= strong)


def boundary_counts(unit_rows: DataFrame, key: str = "source", strong: int = 5, mid: int = 3, para: int = 1) -> DataFrame:
    """How many units can begin a part, by the strength of the boundary before them."""
    at = lambda level: F.count_if((F.col("blank_before") >= level) & (F.col("start_char") > 0))
    return unit_rows.groupBy(key).agg(at(strong).alias("n_strong"), at(mid).alias("n_mid"), at(para).alias("n_para"), at(0).alias("n_line"))


def unit_stats(unit_rows: DataFrame, key: str = "source") -> DataFrame:
    return unit_rows.groupBy(key).agg(
        F.count("*").alias("n_units"), F.sum("char_count").cast("long").alias("n_chars"), F.max("char_count").alias("longest"), F.min("char_count").alias("shortest"),
        F.max("blank_before").alias("most_blank"), F.count_if(F.col("sep_newlines") > 1).alias("n_spaced"),
    )


def source_profile(texts: DataFrame, key: str = "source") -> DataFrame:
    """What identifies a text: sizes, hash, line ending, byte-order mark."""
    if pieces.in_pieces(texts):
        return pieces.profile(texts, key).drop("n_bom")
    t = F.col("text")
    return texts.select(
        key, F.length(t).alias("char_count"), F.octet_length(t).alias("byte_count"), T.sha256(t).alias("sha256"),
        T.line_ending(t).alias("line_ending"), t.startswith("﻿").alias("has_bom"), T.tail_newlines(t).alias("tail_newlines"),
    )
