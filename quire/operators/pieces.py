"""Texts longer than a row should hold: (key, seq, text), the pieces of a text in the order of seq.

A fold reads the pieces of a text one after another, each text within one task, and keeps a state of bounded size: the sort
before it spills, Arrow batches stream, and no row, aggregate or worker ever holds a whole text. Operators on texts take
rows of either form; a text of one row has no column seq.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ = "seq"
#: A fold's finished rows go on when there are so many, or so many characters in them.
FLUSH_ROWS, FLUSH_CHARS = 4096, 1 << 20
_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def in_pieces(texts: DataFrame) -> bool:
    return SEQ in texts.columns


def fold(texts: DataFrame, key: str, make: Callable, fields: str) -> DataFrame:
    """(key, fields) of make()'s states: feed(text) and finish() give rows (tuples of the fields) as soon as they are known."""
    kind = texts.schema[key].dataType.simpleString()
    names, types = zip(*[f.split() for f in fields.split(", ")])
    # the window deals rows by key and hands them on in order; its number goes along so that it is not dropped
    rows = texts.select(key, F.col("text").cast("string").alias("text"), F.row_number().over(Window.partitionBy(key).orderBy(SEQ)).alias("n"))

    def run(it):
        kept: list[tuple] = []
        size = 0
        arrow = key_type = None

        def flush():
            nonlocal size
            cols = list(zip(*kept)) if kept else [()] * (1 + len(names))
            kept.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow)], [key, *names])

        def found(state, owner, some: Iterable[tuple]):
            nonlocal size
            for row in some:
                kept.append((owner, *row))
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(kept) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                    yield flush()

        owner, state = None, None
        for batch in it:
            if arrow is None:
                arrow = [batch.column(0).type, *[_TYPES[t] for t in types]]
            keys, texts_ = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                k = keys[i].as_py()
                if state is None or k != owner:
                    if state is not None:
                        yield from found(state, owner, state.finish())
                    owner, state = k, make()
                yield from found(state, owner, state.feed(texts_[i].as_py() or ""))
        if state is not None:
            yield from found(state, owner, state.finish())
            if kept:
                yield flush()

    return rows.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))


class Profile:
    """Sizes, hash, line ending, byte-order marks and newlines at the end of a text."""

    FIELDS = "char_count int, byte_count int, sha256 string, line_ending string, has_bom boolean, tail_newlines int, n_bom int"

    def __init__(self):
        self.hash, self.chars, self.bytes, self.lf, self.crlf, self.tail, self.bom, self.last = hashlib.sha256(), 0, 0, 0, 0, 0, 0, ""

    def feed(self, text: str):
        if not text:
            return ()
        raw = text.encode()
        self.hash.update(raw)
        while self.bom < 2 and self.bom == self.chars and text[: 1] == "﻿":
            # marks count while nothing else came before them
            self.bom, self.chars, text = self.bom + 1, self.chars + 1, text[1:]
        self.chars += len(text)
        self.bytes += len(raw)
        if not text:
            self.last = "﻿"
            return ()
        self.crlf += text.count("\r\n") + (self.last == "\r" and text[0] == "\n")
        self.lf += text.count("\n")
        end = len(text) - len(text.rstrip("\n"))
        self.tail = end + (self.tail if end == len(text) and not self.bom == self.chars - end else 0)
        self.last = text[-1]
        return ()

    def finish(self):
        lf = self.lf - self.crlf
        ending = "MIXED" if self.crlf and lf else "CRLF" if self.crlf else "LF" if lf else "NONE"
        return [(self.chars, self.bytes, self.hash.hexdigest(), ending, self.bom > 0, self.tail, self.bom)]


class Units:
    """The non-blank lines of a text: (ln, idx, start_char, sep, text), as units.units has them."""

    FIELDS = "ln int, idx int, start_char long, sep int, text string"

    def __init__(self):
        self.ln = self.idx = self.at = 0
        self.last, self.open = None, ""

    def _line(self, line: str):
        row = None
        if line:
            if line.strip():
                self.idx += 1
                row = (self.ln, self.idx, self.at, 0 if self.idx == 1 else self.ln - self.last, line)
            self.last = self.ln
        self.ln += 1
        self.at += len(line) + 1
        return row

    def feed(self, text: str):
        lines = text.split("\n")
        if len(lines) == 1:
            self.open += text
            return
        lines[0] = self.open + lines[0]
        self.open = lines.pop()
        for line in lines:
            row = self._line(line)
            if row:
                yield row

    def finish(self):
        row = self._line(self.open)
        return [row] if row else []


def profile(texts: DataFrame, key: str = "source") -> DataFrame:
    """units.source_profile of texts in pieces, with n_bom, the byte-order marks (at most two) a text begins with."""
    return fold(texts, key, Profile, Profile.FIELDS)


def lengths(texts: DataFrame, key: str = "source", name: str = "n") -> DataFrame:
    """(key, characters of the text)."""
    if in_pieces(texts):
        return texts.groupBy(key).agg(F.sum(F.length("text")).cast("int").alias(name))
    return texts.select(key, F.length("text").alias(name))
