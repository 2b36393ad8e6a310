"""Awkward inputs shared by the tests, and brute-force definitions."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, rep long"


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    base = [" ".join(word() for _ in range(40)) for _ in range(8)]
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0] + " tail", "en", "src0"), (21, base[1], "en", "src1"), (21, base[1], "en", "src1"), (22, "", "en", "src0"), (23, None, "en", None), (24, "  \n\t", None, "src2")]
    rows += [(None, base[2], "en", "src2"), (None, None, None, None), (25, " ".join([base[3]] * 400), "fr", None), (26, "x" * 300_000, "fr", "src1"), (27, "one two", "en", "é"), (28, "one two", "en", "é"), (29, "日本 語 テキスト", "ja", "é")]
    return spark.createDataFrame([(*r, 1, 5, "h", 7) for r in rows], DOCS)


def none(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
