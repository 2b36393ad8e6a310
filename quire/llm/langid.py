"""Language identification by rank-order profiles of n-grams.

A profile lists the most frequent n-grams (1 to N_MAX characters, words padded by a blank on both sides) by falling count,
ties to the smaller n-gram. Learning sums the n-grams of all whole training texts per language: workers merge counts
batch by batch, Spark adds the partial sums, and a ranked limit keeps PROFILE entries a language. A document takes the
language with the least out-of-place distance: the sum over the document's profile of how far each n-gram's rank is off,
PROFILE for an n-gram the language lacks; ties go to the smaller language value.

N-grams are exact keys (three code points of 21 bits). Texts of any length are counted in stretches.

Defined results: null text, or text without a letter, or a model without languages: 'und' with score 0; rows with null
lang never train; lang values are not interpreted, but more than LANGS of them are an error, as the profiles of all come to the
driver and to every task. N-grams that differ only by a leading blank count as one. Repeated rows count as often as they occur. Extra columns are ignored.
score is 1 - distance / worst distance.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as c

N_MAX, PROFILE, LANGS = 3, 300, 10_000
#: Characters counted at a time.
STRETCH = 1 << 20
_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _keys(text: str) -> np.ndarray:
    """All n-gram keys of a lower-cased stretch; words are its runs of letters, padded by a blank."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    x = np.zeros(len(cp) + 2, np.int64)
    x[1:-1] = np.where(letter, cp, 0)  # 0 is the blank
    inside = x != 0
    out = [x[inside]]
    pair = (x[:-1] << _BITS) | x[1:]
    out.append(pair[inside[:-1] | inside[1:]])
    # a blank in the middle would join two words
    three = (pair[:-1] << _BITS) | x[2:]
    out.append(three[inside[1:-1]])
    return np.concatenate(out)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys ascending, counts) of a whole text."""
    text = text.lower()
    if len(text) <= STRETCH:
        return np.unique(_keys(text), return_counts=True)
    parts, at = [], 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and text[end].isalpha():
            end += 1
        parts.append(np.unique(_keys(text[at:end]), return_counts=True))
        parts = [_add(parts)] if len(parts) > 8 else parts
        at = end
    return _add(parts)


def _add(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([v for _, v in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[head], (np.add.reduceat(n, head) if len(head) else n)


def top(keys: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The keys of the `most` largest counts, ties to the smaller key, in rank order."""
    if len(keys) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        x = n >= least
        keys, n = keys[x], n[x]
    return keys[np.argsort(-n, kind="stable")][:most]


def _partial(it):
    """Sums by language and n-gram of what this task has read; emitted whenever a language has gathered many n-grams."""
    held: dict[str, list] = {}

    def flush(lang):
        k, n = _add(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    for batch in it:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = held.setdefault(lang, [])
            parts.append(counted(text))
            if len(parts) > 200:
                held[lang] = parts = [_add(parts)]
            if len(parts[0][0]) > 1_000_000:
                yield flush(lang)
            elif len(held) > 500:
                yield flush(max(held, key=lambda x: sum(len(k) for k, _ in held[x])))
    for lang in list(held):
        yield flush(lang)


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """lang -> n-gram keys in rank order, from docs(lang, text); `profile` entries a language come to the driver."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.mapInArrow(_partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= profile)
    out: dict[str, list] = {}
    for r in best.orderBy("lang", "rank").limit(LANGS * profile + 1).collect():
        out.setdefault(r.lang, []).append(r.gram)
    if sum(map(len, out.values())) > LANGS * profile:
        raise ValueError(f"more than {LANGS} languages: is lang the language?")
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.rank = np.full((len(self.grams), max(1, len(self.langs))), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        mine = top(*counted(text), self.size)
        if not len(mine):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        theirs = self.rank[at]
        off = np.abs(theirs - np.arange(len(mine))[:, None])
        off[(theirs < 0) | (self.grams[at] != mine)[:, None]] = self.size
        far = off.sum(axis=0)
        j = int(np.argmin(far))
        return self.langs[j], float(1.0 - far[j] / (self.size * len(mine)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text of docs(doc_id, text)."""
    model = Profiles(profiles, size)

    def run(it):
        for batch in it:
            for at, col in c.slices(batch.column(1)):
                got = [model.predict(t) for t in col.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    held = c.crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs, learn(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
