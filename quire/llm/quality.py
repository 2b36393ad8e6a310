"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features describe it (shares of capitals, digits, symbols, repeated words; length;
whether the line occurred before in its document) and its neighbours above and below, all as on/off bins. The chain's
forward-backward pass gives each line's marginal of being good; their length-weighted mean, put through a fitted logistic
curve, is the document's score.

Learning takes at most SAMPLE labelled rows, chosen by hash of the id; lines carry their document's label. Full-batch
gradients of the conditional likelihood come from the same forward-backward pass, every document weighing the same.

Defined results: a null text is an empty one; an empty text is one empty line; without rows of both labels the score is
the base rate (1 without rows). Rows of labels with a null doc_id or label never train; of repeated labels of one id the
largest counts. Extra columns are ignored by score() and kept by good(). Lines are split at \\n; a line of any length
is measured whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as c
from quire.llm.toxicity import labelled

SAMPLE, EPOCHS, RATE, DECAY = 6_000, 150, 0.1, 1e-3
THRESHOLD = 0.7

#: Upper edges of the bins of each measure; a last bin takes the rest.
BINS = {
    "length": (1, 20, 80, 300, 1000),
    "capitals": (0.02, 0.1, 0.3, 0.6),
    "digits": (0.01, 0.05, 0.2),
    "symbols": (0.001, 0.02, 0.08, 0.2, 0.4),
    "bars": (0.001, 0.02),
    "bangs": (0.001, 0.02, 0.1),
    "again": (0.01, 0.05, 0.15, 0.4),
    "word": (2.5, 4.0, 6.0, 9.0),
    "seen": (0.5,),
}
_OWN = sum(len(e) + 1 for e in BINS.values())
#: Own bins, the same bins of the lines above and below, whether there is none above or below, and a constant.
WIDTH = 3 * _OWN + 3


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_CAPITAL, _DIGIT, _BAR, _BANG = (_table(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", "!"))
_SYMBOL = _table("#$%&*+<=>@[]\\^_`{|}~")


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line, line lengths, first line of each row and their end): bins has one column a measure."""
    data, offs = c.buffers(col)
    n = len(col)
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], cuts + 1]))
    owner = np.concatenate([np.arange(n), np.searchsorted(offs, cuts, side="right") - 1])
    owner = owner[np.argsort(np.concatenate([offs[:-1], cuts + 1]), kind="stable")]
    # an empty row starts where the next one does; equal starts keep the rows' order
    starts, owner = (x[np.lexsort((starts, owner))] for x in (starts, owner))
    lines = np.searchsorted(owner, np.arange(n + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[lines[1:] - 1] = offs[1:]
    size = np.maximum(0, ends - starts)

    full = np.flatnonzero(size)
    edges = np.stack([starts[full], ends[full]], 1).ravel()

    def count(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts))
        if len(full):
            x = np.append(flags, False)
            out[full] = np.add.reduceat(x, edges, dtype=np.int64)[::2]
        return out

    h, row, _ = c.word_hashes(data, offs, "space")
    words = np.zeros(len(starts))
    again = np.zeros(len(starts))
    sums = np.zeros(len(starts), np.uint64)
    if len(h):
        inside = c.word_bytes("space")[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[offs[:-1][offs[:-1] < len(data)]] |= inside[offs[:-1][offs[:-1] < len(data)]]
        place = np.searchsorted(starts[full], np.flatnonzero(begin), side="right") - 1
        line = full[place]
        words = np.bincount(line, minlength=len(starts)).astype(float)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[same], minlength=len(starts)).astype(float)
        np.add.at(sums, line, h * (np.arange(len(h), dtype=np.uint64) - np.searchsorted(line, line).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((np.arange(len(starts)), sums, owner))
    dup = np.zeros(len(starts), bool)
    a, b = order[1:], order[:-1]
    dup[a] = (owner[a] == owner[b]) & (sums[a] == sums[b]) & (words[a] > 0)

    share = np.maximum(size, 1)
    measure = {
        "length": size,
        "capitals": count(_CAPITAL[data]) / share,
        "digits": count(_DIGIT[data]) / share,
        "symbols": count(_SYMBOL[data]) / share,
        "bars": count(_BAR[data]) / share,
        "bangs": count(_BANG[data]) / share,
        "again": again / np.maximum(words, 1),
        "word": size / np.maximum(words, 1),
        "seen": dup,
    }
    bins, at = [], 0
    for name, e in BINS.items():
        bins.append(np.searchsorted(e, measure[name], side="right") + at)
        at += len(e) + 1
    return np.stack(bins, 1).astype(np.int32), size, lines


def with_neighbours(bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Feature ids of each line: own bins, those above, those below; WIDTH - 3 and - 2 where there is none; WIDTH - 1 always."""
    n, k = bins.shape
    up, down = np.full((n, k), WIDTH - 3, np.int32), np.full((n, k), WIDTH - 2, np.int32)
    up[1:] = bins[:-1] + _OWN
    down[:-1] = bins[1:] + 2 * _OWN
    up[lines[:-1]] = WIDTH - 3
    down[lines[1:] - 1] = WIDTH - 2
    return np.concatenate([bins, up, down, np.full((n, 1), WIDTH - 1, np.int32)], 1)


class LineCrf:
    """Two states, bad 0 and good 1. theta: a feature's weight for good; pair: weights of neighbouring states."""

    def __init__(self):
        self.theta, self.pair = np.zeros(WIDTH), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def forward_backward(self, unary: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of good for each line, expected counts of state pairs summed for each row)."""
        length = np.diff(lines)
        order = np.argsort(-length, kind="stable")
        first, length = lines[:-1][order], length[order]
        n, t = len(order), int(length[0]) if len(order) else 0
        e = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))], 1)
        m = np.exp(self.pair)
        alpha = np.empty((len(unary), 2))
        live = np.searchsorted(-length, -np.arange(1, t + 1), side="right")  # rows with more than i lines, for i = 0 ...
        for i in range(t):
            at = first[: live[i]] + i
            a = e[at] if i == 0 else (alpha[at - 1] @ m) * e[at]
            alpha[at] = a / a.sum(1, keepdims=True)
        good = np.empty(len(unary))
        pairs = np.zeros((n, 2, 2))
        beta = np.ones((n, 2))
        for i in range(t - 1, -1, -1):
            k = live[i]
            at = first[:k] + i
            more = live[i + 1] if i + 1 < t else 0
            if more:
                nxt = first[:more] + i + 1
                out = e[nxt] * beta[:more]
                joint = alpha[at[:more]][:, :, None] * m[None] * out[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pairs[:more] += joint
                b = out @ m.T
                beta[:more] = b / b.sum(1, keepdims=True)
            p = alpha[at] * beta[:k]
            good[at] = p[:, 1] / p.sum(1)
        back = np.empty((n, 2, 2))
        back[order] = pairs
        return good, back

    def quality(self, col: pa.Array) -> np.ndarray:
        """Length-weighted mean marginal of each row."""
        bins, size, lines = line_features(col)
        good, _ = self.forward_backward(self.theta[with_neighbours(bins, lines)].sum(1), lines)
        w = np.maximum(size, 1).astype(float)
        return np.add.reduceat(good * w, lines[:-1]) / np.add.reduceat(w, lines[:-1])

    def score(self, col: pa.Array) -> np.ndarray:
        if not len(col):
            return np.empty(0)
        q = np.clip(self.quality(col), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift)))


def fit_sample(texts: list[str], y: np.ndarray) -> LineCrf:
    model = LineCrf()
    rate = float(y.mean()) if len(y) else 1.0
    if not 0 < rate < 1:
        model.slope, model.shift = 0.0, float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
        return model
    col = pa.array(texts, pa.large_string())
    bins, size, lines = line_features(col)
    ids = with_neighbours(bins, lines)
    n = np.diff(lines)
    state = np.repeat(y, n).astype(int)
    # every document weighs the same, and so do the two labels together
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    by_line = np.repeat(w / n, n)
    by_pair = w / np.maximum(n - 1, 1)
    true_pair = np.zeros((2, 2))
    for s in (0, 1):
        true_pair[s, s] = (by_pair * (n - 1))[y == s].sum()
    flat = ids.ravel()
    p = np.zeros(WIDTH + 4)
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, EPOCHS + 1):
        model.theta, model.pair = p[:WIDTH], p[WIDTH:].reshape(2, 2)
        good, pairs = model.forward_backward(model.theta[ids].sum(1), lines)
        g = np.concatenate([np.bincount(flat, np.repeat((state - good) * by_line, ids.shape[1]), WIDTH), (true_pair - (pairs * by_pair[:, None, None]).sum(0)).ravel()]) - DECAY * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        p = p + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    model.theta, model.pair = p[:WIDTH].copy(), p[WIDTH:].reshape(2, 2).copy()
    q = np.clip(model.quality(col), 1e-6, 1 - 1e-6)
    x = np.log(q / (1 - q))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve, held by a small ridge
        z = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = z - y, z * (1 - z)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        d = np.linalg.solve(h, np.array([(r * x).sum() + (a - 1), r.sum() + b * 1e-3]))
        a, b = a - d[0], b - d[1]
    model.slope, model.shift = float(a), float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> LineCrf:
    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["k", "text"])
        model = fit_sample([t or "" for t in pdf.text], pdf.y.to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    rows = labelled(docs, labels, "quality", 4, 2, SAMPLE)
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit_sample([], np.empty(0))


def score(docs: DataFrame, model: LineCrf) -> DataFrame:
    """(doc_id, score) of every whole text of docs(doc_id, text)."""

    def run(it):
        for batch in it:
            for at, col in c.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(model.score(col))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def good(docs: DataFrame, model: LineCrf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs scored at the threshold or above, with their columns; one pass, no shuffle."""
    at_text = docs.columns.index("text")

    def run(it):
        for batch in it:
            for at, col in c.slices(batch.column(at_text)):
                yield batch.slice(at, len(col)).filter(pa.array(model.score(col) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    out = score(docs, learn(docs, c.read(spark, sf_dir, "labels")))
    return out.select("doc_id", (c.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
