"""Toxicity by a factorization machine over hashed terms.

Terms are the hashes of a text's words and of their first 4 and 5 bytes (inflected forms share those). The score is
sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the distinct known terms of the whole text: the pair part lets an
insult weigh more beside a mention of whom it is aimed at than either does alone.

Learning uses at most SAMPLE labelled rows, chosen by hash of the id, whose term sets (not texts) come to one fitting
task; rows count in that order while their texts stay within SAMPLE_BYTES. Terms enter the model if they occur in MIN_DOCS
sampled rows and their smoothed odds ratio between the labels is at least ODDS either way; so words that are merely frequent in
long texts carry no weight. With odds of LEAN either way they enter if that holds among texts of like length (the odds
ratio pooled over classes of length by powers of two) and by more than chance: so enter insults and groups that are common in
clean texts too. Terms that matter only in pairs enter by the pair: every pair of terms is tried, and both enter if the rows with both have odds that surpass those of
either alone (and even odds) by ODDS, either way, and by more than chance: less than CHANCE pairs are expected to pass
where no pair matters; near copies of a row count once in that. Hash collisions between 64-bit terms are negligible, and unknown terms are ignored.

Defined results: null and empty texts have no terms and get the bias alone; without rows of both labels the score is the
base rate (0 without rows). Rows of labels with a null doc_id or label never train; of repeated labels of one id the
largest counts. Extra columns are ignored by score() and kept by reject().
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as c

SAMPLE, SAMPLE_BYTES, MIN_DOCS, ODDS, LEAN = 12_000, 128 << 20, 5, 4.0, 2.0
FACTORS, EPOCHS, RATE, DECAY, BATCH = 8, 12, 0.1, 1e-4, 256
CHANCE, PAIR_BLOCK = 0.01, 512
PREFIXES = (4, 5)
THRESHOLD = 0.5


def term_sets(col: pa.Array, keep=None) -> list[np.ndarray]:
    """Each row's sorted distinct term hashes; keep(hashes) may thin them before they are sorted."""
    data, offs = c.buffers(col)
    h, row, more = c.word_hashes(data, offs, "alnum", PREFIXES)
    terms = np.concatenate([h, *more])
    rows = np.concatenate([row] * (1 + len(more)))
    ok = terms != 0
    if keep is not None:
        ok &= keep(terms)
    terms, rows = terms[ok], rows[ok]
    order = np.argsort(rows, kind="stable")
    terms, rows = terms[order], rows[order]
    bounds = np.searchsorted(rows, np.arange(len(col) + 1))
    return [np.unique(terms[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class FactorizationMachine:
    def __init__(self, terms: np.ndarray, base: float):
        self.terms, self.b = np.sort(terms), base
        rng = np.random.default_rng(11)
        self.w = np.zeros(len(terms))
        self.v = rng.normal(0, 0.05, (len(terms), FACTORS))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are terms of the model: a bitmap first, then a search."""
        ok = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
        x = np.flatnonzero(ok)
        at = np.minimum(np.searchsorted(self.terms, h[x]), len(self.terms) - 1)
        ok[x] = self.terms[at] == h[x] if len(self.terms) else False
        return ok

    def ids(self, known_terms: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.terms, known_terms)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows of term ids before the sigmoid."""
        n = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.b)
        full = np.flatnonzero(n)
        if len(full):
            flat = np.concatenate([rows[i] for i in full])
            at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
            s = np.add.reduceat(self.v[flat], at)
            q = np.add.reduceat(self.v[flat] ** 2, at)
            out[full] += np.add.reduceat(self.w[flat], at) + 0.5 * (s * s - q).sum(axis=1)
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Adagrad on the logistic loss, in small batches of fixed order."""
        rng = np.random.default_rng(5)
        gb, gw, gv = 1e-6, np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                some = [rows[i] for i in pick]
                g = 1 / (1 + np.exp(-np.clip(self.raw(some), -30, 30))) - y[pick]
                gb += g.mean() ** 2
                self.b -= RATE * g.mean() / np.sqrt(gb)
                n = np.array([len(r) for r in some])
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                flat = np.concatenate([some[i] for i in full])
                at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                per = np.repeat(g[full], n[full])
                s = np.repeat(np.add.reduceat(self.v[flat], at), n[full], axis=0)
                ids, inv = np.unique(flat, return_inverse=True)
                dw, dv = np.zeros(len(ids)), np.zeros((len(ids), FACTORS))
                np.add.at(dw, inv, per)
                np.add.at(dv, inv, per[:, None] * (s - self.v[flat]))
                dw, dv = dw / len(pick) + DECAY * self.w[ids], dv / len(pick) + DECAY * self.v[ids]
                gw[ids] += dw**2
                gv[ids] += dv**2
                self.w[ids] -= RATE * dw / np.sqrt(gw[ids])
                self.v[ids] -= RATE * dv / np.sqrt(gv[ids])


def _screened(sets: list[np.ndarray], y: np.ndarray, part: int) -> np.ndarray:
    """The terms of one sixteenth of the hash range that enter the model; parts keep the counting small."""
    low, high = np.uint64(part << 60), np.uint64((part << 60) + (1 << 60) - 1)
    own = [s[np.searchsorted(s, low) : np.searchsorted(s, high, side="right")] for s in sets]
    terms, inv = np.unique(np.concatenate(own), return_inverse=True)
    pos, every = np.bincount(inv, np.repeat(y, [len(s) for s in own]), len(terms)), np.bincount(inv, minlength=len(terms))
    odds = _odds(pos, every, y.sum(), len(y))
    return terms[(every >= MIN_DOCS) & ((odds >= ODDS) | (odds <= 1 / ODDS))]


def _leaning(sets: list[np.ndarray], y: np.ndarray, part: int) -> np.ndarray:
    """The terms of one sixteenth of the hash range with odds of LEAN among texts of like length, by more than chance (the
    pooled odds ratio and chi-square of Mantel and Haenszel)."""
    low, high = np.uint64(part << 60), np.uint64((part << 60) + (1 << 60) - 1)
    own = [s[np.searchsorted(s, low) : np.searchsorted(s, high, side="right")] for s in sets]
    flat = np.concatenate(own)
    terms, inv, every = np.unique(flat, return_inverse=True, return_counts=True)
    # rare terms cannot pass: even the clearest would be too likely by chance
    least = np.log(16 * max(len(terms), 2) / CHANCE)
    keep = every >= np.maximum(MIN_DOCS, least / -np.log(max(min(y.mean(), 1 - y.mean()), 1e-9)))
    at = np.cumsum(keep) - 1
    hit = keep[inv]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in own])[hit]
    inv, terms = at[inv[hit]], terms[keep]
    stratum = np.array([len(s).bit_length() for s in sets])
    up, down, excess, spread = (np.zeros(len(terms)) for _ in range(4))
    for k in np.unique(stratum):
        inside = stratum == k
        n, pos = float(inside.sum()), float(y[inside].sum())
        if n < 2 or not 0 < pos < n:
            continue
        x = inside[row]
        m = np.bincount(inv[x], minlength=len(terms)).astype(float)
        a = np.bincount(inv[x], y[row[x]], len(terms))
        up += a * (n - pos - (m - a)) / n
        down += (m - a) * (pos - a) / n
        excess += a - m * pos / n
        spread += m * pos * (n - pos) * (n - m) / (n * n * (n - 1))
    odds = (up + 0.5) / (down + 0.5)
    sure = np.maximum(np.abs(excess) - 0.5, 0) ** 2 >= 2 * least * spread
    return terms[sure & (spread > 0) & ((odds >= LEAN) | (odds <= 1 / LEAN))]


def _odds(pos: np.ndarray, every: np.ndarray, n_pos: int, n: int) -> np.ndarray:
    p, q = (pos + 0.5) / (n_pos + 1), (every - pos + 0.5) / (n - n_pos + 1)
    return (p / (1 - p)) / (q / (1 - q))


def _surprise(pos: np.ndarray, every: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The least negative log of the chance that `pos` of `every` rows are toxic at `rate` (Chernoff's bound)."""
    p = pos / np.maximum(every, 1)
    part = lambda a, b: a * np.log(np.where(a > 0, a, 1) / b)
    return every * (part(p, rate) + part(1 - p, 1 - rate))


def _distinct(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The term sets without those that share half their terms or more with an earlier one: copies are one witness.

    Eight bands of three MinHash values find what may be a copy (at a similarity of 0.75 all but 1 in 80); full sets decide.
    """
    odd = np.random.default_rng(7).integers(1, 1 << 63, 24, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    leaders: dict[tuple, int] = {}
    out = []
    for r, s in enumerate(sets):
        if not len(s):
            out.append(s)
            continue
        low = np.array([(s * m).min() for m in odd]).reshape(8, 3).tolist()
        keys = [(band, *v) for band, v in enumerate(low)]
        for x in {leaders[k] for k in keys if k in leaders}:
            if 3 * np.isin(s, sets[x], assume_unique=True).sum() >= len(s) + len(sets[x]):
                break
        else:
            out.append(s)
            for k in keys:
                leaders.setdefault(k, r)
    return out


def _witnesses(sets: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of each label without near copies."""
    high, low = _distinct([s for s, t in zip(sets, y) if t]), _distinct([s for s, t in zip(sets, y) if not t])
    return [*high, *low], np.repeat([1, 0], [len(high), len(low)])


def _paired(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms that enter the model by a pair in rows of which none is a near copy, toxic ones first. All pairs that could pass are
    counted; blocks of terms keep that small."""
    n, n_pos = len(sets), int(y.sum())
    rate = n_pos / n
    high, n_high = np.unique(np.concatenate([s for s, t in zip(sets, y) if t]), return_counts=True)
    low, n_low = np.unique(np.concatenate([s for s, t in zip(sets, y) if not t]), return_counts=True)
    terms = np.union1d(high, low)
    pos, every = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    pos[np.searchsorted(terms, high)] = n_high
    every[np.searchsorted(terms, low)] = n_low
    every += pos
    # a pair of so few rows could pass by chance: those terms need no count. `least` falls with the terms that remain
    most = len(terms)
    while True:
        least = np.log(max(most, 2) ** 2 / CHANCE)
        need_pos, need_every = least / -np.log(rate), least / -np.log1p(-rate)
        keep = (pos >= need_pos) | (every >= need_every)
        if keep.sum() >= most:
            break
        most = int(keep.sum())
    terms, pos, every = terms[keep], pos[keep], every[keep]
    if len(terms) < 2:
        return terms[:0]
    order = np.argsort(-every, kind="stable")
    at = np.empty(len(terms), np.int64)
    at[order] = np.arange(len(terms))
    pos, every = pos[order], every[order]
    # rows as bits, toxic ones first, each label padded to whole words of 64
    def bits(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(terms), -(-len(some) // 64) * 8), np.uint8)
        for lo in range(0, len(some), 256):
            flag = np.zeros((256, len(terms)), np.uint8)
            for r, s in enumerate(some[lo : lo + 256]):
                x = np.minimum(np.searchsorted(terms, s), len(terms) - 1)
                flag[r, at[x[terms[x] == s]]] = 1
            got = np.packbits(flag, axis=0).T
            out[:, lo // 8 : lo // 8 + 32] = got[:, : out.shape[1] - lo // 8]
        return out

    toxic, fair = bits([s for s, t in zip(sets, y) if t]), bits([s for s, t in zip(sets, y) if not t])
    words = fair.view(np.uint64)
    dense = lambda m, a: np.unpackbits(m[a : a + PAIR_BLOCK], axis=1).astype(np.float32)
    share, odds = pos / every, _odds(pos, every, n_pos, n)
    enters = np.zeros(len(terms), bool)
    for a in range(0, len(terms), PAIR_BLOCK):
        left, left_fair = dense(toxic, a), None
        for b in range(a, len(terms), PAIR_BLOCK):
            both = (left @ dense(toxic, b).T).astype(np.int64)
            i, j = np.arange(a, a + both.shape[0])[:, None], np.arange(b, b + both.shape[1])[None, :]
            upper, lower = np.maximum(np.maximum(share[i], share[j]), rate), np.minimum(np.minimum(share[i], share[j]), rate)
            # what the pair's surprise can be at most, whatever its clean rows
            rise = both * -np.log(upper) >= least
            room = np.minimum(every[i], every[j])
            fall = (room * -np.log1p(-np.minimum(lower, 1 - 1e-9)) >= least) & (both < room * lower)
            x, z = np.nonzero((rise | fall) & (i < j))
            if not len(x):
                continue
            if 20 * len(x) > both.size:
                left_fair = dense(fair, a) if left_fair is None else left_fair
                clean = (left_fair @ dense(fair, b).T)[x, z].astype(np.int64)
            else:
                clean = np.concatenate([np.bitwise_count(words[a + x[k : k + 8192]] & words[b + z[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 8192)])
            k, up, down = both[x, z], upper[x, z], lower[x, z]
            total, one, two = k + clean, odds[a + x], odds[b + z]
            pair = _odds(k, total, n_pos, n)
            more = (pair >= ODDS * np.maximum(np.maximum(one, two), 1)) & (k > up * total)
            less = (pair <= np.minimum(np.minimum(one, two), 1) / ODDS) & (k < down * total)
            more[more] = _surprise(k[more], total[more], up[more]) >= least
            less[less] = _surprise(k[less], total[less], down[less]) >= least
            enters[a + x[more | less]] = True
            enters[b + z[more | less]] = True
    return np.sort(terms[order][enters])


def fit_sample(sets: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
    rate = float(y.mean()) if len(y) else 0.0
    none = FactorizationMachine(np.empty(0, np.uint64), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    if not 0 < rate < 1:
        return none
    alone = [_screened(sets, y, part) for part in range(16)]
    some, marks = _witnesses(sets, y)
    terms = np.union1d(np.concatenate([*alone, *(_leaning(some, marks, part) for part in range(16))]), _paired(some, marks))
    if not len(terms):
        return none
    model = FactorizationMachine(terms, none.b)
    model.fit([model.ids(s[model.known(s)]) for s in sets], y.astype(float))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, sample: int) -> DataFrame:
    """(k, y, text) of at most `sample` labelled rows outside the held-out remainder, chosen by hash of the id; of repeated
    ids the smallest text counts. The chosen ids are broadcast: `sample` of them, some 12 bytes each, so only their texts move.
    In the order of that hash, rows count while their texts stay within SAMPLE_BYTES; so the fitting task's memory has a bound."""
    marks = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(label).cast("int").alias("y"))
    marks = marks.where(c.crc_mod(F.col("k"), mod) != held)
    chosen = marks.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "k")
    rows = c.stash(rows.groupBy("k", "y").agg(F.min("text").alias("text")))
    # one small task orders at most `sample` pairs of id and size
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0))
    sizes = rows.select("k", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).withColumn("upto", upto)
    return rows.join(F.broadcast(sizes.where(F.col("upto") <= SAMPLE_BYTES).select("k")), "k")


def learn(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    def sets(it):
        for batch in it:
            for at, col in c.slices(batch.column(2)):
                got = [s.tobytes() for s in term_sets(col)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), batch.column(1).slice(at, len(col)), pa.array(got, pa.binary())], ["k", "y", "terms"])

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["k", "terms"])
        model = fit_sample([np.frombuffer(x, np.uint64) for x in pdf.terms], pdf.y.to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    rows = labelled(docs, labels, "toxic", 5, 0, SAMPLE).mapInArrow(sets, "k long, y int, terms binary")
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit_sample([], np.empty(0))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every whole text of docs(doc_id, text)."""

    def run(it):
        for batch in it:
            for at, col in c.slices(batch.column(1)):
                raw = model.raw([model.ids(s) for s in term_sets(col, model.known)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs scored under the threshold, with their columns; one pass, no shuffle."""
    at_text = docs.columns.index("text")

    def run(it):
        for batch in it:
            for at, col in c.slices(batch.column(at_text)):
                raw = model.raw([model.ids(s) for s in term_sets(col, model.known)])
                yield batch.slice(at, len(col)).filter(pa.array(raw < np.log(threshold / (1 - threshold))))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    out = score(docs, learn(docs, c.read(spark, sf_dir, "labels")))
    return out.select("doc_id", (c.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
