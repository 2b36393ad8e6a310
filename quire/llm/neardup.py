"""MinHash near-duplicate detection verified through odd sketches and full shingle sets.

Plan: (1) one pass makes each document's set of 5-word shingles, a 128-bit digest of that whole set, k MinHash values
banded into bucket keys, and the odd sketch: the parity bitmap of the MinHash samples, whose XOR population count
estimates high similarities closely. (2) Equal sets, by their digests, collapse to one representative in a partial
aggregate, so groups of copies cost one row from here on. (3) Within each bucket every representative is tried, by sketch, against
the bucket's leaders (the first row not yet linked); at most one confirmed link a representative results, and connected
components follow. (4) Pairs in different components that share a bucket are all tried again: a second odd sketch, of the whole
set, excludes most without any error, as its XOR population count never exceeds the symmetric difference; the rest are
confirmed on full sets. In rounds, each component tries its nearest pair only, as one link joins two components however
many there are; once that joins nothing more, every pair still across components is tried. So no link that could join two
components stays untried, and groups of near copies cost their number, not its square.

Buckets are streamed in sorted runs of at most `BLOCK` rows; larger ones are dealt over several blocks. In step 4 the rows
outside such a bucket's largest component visit all its blocks, while they are at most OUTSIDE: linear in the bucket. A
bucket with more of them (many different documents around one shared passage) is left by its shingles instead: sets of
similarity 0.75 share one of the first quarter of their shingles in any fixed order, and with the shingles that many rows
share put last, those groups are small. Groups that are not are dealt over blocks once more.

Defined results: a null or word-less text has an empty set, n_shingles 0, and links with nothing; a null doc_id counts
as its own key and is never a component of another row; repeated rows share their component. Rows of one doc_id but different
texts are different documents, each with its own links; a component is named by the smallest doc_id among its rows. Extra
columns are ignored. A pair at similarity exactly 0.75 is missed by all 32 bands of 4 with probability 5e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as c

WORDS, K, BANDS, BITS = 5, 128, 32, 512
THRESHOLD = 75
#: Sketch bits that may differ for a row to be tried against a leader: expected 57 at similarity 0.75.
NEAR_BITS = 62
BLOCK = 2048
#: Rows outside a bucket's largest component that may visit all its blocks, and the most shingles told to all tasks as frequent.
OUTSIDE, FREQUENT = 8 * BLOCK, 1 << 20
#: Bits of the odd sketch of a whole set.
FULL_BITS = 4096

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def shingle_sets(col: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    data, offs = c.buffers(col)
    h, row, _ = c.word_hashes(data, offs, "space")
    bounds = np.searchsorted(row, np.arange(len(col) + 1))
    full = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for i in range(words):
        full += h[i : i + len(full)] * _C[i]
    full = c.mix(full)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        elif b > a:
            yield c.mix(np.sum(h[a:b] * _C[: b - a], keepdims=True) ^ _U(b - a))
        else:
            yield full[:0]


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(K, ~_U(0))
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Rows of K MinHash values to rows of BITS // 64 words of parity bits."""
    pos = c.mix(mins ^ c.mix(np.arange(K, dtype=np.uint64) + _U(7))) % _U(BITS)
    flat = (pos + np.arange(len(mins), dtype=np.uint64)[:, None] * _U(BITS)).ravel().astype(np.int64)
    odd = (np.bincount(flat, minlength=len(mins) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(mins), BITS), axis=1)


SIG_SCHEMA = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary"


def _signatures(it):
    seeds = c.mix(np.arange(BANDS, dtype=np.uint64) + _U(99))
    for batch in it:
        for at, col in c.slices(batch.column(1)):
            n, digests, mins = [], [], []
            for s in shingle_sets(col):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                mins.append(minhash(s))
            f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            m = np.array(mins, np.uint64).reshape(-1, K)
            r = m.reshape(len(m), BANDS, K // BANDS)
            keys = seeds[None, :].repeat(len(m), 0)
            for j in range(K // BANDS):
                keys = c.mix(keys ^ r[:, :, j]) + _U(j)
            sk = odd_sketches(m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(col)),
                    batch.column(2).slice(at, len(col)),
                    pa.array(n, pa.int64()),
                    pa.array(f[:, 0]),
                    pa.array(f[:, 1]),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(c.signed(keys.ravel()))),
                    pa.array([x.tobytes() for x in sk], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "f1", "f2", "bands", "sketch"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def signatures(docs: DataFrame) -> DataFrame:
    return _keyed(docs).mapInArrow(_signatures, SIG_SCHEMA)


def _groups(it, size: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Join batches of rows sorted by `key` and `block` so that no group is cut."""
    rest = None
    for batch in it:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < size:
            continue
        k, b = rest["key"].to_numpy(), rest["block"].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]) | (b[1:] != b[:-1]))
        if len(cut):
            yield _columns(rest.slice(0, cut[-1] + 1))
            rest = rest.slice(cut[-1] + 1)
    if rest is not None and rest.num_rows:
        yield _columns(rest)


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    out = {k: t[k].to_numpy() for k in t.column_names if k not in ("sketch", "full")}
    for k in ("sketch", "full"):
        if k in t.column_names:
            raw = b"".join(x for chunk in t[k].chunks for x in chunk.to_pylist())
            out[k] = np.frombuffer(raw, np.uint64).reshape(t.num_rows, -1)
    k, b = out["key"], out["block"]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    out["group"] = np.cumsum(new) - 1
    return out


def _sizes_fit(d: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = d["n"][i], d["n"][j]
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * THRESHOLD


def _close(d: dict, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of rows pass the size bound and differ in at most `bits` sketch bits."""
    ok = _sizes_fit(d, i, j)
    x = np.flatnonzero(ok)
    ok[x] = np.bitwise_count(d["sketch"][i[x]] ^ d["sketch"][j[x]]).sum(axis=1) <= bits
    return ok


def _least_apart(d: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound of each pair's symmetric difference, from the whole sets' sketches."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 14):
        x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
        out[a : a + (1 << 14)] = np.bitwise_count(d["full"][x] ^ d["full"][y]).sum(axis=1, dtype=np.int64)
    return out


def _whole_sketches(it):
    for batch in it:
        for at, col in c.slices(batch.column(1)):
            maps = []
            for s in shingle_sets(col):
                odd = np.bincount((s >> _U(52)).astype(np.int64), minlength=FULL_BITS) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(maps, pa.binary())], ["rep", "full"])


def _pairs(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "ca", "cb", "near"][: len(columns)])


def _leaders(it):
    """Each row to the first leader of its bucket that its sketch comes near; at most one link a row and bucket."""
    for d in _groups(it):
        live = np.arange(len(d["group"]))
        while len(live):
            g = d["group"][live]
            first = np.ones(len(g), bool)
            first[1:] = g[1:] != g[:-1]
            lead = live[np.flatnonzero(first)[np.cumsum(first) - 1]]
            others = np.flatnonzero(~first)
            near = _close(d, live[others], lead[others], NEAR_BITS)
            hit = others[near]
            if len(hit):
                yield _pairs(d["rep"][live[hit]], d["rep"][lead[hit]])
            live = live[others[~near]]


def _nearest_of_each(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Of pairs (a, b, ca, cb, distance) those that are the nearest of one of their components."""
    a, b, ca, cb, near = cols
    comp, pair = np.concatenate([ca, cb]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((b[pair], a[pair], near[pair], comp))
    comp, pair = comp[order], pair[order]
    new = np.ones(len(comp), bool)
    new[1:] = comp[1:] != comp[:-1]
    keep = np.unique(pair[new])
    return [x[keep] for x in cols]


def _crossings(nearest: bool):
    """The pairs of a bucket's rows in different components that sizes and whole-set sketches leave open: similarity t needs a
    symmetric difference of (1 - t) / (1 + t) of the sizes' sum at most. All of them, or each component's nearest one."""

    def run(it):
        for d in _groups(it):
            held: list[list[np.ndarray]] = []
            n = len(d["group"])
            i, step = np.arange(n), 1
            while True:
                i = i[i + step < n]
                i = i[d["group"][i] == d["group"][i + step]]
                if not len(i):
                    break
                for part in np.array_split(i, len(i) // (1 << 16) + 1):
                    j = part + step
                    x = (d["comp"][part] != d["comp"][j]) & (d["rep"][part] != d["rep"][j])
                    part, j = part[x], j[x]
                    x = _sizes_fit(d, part, j)
                    part, j = part[x], j[x]
                    least, both = _least_apart(d, part, j), d["n"][part] + d["n"][j]
                    x = least * (100 + THRESHOLD) <= (100 - THRESHOLD) * both
                    if not x.any():
                        continue
                    part, j = part[x], j[x]
                    low = d["rep"][part] < d["rep"][j]
                    p, q = np.where(low, j, part), np.where(low, part, j)  # a is the larger number
                    held.append([d["rep"][p], d["rep"][q], d["comp"][p], d["comp"][q], least[x] / both[x]])
                    if sum(len(h[0]) for h in held) > 1 << 20:
                        held = [[np.concatenate(col) for col in zip(*held)]]
                        if nearest:
                            held = [_nearest_of_each(held[0])]
                        if not nearest or len(held[0][0]) > 1 << 19:
                            yield _pairs(*held[0])
                            held = []
                step += 1
            if held:
                cols = [np.concatenate(col) for col in zip(*held)]
                yield _pairs(*(_nearest_of_each(cols) if nearest else cols))

    return run


def _confirm(it):
    """Keep the pairs whose full sets meet the threshold; a leader's set is made once for its run of rows."""
    last, kept = None, None
    for batch in it:
        ids = batch.column(1).to_numpy()
        ok = np.zeros(batch.num_rows, bool)
        for at, col in c.slices(batch.column(2)):
            for r, s in enumerate(shingle_sets(col), at):
                if ids[r] != last or kept is None:
                    last, kept = ids[r], next(shingle_sets(batch.column(3).slice(r, 1)))
                both = len(np.intersect1d(s, kept, assume_unique=True))
                ok[r] = 100 * both >= THRESHOLD * (len(s) + len(kept) - both)
        names = [x for x in batch.schema.names if x not in ("ta", "tb")]
        yield batch.select(names).filter(pa.array(ok))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of pairs(a, b, ...) that hold on the full texts(rep, text)."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", *pairs.columns[2:])
    return rows.mapInArrow(_confirm, ", ".join(f"{x} long" for x in pairs.columns))


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp): the smallest node reachable, for every node of edges(a, b); labels shrink by neighbours and jumps."""
    both = c.stash(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = c.stash(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b").groupBy(F.col("a").alias("rep")).agg(F.min("cb").alias("near"))
        step = labels.join(near, "rep", "left").select("rep", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("up"))
        after = c.stash(step.join(jump, "comp", "left").select("rep", "was", F.coalesce("up", "comp").alias("comp")))
        changed = after.where("was <> comp").limit(1).count()
        labels = after.select("rep", "comp")
        if not changed:
            return labels


def _blocks(count, salt) -> F.Column:
    """The block of a row in a bucket of `count` rows."""
    return F.pmod(salt, F.ceil(count / F.lit(BLOCK)).cast("long")).cast("int")


def _shingle_rows(it):
    for batch in it:
        for _, col in c.slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(c.signed(np.concatenate([*shingle_sets(col), np.empty(0, np.uint64)])))], ["h"])


def _heads(frequent: np.ndarray):
    """Each set's first shingles, the frequent ones ordered last: as many as a set of similarity 0.75 must share one of."""

    def run(it):
        for batch in it:
            for at, col in c.slices(batch.column(1)):
                reps, keys = [], []
                for rep, s in zip(batch.column(0).slice(at, len(col)).to_numpy(), shingle_sets(col)):
                    late = np.isin(s, frequent, assume_unique=True)
                    head = np.concatenate([s[~late], s[late]])[: len(s) - math.ceil(THRESHOLD * len(s) / 100) + 1]
                    keys.append(head)
                    reps.append(np.full(len(head), rep))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(c.signed(np.concatenate(keys)))], ["rep", "key"])

    return run


def _by_shingle(some: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, rep) of the sets some(rep): groups by shingle that hold every pair of similarity 0.75."""
    body = texts.join(some, "rep", "left_semi").select("rep", "text")
    counts = c.stash(body.mapInArrow(_shingle_rows, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    # so many occurrences cannot be of more than FREQUENT shingles
    least = (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT
    frequent = np.array([r.h for r in counts.where(F.col("n") > least).select("h").toLocalIterator()], np.int64).view(np.uint64)
    return body.mapInArrow(_heads(np.sort(frequent)), "rep long, key long")


def _open_pairs(placed: DataFrame, wide: DataFrame, texts: DataFrame, nearest: bool, by_shingle: bool = True) -> DataFrame:
    """(a, b, ca, cb, near) of placed(key, rep, comp): what `_crossings` leaves open in its buckets."""
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside")).where("comps > 1")
    mixed = c.stash(mixed)
    loose = (F.col("size") > BLOCK) & (F.col("outside") > OUTSIDE) if by_shingle else F.lit(False)
    rows = placed.join(mixed.where(~loose).select("key", "main", "size"), "key")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = _blocks(F.col("size"), F.xxhash64("rep", "key"))
    every = F.when((F.col("comp") != F.col("main")) & (blocks > 1), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    rows = rows.withColumn("block", F.explode(every)).join(wide, "rep")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "rep").select("key", "block", "rep", "comp", "n", "full")
    found = rows.mapInArrow(_crossings(nearest), "a long, b long, ca long, cb long, near double")
    left = mixed.where(loose).select("key")
    if by_shingle and left.limit(1).count():
        some = c.stash(placed.join(left, "key", "left_semi").select("rep", "comp").distinct())
        again = c.stash(_by_shingle(some, texts))
        shared = again.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
        again = again.join(shared, "key").join(some, "rep")
        found = found.unionByName(_open_pairs(again, wide, texts, nearest, False))
    return found


def _crossing_pairs(placed: DataFrame, wide: DataFrame, texts: DataFrame, nearest: bool) -> DataFrame:
    """(a, b, ca, cb): the open pairs, each once, or each component's nearest one over all buckets."""
    found = _open_pairs(placed, wide, texts, nearest)
    if nearest:
        pair = F.struct("near", "a", "b", "ca", "cb")
        found = found.select(F.explode(F.array("ca", "cb")).alias("comp"), pair.alias("x")).groupBy("comp").agg(F.min("x").alias("x")).select("x.*")
    return found.select("a", "b", "ca", "cb").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, top): every row with the least (doc_id, text_hash) of its component, null without an id or a word."""
    keyed = _keyed(docs)
    sigs = c.stash(signatures(docs))
    reps = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles")
    reps = reps.agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # numbers given while writing stay as written
    reps = c.stash(reps.withColumn("rep", F.monotonically_increasing_id()))
    keys = reps.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = c.stash(keys.join(shared, "key"))
    linked = members.select("rep").distinct().join(reps.select("rep", "at.doc_id", "at.text_hash"), "rep")
    texts = c.stash(keyed.join(linked, ["doc_id", "text_hash"]).select("rep", "text").dropDuplicates(["rep"]))

    wide = reps.select("rep", F.col("n_shingles").alias("n"), "sketch")
    rows = members.withColumn("block", _blocks(F.col("size"), F.xxhash64("rep", "key"))).join(wide, "rep")
    near = rows.repartition("key", "block").sortWithinPartitions("key", "block", "rep").select("key", "block", "rep", "n", "sketch").mapInArrow(_leaders, "a long, b long")
    first = c.stash(confirm(near.groupBy("a").agg(F.min("b").alias("b")), texts))
    labels = c.stash(members.select("rep").distinct().join(components(first), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp")))
    maps = texts.select("rep", "text").mapInArrow(_whole_sketches, "rep long, full binary")
    whole = wide.drop("sketch").join(maps, "rep")
    nearest = True
    while True:
        open_ = _crossing_pairs(members.select("key", "rep").join(labels, "rep"), whole, texts, nearest)
        edges = c.stash(confirm(open_, texts).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        some = edges.limit(1).count()
        if some:
            joined = components(edges).select(F.col("rep").alias("comp"), F.col("comp").alias("into"))
            labels = c.stash(labels.join(joined, "comp", "left").select("rep", F.coalesce("into", "comp").alias("comp")))
        elif nearest:
            nearest = False
            continue
        if not nearest:
            break

    joined = labels.join(reps.select("rep", "at"), "rep")
    tops = joined.groupBy("comp").agg(F.min("at").alias("top"))
    by_set = reps.select("f1", "f2", "n_shingles", "rep", "at").join(joined.select("rep", "comp").join(tops, "comp").select("rep", "top"), "rep", "left")
    by_set = by_set.select("f1", "f2", "n_shingles", F.coalesce("top", "at").alias("top"))
    out = sigs.select("doc_id", "text_hash", "n_shingles", "f1", "f2").join(by_set, ["f1", "f2", "n_shingles"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("top")).alias("top"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    comp = F.coalesce("top.doc_id", "doc_id")
    return _grouped(docs).select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, one of the smallest doc_id; rows of a null doc_id all stay, and so
    does every text of a reused doc_id that is no near duplicate of another."""
    found = c.stash(_grouped(docs))
    own = F.struct("doc_id", "text_hash")
    key = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    drop = found.where(F.col("top").isNotNull() & (own != F.col("top"))).select(*key).distinct()
    twice = found.where("doc_id is not null").groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    on = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    rest = docs.join(drop, on, "left_anti")
    if not twice.limit(1).count():
        return rest
    again = rest.join(twice, on).dropDuplicates(["__id", "__hash"]).select(*[rest[n] for n in docs.columns])
    return rest.join(twice, on, "left_anti").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
p AS (SELECT doc_id, unnest(list_transform(g, lambda x: hash(x))) AS h FROM s),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM j JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n_shingles + b.n_shingles - common)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, min(c) AS c FROM (
  WITH RECURSIVE t(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.y, t.c FROM t JOIN u ON u.x = t.doc_id WHERE t.c < u.y) SELECT * FROM t) GROUP BY 1)
SELECT n.doc_id, n.n_shingles, r.c AS component_id, n.doc_id = r.c AS kept FROM n JOIN r ON r.doc_id = n.doc_id
"""
