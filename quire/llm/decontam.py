"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task turns its documents into shards of about `SHARD_WORDS` words (documents stay apart by a reserved word; a longer
document is cut into pieces that overlap by a window less one word), builds a suffix array of each shard by prefix
doubling, and binary-searches every test suffix in it. A suffix's range of equal-prefix entries gives all its verbatim
occurrences and their locations; runs on one diagonal merge into longest matches. Doubling stops once the order is
settled or as deep as the longest search, so it is a full suffix order for every search made.

The benchmark is dealt into blocks of at most `TEST_WORDS` words. A benchmark of one block is one pass over the documents.
One of more is too, for a screen: a bitmap of SCREEN_BITS bits, whatever the benchmark's size, holds the hashes of all its
windows, and only texts with a window whose bits are all set (none that matters is missed) are kept for the blocks, which
search them one after another, each block's result written before the next is made. So driver and tasks hold one block
and the bitmap at most; a benchmark that fills the bitmap costs time, not matches.

Defined results: a null or word-less document has no words and is clean; null or empty items never occur; a null item_id
is named by an empty string; items of equal text each count; documents with equal ids are reported row by row. Extra
columns are ignored by matches() and kept by decontaminate(), which decides row by row: a row goes if its own text holds a
test window, whatever its id, null or shared.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as c

WINDOW = 10
SHARD_WORDS = 500_000
TEST_WORDS = 500_000
#: Size of the screen of a benchmark of several blocks, and the bits of it that each window sets.
SCREEN_BITS, PROBES = 1 << 28, 8

_STEP = np.uint64(0xD1342543DE82EF95)


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(array, rank): the suffixes of `words` in the order of their first `depth` words at least, by prefix doubling."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    step = 1
    rank = np.empty(n, np.int64)
    head = words[order]
    rank[order] = np.concatenate(([0], np.cumsum(head[1:] != head[:-1])))
    while step < depth and n and rank[order[-1]] < n - 1:
        key = (rank + 1) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        head = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(head[1:] != head[:-1])))
        step *= 2
    return order, rank


def search(words: np.ndarray, order: np.ndarray, tests: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test window the range [lo, hi) of suffixes that begin with it; all windows are searched together."""
    n = len(words)

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at, s, m = order[mid], starts[open_], lens[open_]
            less = np.zeros(len(open_), bool)
            tie = np.ones(len(open_), bool)
            for k in range(int(m.max())):
                live = np.flatnonzero(tie & (k < m))
                if not len(live):
                    break
                inside = at[live] + k < n
                x = np.where(inside, words[np.minimum(at[live] + k, n - 1)], 0)
                y = tests[s[live] + k]
                less[live] = x < y
                tie[live] = x == y
            right = less | tie if after else less
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    return bound(False), bound(True)


class Tests:
    """A block of items as one array of word hashes with its windows."""

    def __init__(self, ids: list[str], words: np.ndarray, bounds: np.ndarray, window: int):
        self.ids, self.words = ids, words
        starts, lens, item = [], [], []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            size = min(window, b - a)
            if size:
                s = np.arange(a, b - size + 1)
                starts.append(s)
                lens.append(np.full(len(s), size))
                item.append(np.full(len(s), k))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.starts, self.lens, self.item, self.offset = join(starts), join(lens), join(item), bounds
        self.longest = int(self.lens.max()) if len(self.lens) else 0


def occurrences(words: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, index of the window) of every occurrence of every window of the tests."""
    if not len(words) or not tests.longest:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, _ = suffix_array(words, tests.longest)
    lo, hi = search(words, order, tests.words, tests.starts, tests.lens)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    which = np.repeat(found, count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return order[lo[which] + inside], which


def _shards(col: pa.Array, overlap: int, shard_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words with separators, row, position in the row, words by row) of runs of rows."""
    for at, part in c.slices(col, 4 << 20):
        data, offs = c.buffers(part)
        h, row, _ = c.word_hashes(data, offs, "alnum")
        h[h == 0] = 1
        bounds = np.searchsorted(row, np.arange(len(part) + 1))
        words, rows, places = [], [], []
        for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            for s in range(a, max(b, a + 1), shard_words):
                e = min(b, s + shard_words + overlap)
                words += [h[s:e], np.zeros(1, np.uint64)]
                rows.append(np.full(e - s + 1, r))
                places.append(np.arange(s - a, e - a + 1))
        yield at, (np.concatenate(words), np.concatenate(rows), np.concatenate(places), np.diff(bounds))


HITS = "array<struct<item:string,start:long,at:long,n:long>>"
FOUND = f"doc_id long, n_words long, hits {HITS}, marked binary"


class Screen:
    """A bitmap over the hashes of windows of given lengths."""

    def __init__(self, bits: int):
        self.mask, self.bits, self.lens = np.uint64(bits - 1), np.zeros(-(-bits // 8), np.uint8), set()

    def _probe(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(byte, bit) of the k-th probe of each hash."""
        x = c.mix(h + np.uint64((k + 1) * int(_STEP) % (1 << 64))) & self.mask
        return (x >> np.uint64(3)).astype(np.int64), (x & np.uint64(7)).astype(np.uint8)

    @staticmethod
    def windows(words: np.ndarray, size: int) -> np.ndarray:
        out = np.full(max(0, len(words) - size + 1), size, np.uint64)
        for j in range(size if len(out) else 0):
            out = c.mix(out) * _STEP + words[j : j + len(out)]
        return c.mix(out)

    def add(self, words: np.ndarray) -> None:
        size = min(WINDOW, len(words))
        if size:
            self.lens.add(size)
            h = self.windows(words, size)
            for k in range(PROBES):
                byte, bit = self._probe(h, k)
                np.bitwise_or.at(self.bits, byte, np.uint8(1) << bit)

    def may_hold(self, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Which of n rows may have a window of the benchmark; words of all rows, row by row."""
        out = np.zeros(n, bool)
        for size in self.lens:
            h = self.windows(words, size)
            at = np.flatnonzero(row[: len(h)] == row[size - 1 :]) if len(h) else np.empty(0, np.int64)
            h = h[at]
            for k in range(PROBES):
                byte, bit = self._probe(h, k)
                on = (self.bits[byte] >> bit) & 1 > 0
                h, at = h[on], at[on]
            out[row[at]] = True
        return out


def _finder(tests: Tests, shard_words: int):
    def run(it):
        for batch in it:
            for first, (words, row, place, n) in _shards(batch.column(1), WINDOW - 1, shard_words):
                pos, which = occurrences(words, tests)
                hits: list[list] = [[] for _ in n]
                marks: list = [None] * len(n)
                if len(pos):
                    r, at = row[pos], place[pos]
                    size, item = tests.lens[which], tests.item[which]
                    start = tests.starts[which] - tests.offset[item]
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + size, -1)
                    on = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    runs = np.searchsorted(row[on], np.arange(len(n) + 1))  # rows come in order
                    for x in np.flatnonzero(np.diff(runs)):
                        m = np.zeros(int(n[x]), np.uint8)
                        m[place[on[runs[x] : runs[x + 1]]]] = 1
                        marks[x] = np.packbits(m).tobytes()
                    # consecutive windows on one diagonal of a row and item are one longest match
                    key = np.lexsort((at, at - start, item, r))
                    r, at, start, size, item = r[key], at[key], start[key], size[key], item[key]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]) | (at[1:] > at[:-1] + 1)
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(r)) - 1
                    for a, b in zip(head.tolist(), tail.tolist()):
                        hits[r[a]].append({"item": tests.ids[item[a]], "start": int(start[a]), "at": int(at[a]), "n": int(at[b] + size[b] - at[a])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))), pa.array(marks, pa.binary())],
                    ["doc_id", "n_words", "hits", "marked"],
                )

    return run


def _rows(tests: Tests, at_text: int, affected: bool):
    """The rows whose text holds a window of the tests, or those whose text holds none, with their columns."""

    def run(it):
        for batch in it:
            for first, (words, row, _, n) in _shards(batch.column(at_text), WINDOW - 1, SHARD_WORDS):
                bad = np.zeros(len(n), bool)
                bad[row[occurrences(words, tests)[0]]] = True
                yield batch.slice(first, len(n)).filter(pa.array(bad == affected))

    return run


def _items(benchmark: DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """(id, word hashes) of every item, streamed to the driver."""

    def hashed(it):
        for batch in it:
            data, offs = c.buffers(batch.column(1))
            h, row, _ = c.word_hashes(data, offs, "alnum")
            h[h == 0] = 1
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["id", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(hashed, "id string, words binary")
    for r in rows.toLocalIterator():
        yield r.id, np.frombuffer(bytes(r.words), np.uint64)


def test_blocks(benchmark: DataFrame) -> Iterator[Tests]:
    """The items in blocks of at most TEST_WORDS words (an item alone may be longer), made one at a time."""
    ids: list[str] = []
    parts: list[np.ndarray] = []
    for name, words in _items(benchmark):
        if parts and sum(map(len, parts)) + len(words) > TEST_WORDS:
            yield _tests(ids, parts)
            ids, parts = [], []
        ids.append(name)
        parts.append(words)
    if ids:
        yield _tests(ids, parts)


def _tests(ids: list[str], parts: list[np.ndarray]) -> Tests:
    return Tests(ids, np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), WINDOW)


def _screened(screen: Screen, at_text: int, keep_all: bool):
    """The rows that may hold a window of the benchmark; or all rows as (doc_id, n_words, text), the text null where none can be."""

    def run(it):
        for batch in it:
            for first, part in c.slices(batch.column(at_text), 4 << 20):
                data, offs = c.buffers(part)
                h, row, _ = c.word_hashes(data, offs, "alnum")
                h[h == 0] = 1
                may = pa.array(screen.may_hold(h, row, len(part)))
                if not keep_all:
                    yield batch.slice(first, len(part)).filter(may)
                    continue
                n = np.diff(np.searchsorted(row, np.arange(len(part) + 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(n, pa.int64()), pa.compute.if_else(may, part, pa.scalar(None, part.type))], ["doc_id", "n_words", "text"])

    return run


def _merged(it):
    """One bit mask of each row's masks by block."""
    for batch in it:
        out = []
        for marks in batch.column(2).to_pylist():
            one = np.zeros(max(map(len, marks)), np.uint8)
            for m in marks:
                one |= np.frombuffer(m, np.uint8)
            out.append(one.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "hits", "marked"])


def _in_blocks(benchmark: DataFrame) -> tuple[Tests | None, Iterator[Tests] | None, Screen | None]:
    """(the only block, None, None), or (None, all blocks in turn, the screen of all items); nothing but None without items."""
    blocks = test_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return first, None, None
    screen = Screen(SCREEN_BITS)
    for _, words in _items(benchmark):
        screen.add(words)
    return None, itertools.chain([first, second], blocks), screen


def _by_block(rows: DataFrame, blocks: Iterator[Tests], make, schema: str) -> DataFrame:
    """rows.mapInArrow(make(block)) of all blocks, each written before the next is made."""
    path = c.scratch_path(rows.sparkSession)
    for block in blocks:
        rows.mapInArrow(make(block), schema).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, hits, marked): the longest verbatim matches of each document and the bit mask of its hit words."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    only, blocks, screen = _in_blocks(benchmark)
    if blocks is None:
        return rows.mapInArrow(_finder(only or _tests([], [np.empty(0, np.uint64)]), SHARD_WORDS), FOUND)
    seen = rows.mapInArrow(_screened(screen, 1, True), "doc_id long, n_words long, text string").withColumn("row", F.monotonically_increasing_id())
    seen = c.stash(seen)
    found = _by_block(seen.where("text is not null").select("row", "text"), blocks, lambda t: _finder(t, SHARD_WORDS), FOUND).where("marked is not null")
    found = found.groupBy(F.col("doc_id").alias("row")).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.collect_list("marked").alias("marks"))
    found = found.mapInArrow(_merged, f"row long, hits {HITS}, marked binary")
    out = seen.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), "marked")


def _digest(it):
    for batch in it:
        hit, items, sha = [], [], []
        for hits, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            ids = sorted({h["item"] for h in hits})
            hit.append(int(np.bitwise_count(np.frombuffer(m, np.uint8)).sum()) if m else 0)
            items.append(len(ids))
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no test window, judged one by one; nothing is added or renamed.

    One block of the benchmark filters the rows as they pass. Of several, each finds the rows that it affects among those
    that pass the screen, which then go by id and text together.
    """
    only, blocks, screen = _in_blocks(benchmark)
    if blocks is None:
        return docs if only is None else docs.mapInArrow(_rows(only, docs.columns.index("text"), False), docs.schema)
    own = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    keyed = docs.select(F.col("doc_id").alias("__id"), own.alias("__key"), F.col("text").cast("string").alias("__text"))
    some = c.stash(keyed.mapInArrow(_screened(screen, 2, False), keyed.schema))
    bad = _by_block(some, blocks, lambda t: _rows(t, 2, True), some.schema).select("__id", "__key").distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__key")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return report(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "benchmark"))


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM w, ks),
q AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM p),
m AS (SELECT q.doc_id, g.item_id, q.i, q.k FROM q JOIN g ON q.s = g.s AND q.k = g.k),
h AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
