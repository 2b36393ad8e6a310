"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors are dealt to cells by their nearest of at most CELLS centroids, fitted on a bounded sample (CENTRE_ROWS rows of
CENTRE_BYTES); a cell of more than SHARD_ROWS rows (or SHARD_BYTES) is dealt over shards by a hash of the id. Fewer
vectors make smaller shards, of LEAST_ROWS at least, so that they too spread over tasks. Each shard's task
builds its graph: points enter in batches that double in size; a greedy beam search over the graph so far proposes each point's
neighbours; relaxed distance pruning keeps a neighbour c only if no kept neighbour p has ALPHA * d(p, c) <= d(point, c), so
edges stay diverse; reverse edges are added and a node of too many is pruned the same way. A search starts at the ENTRIES of a
few hundred pivots that are nearest to it; half of these lie far apart and half are random, so every cluster that is apart has
one and every large one several. Copies of one vector within a shard are one node that holds all their ids.

A query visits the shards of its nearest cells, as many as the data ask for: CALIBRATION queries are answered exactly over all
rows, and the cells to visit are the fewest that hold COVER of the neighbours so found. Clustered vectors need few,
vectors without structure all of them. A search of width QUERY_BEAM in each shard gives its best k, and the k best of all
shards are kept. No task holds more than a shard and QUERY_ROWS queries: a shard with more builds its graph once for each such part.

Distances in the graph are Euclidean on unit vectors, which order as the cosine does, in double precision, as near copies
differ in digits that single precision does not have. Scores are recomputed on the original vectors, for the whole beam.

Defined results: vectors that are null, of length zero, or hold null or non-finite components take no part; vectors of
different dimensions never meet (those of another than the most common dimension have one cell each); a query is not its own
candidate, rows of another id with an equal vector are; ties go to the smaller id; of rows with one id and equal vectors, each
counts once. A query without candidates has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as c

SHARD_ROWS, LEAST_ROWS, SHARD_BYTES, QUERY_ROWS = 16384, 4096, 64 << 20, 32768
CELLS, CENTRE_ROWS, CENTRE_BYTES, ROUNDS = 2048, 16384, 32 << 20, 6
CALIBRATION, COVER = 256, 0.99
DEGREE, BEAM, ALPHA, ENTRIES = 32, 64, 1.2, 24
#: Width of a query's beam; building uses BEAM.
QUERY_BEAM = 192
TOP = 5


class Graph:
    """A pruned graph over distinct unit vectors; `best` answers many queries at once."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam, self.alpha = np.ascontiguousarray(unit, dtype=np.float64), degree, beam, alpha
        n = len(unit)
        self.edges = np.full((n, degree), -1, np.int32)
        if not n:
            return
        rng = np.random.default_rng(3)
        order = rng.permutation(n)
        far = self._spread(min(n, max(2 * ENTRIES, math.isqrt(4 * n))))
        order = np.concatenate((far, order[~np.isin(order, far)]))
        most = 2 * len(far)
        self.entries = order[: min(n, ENTRIES, self.beam // 2)]
        at, size = 0, len(self.entries)
        while at < n:
            # the first batches are small, as a point must find those before it in the graph
            take = order[at : at + min(size, max(ENTRIES, at >> 3), 1024)]
            self._insert(take)
            at += len(take)
            size *= 2
            self.entries = order[: min(at, most)]

    def _spread(self, k: int) -> np.ndarray:
        """k points far apart, from the one nearest to the mean on, so no dense cluster shuts the rest off."""
        found = [int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1)))]
        least = np.full(len(self.x), np.inf)
        while len(found) < k:
            np.minimum(least, 2.0 - 2.0 * (self.x @ self.x[found[-1]]), out=least)
            found.append(int(np.argmax(least)))
        return np.array(list(dict.fromkeys(found)))

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of a's rows to the points b[row]; -1 gives infinity."""
        d = 2.0 - 2.0 * np.einsum("ijk,ik->ij", self.x[b], a)
        d[b < 0] = np.inf
        return d

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of the beam that greedy search ends with, for each row of q, nearest first."""
        n, m = len(self.x), len(q)
        e = min(len(self.entries), ENTRIES, self.beam // 2)
        first = np.argpartition(-(q @ self.x[self.entries].T), e - 1, axis=1)[:, :e]
        ids = np.full((m, beam), -1, np.int32)
        ids[:, :e] = self.entries[first]
        dist = np.full((m, beam), np.inf)
        dist[:, :e] = self._near(q, ids[:, :e])
        done = np.ones((m, beam), bool)
        done[:, :e] = False
        seen = np.zeros((m, n), bool)
        seen[np.arange(m)[:, None], ids[:, :e]] = True
        live = np.arange(m)
        while len(live):
            todo = np.where(done[live], np.inf, dist[live])
            pick = np.argmin(todo, axis=1)
            more = np.isfinite(todo[np.arange(len(live)), pick])
            live, pick = live[more], pick[more]
            if not len(live):
                break
            done[live, pick] = True
            new = self.edges[ids[live, pick]]
            fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            new = np.where(fresh, new, -1)
            r, k = np.nonzero(fresh)
            seen[live[r], new[r, k]] = True
            d = np.full(new.shape, np.inf)
            d[r, k] = 2.0 - 2.0 * np.einsum("ij,ij->i", self.x[new[r, k]], q[live[r]])
            # a beam without a nearer one among them stays as it is
            near = (d < dist[live, -1:]).any(axis=1)
            some, d, new, fresh = live[near], d[near], new[near], fresh[near]
            all_d = np.concatenate([dist[some], d], 1)
            all_i = np.concatenate([ids[some], new], 1)
            all_f = np.concatenate([done[some], ~fresh], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[some], ids[some], done[some] = (np.take_along_axis(v, keep, 1) for v in (all_d, all_i, all_f))
        return ids, dist

    def _prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of candidate rows (-1: none) of each point to at most `degree` diverse neighbours."""
        cand = np.where(cand == points[:, None], -1, cand)
        d = self._near(self.x[points], cand)
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        same = np.zeros(cand.shape, bool)
        by_id = np.argsort(cand, axis=1, kind="stable")
        s = np.take_along_axis(cand, by_id, 1)
        dup = np.zeros(cand.shape, bool)
        dup[:, 1:] = s[:, 1:] == s[:, :-1]
        np.put_along_axis(same, by_id, dup, 1)
        alive = (cand >= 0) & ~same
        v = self.x[cand]
        between = 2.0 - 2.0 * (v @ v.transpose(0, 2, 1))
        out = np.full((len(points), self.degree), -1, np.int32)
        rows = np.arange(len(points))
        limit = self.alpha * self.alpha  # distances are squared
        for k in range(self.degree):
            first = np.argmax(alive, axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[has, k] = cand[rows, first][has]
            alive &= ~((limit * between[rows, first] <= d) & has[:, None])
            alive[rows, first] = False
        return out

    def _insert(self, take: np.ndarray) -> None:
        for part in np.array_split(take, -(-len(take) // 256)):
            found, _ = self._search(self.x[part], self.beam)
            self.edges[part] = self._prune(part, np.concatenate([found, self.edges[part]], 1))
        a = np.repeat(take, self.degree)
        b = self.edges[take].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        target, start, count = np.unique(b, return_index=True, return_counts=True)
        most = 2 * self.degree  # a node's nearest callers; pruning would leave at most `degree` of all anyway
        d = ((self.x[a] - self.x[b]) ** 2).sum(axis=1)
        order = np.lexsort((d, b))
        a = a[order]
        for lo in range(0, len(target), 256):
            t, s, k = target[lo : lo + 256], start[lo : lo + 256], np.minimum(count[lo : lo + 256], most)
            width = int(k.max())
            into = np.arange(width)[None, :] < k[:, None]
            callers = np.full((len(t), width), -1, np.int32)
            callers[into] = a[(s[:, None] + np.arange(width)[None, :])[into]]
            both = np.concatenate([self.edges[t], callers], 1)
            self.edges[t] = self._prune(t, both)

    def best(self, q: np.ndarray, k: int) -> np.ndarray:
        """The k nearest nodes found for each unit row of q (-1 pads), by beam search."""
        if not len(self.x):
            return np.empty((len(q), 0), np.int32)
        out = [self._search(np.ascontiguousarray(p, np.float64), max(QUERY_BEAM, k))[0][:, :k] for p in np.array_split(q, -(-len(q) // 256))]
        return np.concatenate(out)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("dim", F.size("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaling by the largest component keeps extreme lengths finite."""
    big = lambda v: np.where((m := np.abs(v).max(axis=1, keepdims=True)) > 1e100, m, np.where(m < 1e-100, m, 1.0))
    a, b = a / big(a), b / big(b)
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]  # noqa: E731  in the order of the components, as SQL sums them
    return np.clip(dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)), -1.0, 1.0)


class Shard:
    """A shard's rows, its distinct vectors and their graph."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids,))
        ids, v = ids[order], v[order]
        _, first, node = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.v = v[first]
        by = np.argsort(node, kind="stable")
        self.ids, self.at = ids[by], np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(first)))))
        self.graph = Graph(_unit(self.v))

    def top(self, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        found = self.graph.best(_unit(q), max(QUERY_BEAM, k))
        r, j = np.nonzero(found >= 0)
        node = found[r, j]
        score = _cosine(q[r], self.v[node])
        for i, nodes, scores in zip(qids, np.split(node, np.searchsorted(r, np.arange(1, len(q)))), np.split(score, np.searchsorted(r, np.arange(1, len(q))))):
            rows = [(-s, int(x)) for n, s in zip(nodes.tolist(), scores.tolist()) for x in self.ids[self.at[n] : self.at[n + 1]][: k + 1] if x != i]
            for s, x in sorted(rows)[:k]:
                yield int(i), x, -s


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), dim)


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the unit vectors of a sample by Lloyd's rounds from its first rows."""
    x = _unit(sample).astype(np.float32)
    mid = x[:k].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, mid, 1)[:, 0]
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(mid)
        np.add.at(total, own, x)
        mid[n > 0] = total[n > 0] / n[n > 0, None]
    return mid


def _nearest(x: np.ndarray, mid: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = []
    for part in np.array_split(x, max(1, len(x) >> 12)):
        d = (mid * mid).sum(axis=1) - 2 * (part @ mid.T)
        out.append(np.argmin(d, axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def _placing(mid: np.ndarray, dim: int, visits: int):
    """(id, v, cells): each row's `visits` nearest cells."""

    def run(it):
        for batch in it:
            if batch.num_rows:
                cells = _nearest(_unit(_matrix(batch.column(1), dim)).astype(np.float32), mid, visits).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "v", "cells"])

    return run


def _exact(ids: np.ndarray, q: np.ndarray, dim: int, k: int):
    """(query, cell, score): each query's k nearest of a batch, by all distances."""
    unit = _unit(q)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            score = unit @ _unit(_matrix(batch.column(1), dim)).T
            score[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(score, top, 1)
            r, j = np.nonzero(np.isfinite(value))
            cells = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(cells[top[r, j]]), pa.array(value[r, j])], ["query", "cell", "score"])

    return run


def _visits(rows: DataFrame, asked: DataFrame, mid: np.ndarray, dim: int, k: int) -> int:
    """How many nearest cells hold COVER of the neighbours of a sample of queries."""
    sample = asked.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).select("id", "v").collect()
    if not sample:
        return 1
    ids, q = np.array([r.id for r in sample]), np.array([r.v for r in sample])
    found = rows.select("id", "v", "cell").mapInArrow(_exact(ids, q, dim, k), "query int, cell int, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cell")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "cell").collect()
    place = np.argsort(_nearest(_unit(q).astype(np.float32), mid, len(mid)), axis=1)  # of each cell in each query's order
    ranks = np.sort([place[r["query"], r.cell] for r in found])
    return int(ranks[min(len(ranks) - 1, math.ceil(COVER * len(ranks)) - 1)]) + 1 if len(ranks) else 1


def _task(k: int):
    def run(key, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(shard) and len(queries):
            built = Shard(shard["id"].to_numpy(), np.stack(shard["v"].to_numpy()))
            out += built.top(queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _spread(spark, n: int) -> DataFrame:
    """(slot, key): a key for each of n slots that hash partitioning over n partitions puts into a partition of its own."""
    if n > 1 << 20:
        return spark.range(n).select(F.col("id").alias("slot"), F.col("id").cast("int").alias("key"))
    tried = spark.range(n * (16 + n.bit_length()), numPartitions=1).select(F.col("id").cast("int").alias("key"))
    own = tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("slot")).agg(F.min("key").alias("key"))
    # a slot that no try fell into, which is rare, shares a partition
    return spark.range(n).select(F.col("id").alias("slot")).join(own, "slot", "left").select("slot", F.coalesce("key", (-1 - F.col("slot")).cast("int")).alias("key"))


def search(vectors: DataFrame, is_query: Column, k: int = TOP, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among the other rows."""
    spark = vectors.sparkSession
    rows = c.stash(usable(vectors).withColumn("asked", is_query))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (sizes[0].dim, sizes[0].n) if sizes else (1, 0)
    most = shard_rows or max(1, min(SHARD_ROWS, max(LEAST_ROWS, n >> 5), SHARD_BYTES // (8 * dim)))
    common = rows.where(F.col("dim") == dim)
    cells, visits = min(CELLS, -(-n // most)), 1
    one = F.when(F.col("dim") == dim, 0).otherwise(-F.col("dim"))
    data, asked = rows.select("id", "v", one.alias("cell")), rows.where("asked").select("id", "v", one.alias("cell"))
    if cells > 1:
        sample = common.orderBy(F.xxhash64("id"), "id").limit(max(cells, min(CENTRE_ROWS, CENTRE_BYTES // (8 * dim)))).select("v").collect()
        mid = centres(np.array([r.v for r in sample]), cells)
        placed = common.select("id", "v").mapInArrow(_placing(mid, dim, 1), "id long, v array<double>, cells array<int>")
        placed = c.stash(placed.select("id", "v", F.col("cells")[0].alias("cell")))
        visits = _visits(placed, common.where("asked"), mid, dim, k)
        routed = common.where("asked").select("id", "v").mapInArrow(_placing(mid, dim, visits), "id long, v array<double>, cells array<int>")
        rest = F.col("dim") != dim
        data = placed.unionByName(rows.where(rest).select("id", "v", one.alias("cell")))
        asked = routed.select("id", "v", F.explode("cells").alias("cell")).unionByName(rows.where(rest & F.col("asked")).select("id", "v", one.alias("cell")))
    # a cell's shards, and how many parts of its queries each serves
    room = lambda col, size: F.ceil(col / F.lit(size)).cast("int")
    per = data.groupBy("cell").agg(room(F.count("*"), most).alias("shards")).join(asked.groupBy("cell").agg(room(F.count("*"), QUERY_ROWS).alias("parts")), "cell")
    per = c.stash(per.withColumn("base", F.sum(F.col("shards") * F.col("parts")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["base"]))
    slots = per.agg(F.sum(F.col("shards") * F.col("parts"))).first()[0] or 1
    keys = c.stash(_spread(spark, slots))
    pick = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    data = data.join(per, "cell").withColumn("s", pick("shards", 1)).withColumn("p", every("parts"))
    asked = asked.join(per, "cell").withColumn("p", pick("parts", 2)).withColumn("s", every("shards"))
    slot = F.col("base") + F.col("s") * F.col("parts") + F.col("p")
    data, asked = (x.withColumn("slot", slot).join(keys, "slot").select(*[F.col(n).alias(n) for n in ("key", "id", "v")]).repartition(slots, "key") for x in (data, asked))
    found = data.groupBy("key").cogroup(asked.groupBy("key")).applyInPandas(_task(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(c.read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(q.e, d.e) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
