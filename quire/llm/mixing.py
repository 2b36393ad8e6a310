"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a fixed hash. A source whose target is r times its size takes each document floor(r) times and, once
more, those whose hash lies below a threshold. The threshold comes from histograms: sizes are summed by source and hash
bucket (the hash's leading hex digits), the bucket in which the budget ends is found from running sums over that small
histogram, and only that bucket is refined by further digits, until it holds one hash. Then one filter takes the
documents; nothing is sorted. A larger budget takes a superset of what a smaller one takes.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the budget; a target stops at LIMIT times
its source's size and the excess is shared again by weight. Documents are taken whole, so a source ends within half of
its boundary document of its target.

Defined results: a null or word-less text has size 0 and takes 0; a null source is a source of its own; repeated rows
(equal id and text) have equal hashes and are taken or left together; an empty table gives no rows. Extra columns are
ignored by mix() and kept by apply_mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common as c

WEIGHTS = (5, 2, 1)
BUDGET, LIMIT = 1.5, 2.0
DIGITS, STEP = 15, 3


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    """The first DIGITS hex digits of a hash of a document's id and text."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text).cast("binary")), 1, DIGITS)


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(text).alias("size"), _hash(F.col("doc_id"), text).alias("h"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Add rn: the 0-based place of each source by code point, null last; range partitions are ranked side by side."""
    key = [F.col("source").isNull(), F.col("source")]
    n = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = c.stash(sources.repartitionByRange(int(n), *key).withColumn("part", F.spark_partition_id()))
    here = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    counts = dealt.groupBy("part").agg(F.count("*").alias("k"))
    before = counts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    return dealt.withColumn("here", here).join(F.broadcast(before), "part").withColumn("rn", F.col("here") + F.col("before")).drop("part", "here", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) of sizes(source, size): capped shares, found by raising the capped set until it holds."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rn") % len(weights) + 1).cast("int"))
    per = c.stash(_ranked(per).withColumn("w", w))
    cap = F.col("source_size") * F.lit(float(limit))
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"] * budget
    level, capped = 0.0, -1
    while True:
        over = cap < F.col("w") * level  # a capped source stays capped: the level only rises
        got = per.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("w"),
            F.count_if(over).alias("n"),
        ).first()
        if got["n"] == capped or not got["w"]:
            break
        level, capped = (total - got["full"]) / got["w"], got["n"]
    return per.select("source", "source_size", F.least(cap, F.col("w") * level).alias("target"))


def _same(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with `whole` and `upto`: documents whose hash is below or at `upto` are taken once more."""
    need = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    need = need.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    state = c.stash(need.select("source", "source_size", "target", "whole", "rest", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("upto"), (F.col("rest") > 0).alias("open")))
    for depth in range(STEP, DIGITS + 1, STEP):
        live = state.where("open").select(F.col("source").alias("s"), "prefix", "rest")
        # hot sources are summed by bucket before anything moves; the open sources' prefixes come to that histogram
        rows = docs.groupBy("source", F.substring("h", 1, depth).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        if depth > STEP:
            inside = docs.join(live, _same("source", "s") & docs["h"].startswith(F.col("prefix")), "left_semi")
            rows = inside.groupBy("source", F.substring("h", 1, depth).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        w = Window.partitionBy("source").orderBy("bucket")
        hist = rows.join(live, _same("source", "s")).withColumn("upper", F.sum("size").over(w))
        # the budget ends in the first bucket whose running sum exceeds it
        edge = hist.where("upper > rest").groupBy("s").agg(F.min_by(F.struct("bucket", "size", "low", "high", "upper"), "bucket").alias("e"))
        old = state.join(edge.withColumnRenamed("s", "es"), _same("source", "es"), "left")
        before = F.col("e.upper") - F.col("e.size")
        single = F.col("e.low") == F.col("e.high")
        left = F.col("rest") - before
        state = c.stash(
            old.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("e").isNotNull(), left).otherwise(F.col("rest")).alias("rest"),
                F.when(F.col("e").isNotNull(), F.col("e.bucket")).otherwise(F.col("prefix")).alias("prefix"),
                F.when(F.col("e").isNull(), F.when(F.col("open"), F.lit("g")).otherwise(F.col("upto")))
                .when(single, F.when(left * 2 >= F.col("e.size"), F.col("e.low")).otherwise(F.substring("e.low", 1, DIGITS - 1)))
                .otherwise(F.col("upto")).alias("upto"),
                (F.col("open") & F.col("e").isNotNull() & ~single).alias("open"),
            )
        )
        if not state.where("open").limit(1).count():
            break
    return state


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, text, source)."""
    rows = c.stash(sized(docs))
    plan = thresholds(rows, targets(rows)).withColumnRenamed("source", "s").select("s", "source_size", "target", "whole", "upto")
    once_more = F.when(F.coalesce(F.col("h") <= F.col("upto"), F.lit(False)), 1).otherwise(0)
    out = rows.join(plan, _same("source", "s"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + once_more)).alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target and taken (which replace columns of those names)."""
    rows = c.stash(sized(docs))
    plan = thresholds(rows, targets(rows)).select(F.col("source").alias("__s"), F.col("source_size").alias("__z"), F.col("target").alias("__t"), "whole", "upto")
    plan = plan.withColumnsRenamed({"whole": "__whole", "upto": "__upto"})
    own = [x for x in docs.columns if x not in ("size", "source_size", "target", "taken")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*own, _size(text).alias("__size"), _hash(F.col("doc_id"), text).alias("__h"))
    joined = keyed.join(plan, F.col("source").cast("string").eqNullSafe(F.col("__s")))
    once_more = F.when(F.coalesce(F.col("__h") <= F.col("__upto"), F.lit(False)), 1).otherwise(0)
    taken = F.col("__size") * (F.col("__whole") + once_more)
    return joined.select(*own, F.col("__size").alias("size"), F.col("__z").alias("source_size"), F.col("__t").alias("target"), taken.alias("taken")).where("taken > 0")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(c.read(spark, sf_dir, "documents"))


def _sql() -> str:
    rounds, at = [], "l0"
    for k in range(1, 13):
        rounds.append(
            f"l{k} AS (SELECT coalesce((SELECT (SELECT coalesce(sum(source_size), 0) * {BUDGET} FROM p) - coalesce(sum(CASE WHEN source_size * {LIMIT} < w * (SELECT v FROM {at}) THEN source_size * {LIMIT} END), 0) FROM p)"
            f" / nullif((SELECT sum(CASE WHEN source_size * {LIMIT} < w * (SELECT v FROM {at}) THEN 0 ELSE w END) FROM p), 0), (SELECT v FROM {at})) AS v)"
        )
        at = f"l{k}"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {DIGITS}) AS h FROM documents),
p AS (SELECT source, source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY 1)),
l0 AS (SELECT 0.0::DOUBLE AS v), {", ".join(rounds)},
t AS (SELECT source, source_size, least(source_size * {LIMIT}, w * (SELECT v FROM {at})) AS target FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM r),
x AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upper,
  sum(d.size) OVER (PARTITION BY d.source, d.h) AS own FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (upper <= rest OR 2 * (rest - (upper - own)) >= own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""


SQL = _sql()
