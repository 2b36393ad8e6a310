"""Progress of parts as a fold over events.

Events (key, seq, ts, action) of one part, in seq order: CLAIM, COMMIT_PASS, COMMIT_WARN, COMMIT_FAIL, LLM_ERROR, TRUNCATED,
SETTLE, APPROVE, UNLOCK, RESET. One transition function serves the batch fold below and the streaming operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
STATUSES = ("PENDING", "IN_PROGRESS", "NEEDS_REVIEW", "DONE", "FAILED")


def initial(parts: DataFrame, key: str = "source") -> DataFrame:
    """All parts pending, bound to their hashes."""
    return parts.select(
        key, "part_idx", "part_id", F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.col("sha256").alias("input_sha256"), F.lit(False).alias("needs_human_review"),
        F.lit(None).cast("string").alias("output_sha256"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )


def _next(status: Column, attempts: Column, action: Column) -> tuple[Column, Column, Column]:
    """(status, attempts, whether a person must look) after an action; an action that does not apply changes nothing."""
    spent = attempts >= MAX_ATTEMPTS
    claim, reset = (action == "CLAIM") & status.isin("PENDING", "IN_PROGRESS"), action == "RESET"
    open_ = status == "IN_PROGRESS"
    to = (
        F.when(reset, "PENDING").when(claim, "IN_PROGRESS")
        .when(open_ & action.isin("COMMIT_PASS", "COMMIT_WARN", "SETTLE"), "DONE")
        .when(open_ & (action == "COMMIT_FAIL"), F.when(spent, "FAILED").otherwise("IN_PROGRESS"))
        .when(open_ & action.isin("LLM_ERROR", "TRUNCATED"), F.when(spent, "FAILED").otherwise("PENDING"))
        .otherwise(status)
    )
    n = F.when(reset, F.lit(0)).when(claim, attempts + 1).otherwise(attempts)
    flag = F.when(reset | (action == "APPROVE") | (open_ & action.isin("COMMIT_PASS", "SETTLE")), F.lit(False)).when(open_ & action.isin("COMMIT_WARN", "COMMIT_FAIL"), F.lit(True))
    return to, n, flag


def fold(events: DataFrame, key: str = "key") -> DataFrame:
    """(key, status, attempts, needs_human_review, n_events) after all events of each key."""
    start = F.struct(F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(False).alias("review"))

    def step(acc, e):
        to, n, flag = _next(acc["status"], acc["attempts"], e["action"])
        return F.struct(to.alias("status"), n.alias("attempts"), F.coalesce(flag, acc["review"]).alias("review"))

    ordered = F.array_sort(F.collect_list(F.struct("seq", "action")))
    rows = events.groupBy(key).agg(F.count("*").alias("n_events"), F.aggregate(ordered, start, step).alias("s"))
    return rows.select(key, F.col("s.status").alias("status"), F.col("s.attempts").alias("attempts"), F.col("s.review").alias("needs_human_review"), "n_events")


def history(events: DataFrame, key: str = "key") -> DataFrame:
    """(key, seq, action, from, to): every event with the status before and after it."""
    step_of = lambda acc, e: _next(acc["status"], acc["attempts"], e["action"])
    log = "array<struct<seq:bigint,action:string,from:string,to:string>>"
    start = F.struct(F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.array().cast(log).alias("log"))

    def step(acc, e):
        to, n, _ = step_of(acc, e)
        entry = F.struct(e["seq"].cast("long").alias("seq"), e["action"].alias("action"), acc["status"].alias("from"), to.alias("to"))
        return F.struct(to.alias("status"), n.alias("attempts"), F.concat(acc["log"], F.array(entry)).alias("log"))

    ordered = F.array_sort(F.collect_list(F.struct("seq", "action")))
    rows = events.groupBy(key).agg(F.aggregate(ordered, start, step).alias("s"))
    return rows.select(key, F.explode("s.log").alias("e")).select(key, "e.seq", "e.action", F.col("e.from").alias("from_status"), F.col("e.to").alias("to_status"))


def with_status(parts: DataFrame, state: DataFrame, key: str = "source") -> DataFrame:
    """parts with their state; a part without one is pending."""
    rows = parts.join(state.select(key, "part_idx", "status", "needs_human_review"), [key, "part_idx"], "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("PENDING")), "needs_human_review": F.coalesce("needs_human_review", F.lit(False))})


def progress(rows: DataFrame, key: str = "source") -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(key).agg(F.count("*").alias("n_parts"), n("PENDING").alias("pending"), n("IN_PROGRESS").alias("in_progress"), n("DONE").alias("done"), n("FAILED").alias("failed"), F.count_if("needs_human_review").alias("review"))


def next_part(rows: DataFrame, key: str = "source") -> DataFrame:
    """(key, next_idx, blocked): the first part that is not done, null when all are; a failed one blocks."""
    rest = F.when(F.col("status") != "DONE", F.col("part_idx"))
    out = rows.groupBy(key).agg(F.min(rest).alias("next_idx"), F.min(F.when(F.col("status") == "FAILED", F.col("part_idx"))).alias("failed_idx"))
    return out.select(key, "next_idx", F.coalesce(F.col("failed_idx") == F.col("next_idx"), F.lit(False)).alias("blocked"))


def binding_errors(state: DataFrame, manifest: DataFrame, key: str = "source") -> DataFrame:
    """(key, field) where a state's source hash, manifest hash or part count differs from the manifest's."""
    fields = ("source_sha256", "manifest_sha256", "part_count")
    rows = state.select(key, *[F.col(f).alias(f"s_{f}") for f in fields]).join(manifest.select(key, *fields), key)
    bad = F.array_compact(F.array(*[F.when(F.col(f"s_{f}") != F.col(f), F.lit(f)) for f in fields]))
    return rows.select(key, F.explode(bad).alias("field"))


def missing_outputs(parts: DataFrame, outputs: DataFrame, key: str = "source") -> DataFrame:
    return parts.select(key, "part_idx", "part_id").join(outputs.select(key, "part_idx").distinct(), [key, "part_idx"], "left_anti")


def stale(rows: DataFrame, now: Column, seconds: int = 1800) -> DataFrame:
    """Claimed rows(status, heartbeat) whose heartbeat is older than `seconds`."""
    return rows.where((F.col("status") == "IN_PROGRESS") & (F.unix_timestamp(now) - F.unix_timestamp("heartbeat") > seconds))


def claims(events: DataFrame, key: str = "key") -> DataFrame:
    """(key, token): the winner among the tokens that claim a key, the first by seq."""
    return events.where("action = 'CLAIM'").groupBy(key).agg(F.min_by("token", "seq").alias("token"))


def latest(events: DataFrame, key: str = "key") -> DataFrame:
    """Each key's last event, without a sort of its history."""
    return events.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("action", "seq").alias("action"))
