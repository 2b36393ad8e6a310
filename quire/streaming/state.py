"""The part state machine on a stream: the same transitions as operators.state.fold, one emitted row an event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.state import MAX_ATTEMPTS

OUTPUT = "key long, seq long, status string, attempts int, needs_human_review boolean, stale boolean"
STATE = "status string, attempts int, review boolean, seq long"


def step(status: str, attempts: int, review: bool, action: str) -> tuple[str, int, bool]:
    """One transition; an action that does not apply changes nothing."""
    if action == "RESET":
        return "PENDING", 0, False
    if action == "APPROVE":
        return status, attempts, False
    if action == "CLAIM":
        return ("IN_PROGRESS", attempts + 1, review) if status in ("PENDING", "IN_PROGRESS") else (status, attempts, review)
    if status != "IN_PROGRESS":
        return status, attempts, review
    spent = attempts >= MAX_ATTEMPTS
    if action in ("COMMIT_PASS", "SETTLE"):
        return "DONE", attempts, False
    if action == "COMMIT_WARN":
        return "DONE", attempts, True
    if action == "COMMIT_FAIL":
        return ("FAILED" if spent else "IN_PROGRESS"), attempts, True
    if action in ("LLM_ERROR", "TRUNCATED"):
        return ("FAILED" if spent else "PENDING"), attempts, review
    return status, attempts, review


def _runner(stale_seconds: int):
    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        status, attempts, review, last = state.get if state.exists else ("PENDING", 0, False, 0)
        rows = []
        if state.hasTimedOut:
            rows.append((key[0], last, status, attempts, review, status == "IN_PROGRESS"))
        for pdf in () if state.hasTimedOut else batches:
            for seq, action in sorted(zip(pdf["seq"].tolist(), pdf["action"].tolist())):
                if seq <= last:  # an event delivered again changes nothing
                    continue
                status, attempts, review = step(status, attempts, review, action)
                last = seq
                rows.append((key[0], seq, status, attempts, review, False))
        state.update((status, attempts, review, last))
        if status == "IN_PROGRESS" and not state.hasTimedOut:
            state.setTimeoutDuration(stale_seconds * 1000)
        yield pd.DataFrame(rows, columns=["key", "seq", "status", "attempts", "needs_human_review", "stale"])

    return run


def track(events: DataFrame, stale_seconds: int = 1800) -> DataFrame:
    """events(key, seq, action) as a stream to every key's state after each event; events of a key come in seq order. A key in
    progress that has had no event, a heartbeat among them, for stale_seconds gives one more row, marked stale."""
    return events.select("key", "seq", "action").groupBy("key").applyInPandasWithState(_runner(stale_seconds), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
