import pytest
from pyspark.sql import functions as F

from quire.config import PartLimits
from quire.operators import state as S
from quire.sources import writers


def test_limits_from_environment_take_plain_digits_only():
    got = PartLimits.from_env({"QUIRE_HARD_MAX": "30000", "QUIRE_MIN_PART": "x", "QUIRE_TARGET_MAX": "-5"})
    assert (got.hard_max, got.min_part, got.target_max) == (30000, 2000, 15000)


def test_initial_state_is_pending_and_bound(spark):
    parts = spark.createDataFrame([("a", 1, "part_001", "h1")], "source string, part_idx int, part_id string, sha256 string")
    r = S.initial(parts).first()
    assert (r.status, r.attempts, r.input_sha256, r.needs_human_review) == ("PENDING", 0, "h1", False)
    assert S.progress(S.with_status(parts, S.initial(parts).limit(0))).first().pending == 1


def test_binding_claims_and_stale(spark):
    cols = "source string, source_sha256 string, manifest_sha256 string, part_count int"
    made = spark.createDataFrame([("a", "s", "m", 2), ("b", "s", "m", 2)], cols)
    held = spark.createDataFrame([("a", "s", "x", 3), ("b", "s", "m", 2)], cols)
    assert sorted((r.source, r.field) for r in S.binding_errors(held, made).collect()) == [("a", "manifest_sha256"), ("a", "part_count")]
    events = spark.createDataFrame([(1, 2, "CLAIM", "late"), (1, 1, "CLAIM", "first"), (2, 1, "RESET", "no")], "key long, seq long, action string, token string")
    assert [(r.key, r.token) for r in S.claims(events).collect()] == [(1, "first")]
    rows = spark.createDataFrame([("old", "IN_PROGRESS", 0), ("new", "IN_PROGRESS", 1900), ("done", "DONE", 0)], "id string, status string, t long").withColumn("heartbeat", F.timestamp_seconds("t"))
    assert [r.id for r in S.stale(rows, F.timestamp_seconds(F.lit(2000))).collect()] == ["old"]


def test_state_tables_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "key long, note string")
    for _ in range(2):
        writers.append_events(df, str(tmp_path / "events"))
        writers.archive(df, str(tmp_path / "archive"))
        writers.save_state(df, str(tmp_path / "state"), "test")
    assert spark.read.parquet(str(tmp_path / "events")).count() == spark.read.parquet(str(tmp_path / "archive")).count() == 2
    state = spark.read.parquet(str(tmp_path / "state"))
    assert state.count() == 1 and state.first().updated_by == "test"
    writers.write_manifest(df, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 1


def test_a_state_is_replaced_whole_and_started_once(spark, tmp_path):
    path = str(tmp_path / "state")
    writers.start_state(spark.createDataFrame([(1, "PENDING")], "key long, status string"), path, "init")
    writers.save_state(spark.read.parquet(path).select("key", F.lit("DONE").alias("status")), path, "next")
    assert [(r.status, r.updated_by) for r in spark.read.parquet(path).collect()] == [("DONE", "next")]
    with pytest.raises(ValueError, match="already"):
        writers.start_state(spark.read.parquet(path), path, "again")
    broken = spark.read.parquet(path).select("key", F.raise_error(F.lit("stop")).cast("string").alias("status"))
    with pytest.raises(Exception, match="stop"):
        writers.save_state(broken, path, "broken")
    assert spark.read.parquet(path).first().status == "DONE"
    writers.start_state(spark.createDataFrame([(2, "PENDING")], "key long, status string"), path, "init", rebuild=True)
    assert spark.read.parquet(path).first().key == 2


def test_report_puts_failures_first(spark):
    rows = spark.createDataFrame([("a", None, 1, "V7", "w"), ("a", "part_001", 2, "V3", "f")], "source string, part_id string, level int, code string, msg string")
    assert ['"level":2' in r.value for r in writers.report_json(rows).collect()] == [True, False]
