"""Whole-project checks: every issue at once, results written back into the state, and what holds a project up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import PartLimits
from quire.operators import integrity
from quire.operators.integrity import FAIL, issue, level_name, union

#: Columns of qa.part_checks with the code of their check and what it found.
OUTPUT_CODES = {
    "v9": ("V9", "no counterpart"), "v10a": ("V10.A", "number of lines differs"), "v10b": ("V10.B", "lines out of order"), "v10c": ("V10.C", "empty or short lines"),
    "v10d": ("V10.D", "line lengths out of proportion"), "v10e": ("V10.E", "repeated lines"), "v11": ("V11", "marks that do not belong"), "v12": ("V12", "special lines lost"),
    "part_ratio_level": ("V10.part-ratio", "length out of proportion"),
}


def part_id(idx: str = "part_idx") -> Column:
    return F.format_string("part_%03d", idx)


def totals_issues(slices: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """V5 and V6 as issues."""
    return union(
        [
            issue(integrity.part_totals(slices, texts, key).where("not ok"), key, None, FAIL, "V5", "sums of parts differ"),
            issue(integrity.rebuild_check(slices, texts, key).where("not ok"), key, None, FAIL, "V6", "parts do not give the text again"),
        ]
    )


def source_issues(
    texts: DataFrame, recorded: DataFrame, sums: DataFrame, manifest_parts: DataFrame, parts: DataFrame, slices: DataFrame, units: DataFrame, key: str = "source", limits: PartLimits = PartLimits()
) -> DataFrame:
    """V1 to V8: the source, its manifest (recorded profile, sums, parts, units) and the part texts there are now."""
    return union(
        [
            integrity.v1_source(texts, recorded, key), integrity.v2_manifest(slices, sums, key), integrity.v3_parts(manifest_parts, slices, key), integrity.v4_continuity(parts, texts, key),
            totals_issues(slices, texts, key), integrity.v7_sizes(slices, key, limits), integrity.v8_units(units, slices, key),
        ]
    )


def output_issues(levels: DataFrame, key: str = "source") -> DataFrame:
    """V9 to V12: part_checks' levels as issues."""
    found = F.array(*[F.struct(F.col(c).alias("level"), F.lit(code).alias("code"), F.lit(msg).alias("msg")) for c, (code, msg) in OUTPUT_CODES.items()])
    rows = levels.select(key, part_id().alias("part_id"), F.inline(found)).where("level > 0")
    return rows.select(key, "part_id", F.col("level").cast("int").alias("level"), "code", "msg")


def binding_issues(errors: DataFrame, key: str = "source") -> DataFrame:
    """state.binding_errors as issues."""
    return issue(errors, key, None, FAIL, "STATE", F.concat("field", F.lit(" differs")))


def self_check(slices: DataFrame, parts: DataFrame, texts: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    """What forbids writing a split: failures of V4 to V7."""
    return union([integrity.v4_continuity(parts, texts, key), totals_issues(slices, texts, key), integrity.v7_sizes(slices, key, limits)]).where(F.col("level") == FAIL)


def write_back(state: DataFrame, levels: DataFrame, key: str = "source") -> DataFrame:
    """state(key, part_idx, status, needs_human_review) with the outcome of part_checks: verify, checks, text_units, ratio. Parts
    that were not checked keep what they have, and have no outcome."""
    names = [c for c in OUTPUT_CODES if c != "part_ratio_level"]
    checks = F.map_from_arrays(F.array(*[F.lit(OUTPUT_CODES[c][0]) for c in names]), F.array(*[level_name(F.col(c)) for c in names]))
    done = levels.select(
        key, "part_idx", F.col("level").alias("l"), level_name(F.col("level")).alias("verify"), checks.alias("checks"),
        F.struct(F.col("n_src").alias("source"), F.col("n_out").alias("translation"), (F.col("n_out") - F.col("n_src")).alias("delta")).alias("text_units"), "ratio",
    )
    rows = state.join(done, [key, "part_idx"], "left")
    return rows.withColumn("needs_human_review", F.when(F.col("l").isNotNull(), F.col("l") > 0).otherwise(F.col("needs_human_review"))).drop("l")


def settle(state: DataFrame, outputs: DataFrame, levels: DataFrame, confirmed: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, decision, needs_human_review) of the parts a person wants to close: 'done' only for an open part with an
    output that does not fail its checks and that confirmed(key, part_idx) names; else what stands against it."""
    on = [key, "part_idx"]
    flag = lambda rows, name: rows.select(*on).distinct().withColumn(name, F.lit(True))
    rows = state.select(*on, "status").join(flag(outputs, "there"), on, "left").join(flag(confirmed, "sure"), on, "left").join(levels.select(*on, "level"), on, "left")
    decision = (
        F.when(~F.col("status").isin("IN_PROGRESS", "NEEDS_REVIEW"), "not open").when(F.col("there").isNull(), "no output").when(F.col("sure").isNull(), "not confirmed")
        .when(F.coalesce("level", F.lit(FAIL)) == FAIL, "fails its checks").otherwise("done")
    )
    return rows.select(*on, decision.alias("decision"), F.when(decision == "done", F.col("level") > 0).alias("needs_human_review"))


def guarded(events: DataFrame, decisions: DataFrame, key: str = "source") -> DataFrame:
    """events(key, part_idx, action, ...) without the SETTLE events that `settle` does not decide to be done."""
    fine = decisions.where("decision = 'done'").select(key, "part_idx")
    return events.where("action <> 'SETTLE'").unionByName(events.where("action = 'SETTLE'").join(fine, [key, "part_idx"], "left_semi").select(*events.columns))


def status_report(rows: DataFrame, key: str = "source") -> DataFrame:
    """(key, counts by status, current, and the lists hanging, failed_parts, review_parts) of rows(key, part_idx, status, needs_human_review)."""
    n = lambda s: F.count_if(F.col("status") == s)
    named = lambda cond: F.array_sort(F.collect_list(F.when(cond, part_id())))
    return rows.groupBy(key).agg(
        F.count("*").alias("n_parts"), n("PENDING").alias("pending"), n("IN_PROGRESS").alias("in_progress"), n("NEEDS_REVIEW").alias("in_review"), n("DONE").alias("done"), n("FAILED").alias("failed"),
        F.min(F.when(F.col("status") != "DONE", part_id())).alias("current"), named(F.col("status") == "IN_PROGRESS").alias("hanging"), named(F.col("status") == "FAILED").alias("failed_parts"),
        named(F.col("needs_human_review")).alias("review_parts"),
    )


def hanging(rows: DataFrame, outputs: DataFrame, drafts: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, found, advice) of the parts in progress: whether an output, only a draft, or nothing is there."""
    on = [key, "part_idx"]
    flag = lambda some, name: some.select(*on).distinct().withColumn(name, F.lit(True))
    open_ = rows.where("status = 'IN_PROGRESS'").select(*on).join(flag(outputs, "o"), on, "left").join(flag(drafts, "d"), on, "left")
    found = F.when(F.col("o"), "output").when(F.col("d"), "draft").otherwise("nothing")
    advice = F.when(F.col("o"), "read it, then settle").when(F.col("d"), "keep or discard it, then run again").otherwise("run again")
    return open_.select(*on, found.alias("found"), advice.alias("advice"))


def discard(drafts: DataFrame, named: DataFrame, key: str = "source") -> DataFrame:
    """drafts without those that named(key, part_idx) gives up; a name without a draft is an error the caller sees by `unknown`."""
    return drafts.join(named, [key, "part_idx"], "left_anti")


def unknown(drafts: DataFrame, named: DataFrame, key: str = "source") -> DataFrame:
    return named.join(drafts, [key, "part_idx"], "left_anti")
