"""Whole-project checks, settling, bands, the punctuation pass, staged outputs and the sources' rules."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.config import PartLimits, RatioBands, Run
from quire.functions import lang, punct
from quire.functions import text as T
from quire.operators import audit as A
from quire.operators import integrity as I
from quire.operators import manifest as M
from quire.operators import prompt as R
from quire.operators import qa
from quire.operators import state as S
from quire.operators import units as U
from quire.plans import parts as P
from quire.sources import readers, writers

LIMITS = PartLimits(20, 60, 80, 2)


def project(spark):
    texts = spark.createDataFrame([("a", "one line here\n\ntwo lines there\n" * 9), ("b", "x\ny\n\n\n\n\n\nz\n\n")], "source string, text string")
    plan = P.plan_greedy(texts, limits=LIMITS)
    slices = P.part_slices(texts, plan)
    return texts, plan, slices, P.part_units(U.units(texts), plan)


def lines_of(units):
    return units.select("source", "part_idx", F.col("index").alias("oi"), F.upper(T.strip(F.col("text"))).alias("line"))


def sums_of(slices):
    return slices.groupBy("source").agg(F.count("*").alias("part_count"), F.sum("char_count").alias("total_char_count"), F.sum("byte_count").alias("total_byte_count"))


def test_audit_of_a_sound_project_is_empty_and_finds_each_fault(spark):
    texts, plan, slices, units = project(spark)
    whole = lambda now: A.source_issues(texts, U.source_profile(texts), sums_of(slices), slices, plan, now, units, limits=LIMITS)
    assert whole(slices).collect() == []
    levels = qa.part_checks(units, lines_of(units), qa.zip_pairs(units, lines_of(units), qa.counts(units, lines_of(units))))
    assert {r.level for r in levels.collect()} == {0} and A.output_issues(levels).collect() == []
    lost = {(r.source, r.code) for r in whole(slices.where("not (source = 'a' and part_idx = 2)")).collect()}
    assert lost == {("a", c) for c in ("V2", "V3", "V5", "V6", "V8")}
    short = lines_of(units).withColumn("line", F.when(F.col("source") == "a", F.lit("```")).otherwise(F.col("line")))
    levels = qa.part_checks(units, short, qa.zip_pairs(units, short, qa.counts(units, short)))
    found = A.output_issues(levels).select("source", "code").distinct().collect()
    assert {(r.source, r.code) for r in found} >= {("a", "V11"), ("a", "V10.part-ratio")} and all(r.source == "a" for r in found)


def test_a_split_that_fails_its_checks_is_not_written(spark, tmp_path):
    texts, plan, slices, units = project(spark)
    made = M.manifest(texts, slices, units, P.chapter_labels(units, plan))
    broken = A.self_check(slices.where("part_idx > 1"), plan, texts, limits=LIMITS)
    with pytest.raises(ValueError, match="V5|V6"):
        writers.write_split(slices, made, broken, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()
    writers.write_split(slices, made, A.self_check(slices, plan, texts, limits=LIMITS), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/parts")).count() == slices.count()


def test_settle_needs_output_confirmation_and_checks(spark):
    state = spark.createDataFrame([("a", i, s, False) for i, s in enumerate(["DONE", "IN_PROGRESS", "IN_PROGRESS", "NEEDS_REVIEW", "IN_PROGRESS", "IN_PROGRESS"], 1)], "source string, part_idx int, status string, needs_human_review boolean")
    on = "source string, part_idx int"
    outputs = spark.createDataFrame([("a", i) for i in (1, 3, 4, 5, 6)], on)
    sure = spark.createDataFrame([("a", i) for i in (2, 4, 5, 6)], on)
    levels = spark.createDataFrame([("a", 4, 1), ("a", 5, 2), ("a", 6, 0)], on + ", level int")
    got = {r.part_idx: (r.decision, r.needs_human_review) for r in A.settle(state, outputs, levels, sure).collect()}
    assert got == {1: ("not open", None), 2: ("no output", None), 3: ("not confirmed", None), 4: ("done", True), 5: ("fails its checks", None), 6: ("done", False)}
    events = spark.createDataFrame([("a", i, "SETTLE", 1) for i in range(1, 7)] + [("a", 1, "CLAIM", 2)], on + ", action string, seq int")
    assert sorted((r.part_idx, r.action) for r in A.guarded(events, A.settle(state, outputs, levels, sure)).collect()) == [(1, "CLAIM"), (4, "SETTLE"), (6, "SETTLE")]


def test_write_back_keeps_what_was_not_checked(spark):
    texts, plan, slices, units = project(spark)
    lines = lines_of(units)
    levels = qa.part_checks(units, lines, qa.zip_pairs(units, lines, qa.counts(units, lines))).where("source = 'a'")
    state = slices.select("source", "part_idx", F.lit("DONE").alias("status"), F.lit(True).alias("needs_human_review"))
    rows = A.write_back(state, levels).collect()
    assert all((r.verify, r.needs_human_review, r.checks["V10.A"], r.text_units.delta) == ("PASS", False, "PASS", 0) for r in rows if r.source == "a")
    assert all((r.verify, r.needs_human_review, r.checks) == (None, True, None) for r in rows if r.source == "b")


def test_status_and_hanging_parts(spark):
    rows = spark.createDataFrame([("a", 1, "DONE", True), ("a", 2, "IN_PROGRESS", False), ("a", 3, "IN_PROGRESS", False), ("a", 4, "IN_PROGRESS", False), ("a", 5, "FAILED", True), ("a", 6, "NEEDS_REVIEW", False)], "source string, part_idx int, status string, needs_human_review boolean")
    got = A.status_report(rows).first()
    assert (got.n_parts, got.in_review, got.current) == (6, 1, "part_002")
    assert (got.hanging, got.failed_parts, got.review_parts) == (["part_002", "part_003", "part_004"], ["part_005"], ["part_001", "part_005"])
    place = lambda *i: spark.createDataFrame([("a", x) for x in i], "source string, part_idx int")
    assert {r.part_idx: r.found for r in A.hanging(rows, place(1, 2), place(2, 3)).collect()} == {2: "output", 3: "draft", 4: "nothing"}
    assert [r.part_idx for r in A.discard(place(2, 3), place(3)).collect()] == [2] and A.unknown(place(2), place(9)).count() == 1
    assert "NEEDS_REVIEW" in S.STATUSES


def test_stored_bands_overlay_the_defaults_value_by_value(spark):
    pairs = spark.createDataFrame([(k, 1, 1, 1, "x" * 10, "y" * 20) for k in "abc"], "source string, part_idx int, si int, oi int, s string, t string")
    stored = spark.createDataFrame([("a", 2.1, None), ("b", None, 1.9)], "source string, unit_warn_high double, unit_fail_high double")
    rows, bands = qa.with_bands(pairs, stored)
    assert {r.source: r.ratio_level for r in qa.pair_checks(rows, bands).collect()} == {"a": 0, "b": 2, "c": 1}
    assert {r.ratio_level for r in qa.pair_checks(pairs, RatioBands()).collect()} == {1}


def test_punctuation_pass_rewrites_only_parts_that_fit(spark):
    units = spark.createDataFrame([("a", 1, 1, "「はい」"), ("a", 1, 2, "普通"), ("a", 2, 1, "「x」")], "source string, part_idx int, index int, text string")
    outputs = spark.createDataFrame([("a", 1, "\n「是」\n\n普通「行」\n"), ("a", 2, "「一」\n「二」")], "source string, part_idx int, text string")
    got = {r.part_idx: r for r in punct.punctuate(units, outputs, "ja", "zh-hans").collect()}
    assert (got[1].text, got[1].fits, got[1].changed, got[1].tags) == ("\n“是”\n\n普通“行”\n", True, 2, ["kakko", "kakko"])
    assert got[1].sha256 == hashlib.sha256(got[1].text.encode()).hexdigest()
    assert (got[2].text, got[2].fits, got[2].changed) == ("「一」\n「二」", False, 0)
    assert all(r.changed == 0 for r in punct.punctuate(units, outputs, "fr", "de").collect()) and not punct.registered("fr", "de")


def test_punctuation_pass_of_odd_parts(spark):
    units = spark.createDataFrame([("a", 1, 1, "「x」"), ("a", 3, 2, "「z」"), ("a", 3, 1, "y"), ("a", 5, 1, "u")], "source string, part_idx int, index int, text string")
    outputs = spark.createDataFrame([("a", 1, " \n\u3000\n"), ("a", 2, "「v」"), ("a", 3, "「y」\n \n「z」\n"), ("a", 4, ""), ("a", 5, None), ("a", 6, "\n「w」\x1c\n\x1c")], "source string, part_idx int, text string")
    got = {r.part_idx: (r.text, r.fits, r.changed, r.tags) for r in punct.punctuate(units, outputs, "ja", "zh-hans").collect()}
    assert got == {
        1: (" \n\u3000\n", True, 0, []), 2: ("「v」", False, 0, []), 3: ("“y”\n \n“z”\n", True, 2, ["kakko", "kakko"]), 4: ("", True, 0, []), 6: ("\n「w」\x1c\n\x1c", False, 0, []),
    }


def test_staged_outputs_carry_the_hash_of_what_was_stored(spark, tmp_path):
    out = spark.createDataFrame([("a", 1, "text é"), ("a", 2, "")], "source string, part_idx int, text string")
    got = {r.part_idx: (r.output_sha256, r.output_char_count) for r in writers.stage_outputs(out, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {1: (hashlib.sha256("text é".encode()).hexdigest(), 6), 2: (hashlib.sha256(b"").hexdigest(), 0)}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.stage_outputs(out, str(tmp_path / "in"), str(tmp_path / "out"))


def test_where_the_source_is_and_what_never_overwrites_it(spark, tmp_path):
    (tmp_path / "book.txt").write_text("\ufeff\ufeffx")
    (tmp_path / "notes.md").write_text("x")
    where = readers.locate_source(spark, str(tmp_path))
    assert where.endswith("book.txt") and readers.read_texts(spark, where).first().text == "x"
    assert readers.locate_source(spark, str(tmp_path), " given ", "set") == "given" and readers.locate_source(spark, str(tmp_path), "", "set") == "set"
    (tmp_path / "other.txt").write_text("y")
    with pytest.raises(ValueError, match="2 text files"):
        readers.locate_source(spark, str(tmp_path))
    merged = spark.createDataFrame([("a", "x")], "source string, text string")
    for path in (str(tmp_path / "book.txt"), f"file://{tmp_path}//./", str(tmp_path)):
        with pytest.raises(ValueError, match="overwrite"):
            writers.write_text(merged, path, where)


def test_manifests_of_another_version_are_refused(spark, tmp_path):
    texts, plan, slices, units = project(spark)
    made = M.manifest(texts, slices, units, P.chapter_labels(units, plan))
    writers.write_manifest(made, str(tmp_path / "m"))
    assert readers.read_checked(spark, str(tmp_path / "m"), made.schema, M.SCHEMA_NAME, M.SCHEMA_VERSION).count() == 2
    assert M.signature_errors(readers.read_json(spark, str(tmp_path / "m"), made.schema, lines=True)).count() == 0
    other = made.withColumn("schema_version", F.lit("0.9"))
    assert M.signature_errors(other).count() == 2
    writers.write_manifest(other, str(tmp_path / "o"))
    with pytest.raises(ValueError, match="0.9"):
        readers.read_checked(spark, str(tmp_path / "o"), made.schema, M.SCHEMA_NAME, M.SCHEMA_VERSION)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_checked(spark, str(tmp_path / "none"), made.schema, M.SCHEMA_NAME, M.SCHEMA_VERSION)


def test_titles_by_a_model(spark):
    rows = spark.createDataFrame([("a", "題"), ("b", "x")], "source string, raw string")
    rows = rows.withColumn("system", R.title_prompt(F.lit("ja"), F.lit(None).cast("string"), F.lit("fr"), F.lit("French")))
    assert rows.first().system.endswith("without quotation marks or comment.") and "French" in rows.first().system and "{" not in rows.first().system

    def client(system, user, tokens):
        return ("A/B title\nmore", "stop") if user == "題" else ("  ", "stop")

    assert {tuple(r) for r in R.translate_titles(rows, client).collect()} == {("a", "A_B title", "A_B title.txt"), ("b", None, "b_translated.txt")}


def test_reports_and_small_expressions(spark):
    issues = spark.createDataFrame([("a", "part_001", 1, "V7", "x" * 300), ("a", None, 2, "V1", "bad"), ("b", None, 1, "V1", "eh")], "source string, part_id string, level int, code string, msg string")
    got = [r.value for r in writers.report_text(issues).collect()]
    assert got[0] == "[FAIL] V1 bad" and got[1].startswith("[WARN] V7 part_001 xxx") and len(got[1]) < 230 and got[2] == "[WARN] V1 eh"
    row = spark.range(1).select(
        T.clipped(F.lit("abcdef"), 3).alias("c"), R.percent(F.lit(0.125)).alias("p"), lang.lang_pair(F.lit("ja_JP"), F.lit("zh-MO")).alias("l"),
        writers.archive_name(F.lit("p.txt"), F.to_timestamp(F.lit("2024-01-02 03:04:05"))).alias("a"), R.claim_token().alias("t"), R.claim_token().alias("u"),
    ).first()
    assert (row.c, row.p, tuple(row.l), row.a) == ("abc", "12.5%", ("ja", "zh-hant"), "p.txt.20240102-030405") and row.t != row.u
    run = Run.from_env({"QUIRE_SOURCE_LANG": " ja ", "QUIRE_TARGET_MAX": "90", "QUIRE_MIN_PART": "x", "QUIRE_CONTEXT_GLOSSARY": "7"})
    assert (run.source_lang, run.parts.target_max, run.parts.min_part, run.context.glossary) == ("ja", 90, 2000, 7)
    assert I.LEVELS == ("PASS", "WARN", "FAIL")


def test_first_marked_line_of_each_pattern(spark):
    out = spark.createDataFrame([("a", 1, 1, "fine"), ("a", 1, 2, "```" + "x" * 60), ("a", 1, 3, "```"), ("a", 1, 4, "# head")], "source string, part_idx int, oi int, line string")
    got = {(r["name"], r.n, r.sample) for r in qa.marked_lines(out).collect()}
    assert got == {("fence", 2, ("```" + "x" * 60)[:40]), ("heading mark", 1, "# head")}
