"""Texts in pieces against the same texts in one row each."""

import json
import random

from pyspark.sql import functions as F

from quire import fixtures as fx
from quire import queries as Q
from quire.config import PartLimits
from quire.functions import text as T
from quire.operators import integrity as I
from quire.operators import manifest as M
from quire.operators import merge as G
from quire.operators import pieces as X
from quire.operators import units as U
from quire.plans import parts as P

LIMITS = PartLimits(20, 60, 80, 15)
ALPHABET = ["\n", "\n", "\n\n\n", "\n\n\n\n\n\n", "a", "b。", "c d", " ", "　", "『é", "\r\n", "x𠮷z "]


def both_forms(spark, n=40, seed=4):
    rng = random.Random(seed)
    whole, cut = [("empty", ""), ("bom", "﻿﻿﻿x\n")], [("empty", 0, ""), ("bom", 1, "﻿"), ("bom", 2, "﻿"), ("bom", 3, "﻿x\n")]
    for i in range(n):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 300)))
        at = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
        whole.append((f"t{i}", text))
        cut += [(f"t{i}", j, text[a:b]) for j, (a, b) in enumerate(zip([0, *at], [*at, len(text)]))]
    rng.shuffle(cut)
    return spark.createDataFrame(whole, "source string, text string").repartition(3), spark.createDataFrame(cut, "source string, seq int, text string").repartition(3)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df.select(cols).collect()))
    assert rows(a) == rows(b)


def test_pieces_give_what_whole_texts_give(spark):
    whole, cut = both_forms(spark)
    plan = P.plan_greedy(whole, limits=LIMITS)
    slices = P.part_slices(whole, plan)
    same(U.units(whole), U.units(cut))
    same(U.source_profile(whole), U.source_profile(cut))
    for limits in (LIMITS, PartLimits(20, 60, 80, 15, strict_units=True), PartLimits(5, 9, 12, 3)):
        same(P.plan_greedy(whole, limits=limits), P.plan_greedy(cut, limits=limits))
        same(P.plan_parts(whole, limits=limits), P.plan_parts(cut, limits=limits))
    same(slices, P.plan_slices(cut, limits=LIMITS))
    for some in (slices, slices.where("part_idx <> 2")):
        same(I.rebuild_check(some, whole), I.rebuild_check(some, cut))
        same(I.part_totals(some, whole), I.part_totals(some, cut))
    moved = plan.withColumn("start_char", F.col("start_char") + (F.col("part_idx") % 3 == 0).cast("int"))
    same(I.v4_continuity(moved, whole), I.v4_continuity(moved, cut))


def test_merged_pieces_give_the_merged_text(spark):
    whole, cut = both_forms(spark)
    own = P.part_units(U.units(whole), P.plan_greedy(whole, limits=LIMITS)).select("source", "part_idx", F.col("index").alias("si"), "sep_newlines", F.col("text").alias("line"))
    tails = U.source_profile(whole).select("source", "tail_newlines")
    one, many = G.merge_text(own, tails), G.merge_pieces(own, tails)
    same(one.select("source", T.sha256(F.col("text")).alias("s")), U.source_profile(many).select("source", F.col("sha256").alias("s")))
    same(G.merge_stats(one, whole), G.merge_stats(many, cut))
    odd = many.where("source <> 't1'").withColumn("text", F.when(F.col("source") == "t2", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    got = {r.source: r.result for r in G.check_merged(one, odd).collect()}
    assert got.pop("t1") == "MISSING" and got.pop("t2") == "DIFFERENT" and set(got.values()) == {"IDENTICAL"}


def test_documents_are_the_signed_manifest(spark):
    whole, cut = both_forms(spark)
    plan = P.plan_greedy(whole, limits=LIMITS)
    slices, rows = P.part_slices(whole, plan), P.part_units(U.units(whole), plan)
    rows = rows.where("part_idx <> 2")  # a part without units has no paragraphs
    made = M.manifest(whole, slices, rows, P.chapter_labels(rows, plan))
    docs = M.documents(cut, slices, rows, P.chapter_labels(rows, plan))
    same(made.select("source", *M.TOTALS, "manifest_sha256", F.to_json("parts").alias("parts")), docs)
    assert all(len(json.loads(r.parts)) == r.part_count for r in docs.collect())


def folds(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_units_are_placed_while_they_are_read(spark):
    _, cut = both_forms(spark, 12)
    cut = cut.unionByName(spark.createDataFrame([(None, 0, "a\n\n\nb\nc"), (None, 1, "d。\n")], cut.schema))
    for limits in (LIMITS, PartLimits(5, 9, 12, 3)):
        plan, made = P.plan_greedy(cut, limits=limits), P.plan_units(cut, limits=limits)
        same(P.part_units(U.units(cut), plan), made.drop("before"))
        assert folds(made) == 1 and "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    last = {}
    for r in sorted(P.plan_units(cut, limits=LIMITS).collect(), key=lambda r: (str(r.source), r.ln)):
        assert r.before == (last.get(r.source) if r["index"] == 1 else None)
        last[r.source] = r.text


def test_a_translation_by_part_is_that_of_the_whole_text(spark, tmp_path):
    rows = [(i, "\n".join(f"line {i} {j} of a text" for j in range(40)), f"src{i % 3}", "en") for i in range(90)]
    rows = [(i, t + "\n" + "word. " * 900, s, x) for i, t, s, x in rows]  # several parts a book
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    case = Q.Case(spark, str(tmp_path))
    old = case.part_units.select("source", "part_idx", "ln").join(fx.translation(case.units), ["source", "ln"]).where("out_line is not null")
    of = lambda df, line: sorted((r.source, r.part_idx, r[line]) for r in df.collect())
    assert of(case.lines, "line") == of(old, "out_line")
    assert case.plan.count() > 30 and folds(case.lines) == 1


def test_a_check_makes_its_rows_once(spark):
    _, cut = both_forms(spark, 6)
    slices, plan = P.plan_slices(cut, limits=LIMITS), P.plan_greedy(cut, limits=LIMITS)
    recorded = U.source_profile(cut)
    assert folds(I.v1_source(cut, recorded)) == 2 and folds(I.v3_parts(slices, slices)) == 2 and folds(I.v4_continuity(plan, cut)) == 1
    assert folds(I.v8_units(P.plan_units(cut, limits=LIMITS), slices)) == 2
    odd = slices.where("part_idx <> 2").withColumn("sha256", F.when(F.col("part_idx") == 3, "0").otherwise(F.col("sha256"))).withColumn("byte_count", F.when(F.col("part_idx") == 3, 0).otherwise(F.col("byte_count")))
    got = {(r.source, r.part_id, r.msg) for r in I.v3_parts(slices, odd).collect()}
    parts = [(r.source, r.part_idx) for r in slices.collect()]
    want = {(s, "part_002", "part is missing") for s, p in parts if p == 2} | {(s, "part_003", f"{c} differs") for s, p in parts if p == 3 for c in ("sha256", "byte_count")}
    assert want and got == want


def test_a_planner_holds_a_piece_and_a_reach():
    made, longest, parts = P.Planner(PartLimits()), 0, 0
    for i in range(3000):
        parts += len(list(made.feed("\n\n" + "word and word. " * 60)))
        longest = max(longest, len(made.buf), len(made.every))
    assert parts > 150 and longest < 25_000


def test_queries_never_make_a_row_of_a_book(spark, tmp_path):
    """Books as the queries read them stay in rows of their documents, however many a source has."""
    rows = [(i, f"text {i}\n\nmore", "src1", "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    case = Q.Case(spark, str(tmp_path))
    assert case.books.count() == 200 and case.books.agg(F.max(F.length("text"))).first()[0] < 30
    same(U.source_profile(case.books), U.source_profile(fx.book(spark, str(tmp_path))))
    same(case.slices, P.part_slices(fx.book(spark, str(tmp_path)), case.plan))
