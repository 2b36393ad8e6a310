import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.config import PartLimits
from quire.functions import text as T
from quire.operators import units as U
from quire.plans import parts as P

TEXTS = {
    "runs": "A\n\nB\n\n\n\nC\n\n\n\n\n\nD\n",
    "leading": "\n\nA\n　\nB",
    "crlf": "x\r\n\r\ny\n",
    "empty": "",
    "blank": "\n\n",
    "one": "only",
    "astral": "a𠮷b\nc",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "source string, text string")


def brute_units(text):
    out, run, at = [], 0, 0
    for line in text.split("\n"):
        if line and line.strip():
            out.append((at, at + len(line), run if out else 0))
        run = 1 if line else run + 1
        at += len(line) + 1
    return out


def test_units_match_brute_force(spark):
    got = {}
    for r in U.units(frame(spark, TEXTS)).orderBy("source", "ln").collect():
        t = TEXTS[r.source]
        assert t[r.start_char : r.end_char] == r.text
        assert r.sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert r.blank_before == max(r.sep_newlines - 1, 0)
        got.setdefault(r.source, []).append((r.start_char, r.end_char, r.sep_newlines))
    for k, t in TEXTS.items():
        assert got.get(k, []) == brute_units(t), k


def test_units_of_long_random_texts(spark):
    """More lines than a block of offsets holds, blank ones, white space and characters beyond the basic plane."""
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice("ab 　é𠮷\t") for _ in range(rng.randrange(0, 6)))
    texts = {f"t{i}": "\n".join(rng.choice(["", "", piece(), piece()]) for _ in range(rng.choice((1, 63, 64, 65, 128, 400)))) for i in range(25)}
    got = {}
    for r in U.units(frame(spark, texts)).orderBy("source", "idx").collect():
        assert texts[r.source][r.start_char : r.end_char] == r.text == texts[r.source].split("\n")[r.ln]
        got.setdefault(r.source, []).append((r.start_char, r.end_char, r.sep_newlines))
    assert got == {k: brute_units(t) for k, t in texts.items() if brute_units(t)}


def test_segmentation_needs_no_exchange(spark):
    rows = U.units(frame(spark, TEXTS).select("source", "text"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_source_profile(spark):
    rows = {r.source: r for r in U.source_profile(frame(spark, TEXTS | {"bom": "﻿x", "mixed": "a\r\nb\nc"})).collect()}
    assert [rows[k].line_ending for k in ("runs", "crlf", "one", "mixed")] == ["LF", "MIXED", "NONE", "MIXED"]
    assert rows["bom"].has_bom and not rows["runs"].has_bom
    assert rows["astral"].char_count == 5 and rows["astral"].byte_count == 8


def test_strip_is_pythons(spark):
    odd = [" a ", "　b\t", "\x1cc\x85", "  d ", "", "\n"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", T.strip(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [x.strip() for x in odd]


def test_headings(spark):
    six = "\n" * 7
    text = six.join(["start", "第一部", "A title", "Not one。", "　indented", "＊＊＊", "x" * 41]) + "\n\nnear"
    got = U.units(frame(spark, {"t": text})).where(U.is_heading(F.col("text"), F.col("blank_before"))).orderBy("ln").collect()
    assert [r.text for r in got] == ["第一部", "A title"]


SMALL = PartLimits(target_min=20, target_max=60, hard_max=80, min_part=10)
texts = st.lists(st.text(alphabet="ab。」 　\n𠮷", max_size=40), max_size=30).map("\n".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_parts_tile_and_stay_bounded(text):
    for limits in (SMALL, PartLimits(20, 60, 80, 10, strict_units=True)):
        for merge in (False, True):
            parts = P.greedy(text, limits)
            parts = P.absorb_small(parts, limits) if merge else parts
            assert "".join(text[a:b] for a, b, *_ in parts) == text
            at = 0
            for a, b, forced, level in parts:
                assert a == at and b > a and b - a <= limits.hard_max
                assert not forced or level == "FORCED"
                at = b


def test_strongest_boundary_wins():
    text = "a" * 30 + "\n" * 6 + "b" * 10 + "\n\n" + "c" * 10 + "\n" + "d" * 60
    assert [(p[1], p[3]) for p in P.greedy(text, SMALL)][0] == (36, "STRONG")
    long = "x" * 50_000
    assert [(b - a, f, lv) for a, b, f, lv in P.greedy(long, PartLimits())] == [(20000, True, "FORCED"), (20000, True, "FORCED"), (10000, False, "LINE")]


def test_sentence_cut_skips_marks():
    text = "x" * 50 + "。\n「" + "y" * 100
    assert P.greedy(text, SMALL)[0][:2] == (0, 53)


def test_small_inner_part_joins_both():
    parts = [(0, 25, False, "A"), (25, 30, False, "B"), (30, 55, False, "C"), (55, 90, False, "D")]
    assert P.absorb_small(parts, SMALL) == [(0, 55, False, "C"), (55, 90, False, "D")]


@pytest.fixture(scope="module")
def planned(spark):
    rng = random.Random(4)
    body = {f"b{i}": "".join(rng.choice(["line %d" % k, "第一部", "A title", "long " * 9]) + "\n" * rng.choice([1, 2, 4, 6, 7]) for k in range(60)) for i in range(4)}
    t = frame(spark, body)
    plan = P.plan_greedy(t, limits=PartLimits(100, 300, 400, 50))
    return body, t, plan


def test_part_units_have_their_part(spark, planned):
    body, t, plan = planned
    cuts = {(r.source, r.part_idx): (r.start_char, r.end_char) for r in plan.collect()}
    rows = P.part_units(U.units(t), plan).collect()
    assert len(rows) == sum(len(brute_units(x)) for x in body.values())
    for r in rows:
        a, b = cuts[r.source, r.part_idx]
        assert a <= r.abs_start_char < b and r.rel_start == r.abs_start_char - a
        assert r.paragraph_id == f"part_{r.part_idx:03d}:p{r['index']:03d}"


def test_labels_follow_a_sequential_pass(spark, planned):
    body, t, plan = planned
    got = {(r.source, r.part_idx): r for r in P.chapter_labels(P.part_units(U.units(t), plan), plan).collect()}
    cuts = sorted((r.source, r.part_idx, r.start_char, r.end_char) for r in plan.collect())
    volume, carry, was = "", "", None
    for source, idx, a, b in cuts:
        if source != was:
            volume, carry, was = "", "", source
        titles, mine = [], ""
        for s, e, sep in brute_units(body[source]):
            if a <= s < b:
                line = body[source][s:e].strip()
                if line == "第一部":
                    volume = line
                mine = mine or volume
                if sep - 1 >= 5 and line != "第一部" and len(line) <= 40:
                    titles.append(line)
        r = got[source, idx]
        assert r.n_headings == len(titles) and r.first_heading == (titles[0] if titles else "")
        if titles:
            label = " + ".join(titles[:3]) + (" …" if len(titles) > 3 else "")
        else:
            label = f"承前（{carry}）" if carry else ""
        assert r.chapter_label == " / ".join(x for x in (mine, label) if x)
        carry = titles[0] if titles else carry
