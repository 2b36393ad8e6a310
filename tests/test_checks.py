import random

from pyspark.sql import functions as F

from quire.config import PartLimits
from quire.operators import integrity as I
from quire.operators import manifest as M
from quire.operators import merge as G
from quire.operators import qa
from quire.operators import units as U
from quire.plans import parts as P


def made(spark):
    t = spark.createDataFrame([("a", "one\n\ntwo\n" * 40), ("b", "x\ny\n\n\n\n\n\nz\n\n")], "source string, text string")
    plan = P.plan_greedy(t, limits=PartLimits(20, 60, 80, 10))
    return t, plan, P.part_slices(t, plan), P.part_units(U.units(t), plan)


def codes(df):
    return sorted((r.source, r.part_id, r.code) for r in df.collect())


def test_clean_input_has_no_issue(spark):
    t, plan, slices, pu = made(spark)
    assert codes(I.v1_source(t, U.source_profile(t))) == []
    assert codes(I.v3_parts(slices.select("source", "part_id", "sha256", "byte_count", "char_count"), slices)) == []
    assert codes(I.v4_continuity(plan, t)) == []
    assert codes(I.v8_units(pu, slices)) == []
    assert all(r.ok for r in I.part_totals(slices, t).collect())
    assert all(r.ok for r in I.rebuild_check(slices, t).collect())


def test_each_defect_is_found(spark):
    t, plan, slices, pu = made(spark)
    changed = slices.withColumn("text", F.when((F.col("source") == "b") & (F.col("part_idx") == 1), F.lit("?")).otherwise(F.col("text")))
    assert [r.source for r in I.rebuild_check(changed, t).where("not ok").collect()] == ["b"]
    gone = slices.where("not (source = 'a' and part_idx = 2)")
    assert ("a", "part_002", "V3") in codes(I.v3_parts(slices.select("source", "part_id", "sha256", "byte_count", "char_count"), gone))
    moved = plan.withColumn("end_char", F.when(F.col("part_idx") == 1, F.col("end_char") - 1).otherwise(F.col("end_char")))
    assert any(c == "V4" for *_, c in codes(I.v4_continuity(moved, t)))
    wrong = pu.withColumn("sha256", F.when(F.col("index") == 1, F.lit("0")).otherwise(F.col("sha256")))
    assert len(codes(I.v8_units(wrong, slices))) == plan.count()
    big = slices.withColumn("char_count", F.lit(20001))
    assert {r.level for r in I.v7_sizes(big).collect()} == {2}
    v = I.verdicts(I.union([I.v7_sizes(big), I.v4_continuity(moved, t)])).collect()
    assert {r.verdict for r in v} == {"FAIL"}


def test_manifest_is_signed(spark):
    t, plan, slices, pu = made(spark)
    m = M.manifest(t, slices, pu, P.chapter_labels(pu, plan))
    assert M.signature_errors(m).count() == 0
    assert [r.source for r in M.signature_errors(m.withColumn("part_count", F.when(F.col("source") == "a", 99).otherwise(F.col("part_count")))).collect()] == ["a"]
    r = m.where("source = 'b'").first()
    assert len(r.parts) == r.part_count and r.parts[0].paragraphs[0].paragraph_id == "part_001:p001"


def lines(spark, rows):
    src = spark.createDataFrame([("a", p, i, s) for p, i, s, _ in rows if s is not None], "source string, part_idx int, index int, text string")
    out = spark.createDataFrame([("a", p, i, t) for p, i, _, t in rows if t is not None], "source string, part_idx int, oi int, line string")
    return src, out


def checks(spark, rows, lang=""):
    src, out = lines(spark, rows)
    sizes = qa.counts(src, out)
    pairs = qa.zip_pairs(src, out, sizes).unionByName(qa.misaligned_pairs(src, out, sizes))
    return {r.part_idx: r for r in qa.part_checks(src, out, pairs, lang=lang).collect()}


def test_part_checks_by_code(spark):
    words = [f"sentence number {k} of the text here" for k in range(21)]
    same = [(1, i + 1, w, w) for i, w in enumerate(words)]
    off10 = [(2, i + 1, w, w if i > 1 else None) for i, w in enumerate(words[:20])]
    off15 = [(3, i + 1, w, w if i > 2 else None) for i, w in enumerate(words[:20])]
    short = [(4, 1, "a line of fifteen", "ab")]
    low = [(5, 1, "x" * 100, "y" * 31)]
    dup = [(6, 1, "first line, long", "same line here"), (6, 2, "second line, long", "same line here")]
    fence = [(7, 1, "abc", "```"), (7, 2, "def", "def")]
    none = [(8, 1, "abc", None)]
    jp = [(9, 1, "漢字漢字漢字", "かなかな漢字")]
    got = checks(spark, same + off10 + off15 + short + low + dup + fence + none + jp, "ja")
    assert got[1].level == 0
    assert got[2].v10a == 1 and got[2].v10c == 2
    assert got[3].v10a == 2
    assert got[4].v10c == 2
    assert got[5].v10d == 1 and got[5].v10c == 0
    assert got[6].v10e == 2
    assert got[7].v11 == 2
    assert got[8].v9 == 2 and got[8].v10a is None and got[8].level == 2
    assert got[9].v11 == 2


def test_ratio_bounds_are_strict(spark):
    pairs = spark.createDataFrame([(i, "s" * 20, "t" * n) for i, n in enumerate((6, 5, 9, 8, 36, 37, 50, 51))] + [(9, "s" * 7, "t")], "i int, s string, t string")
    got = [r.ratio_level for r in qa.pair_checks(pairs).orderBy("i").collect()]
    assert got == [1, 2, 0, 1, 0, 1, 1, 2, 0]


def test_calibration_needs_samples_and_only_widens(spark):
    rows = [("few", "s" * 10, "t" * 10)] * 29 + [("many", "s" * 100, "t" * k) for k in range(10, 310, 5)]
    got = {r.source: r for r in qa.calibrated(spark.createDataFrame(rows, "source string, s string, t string")).collect()}
    assert (got["few"].warn_low, got["few"].warn_high) == (0.45, 1.8)
    ratios = sorted(k / 100 for k in range(10, 310, 5))
    pick = lambda q: ratios[int(round((len(ratios) - 1) * q))]
    assert got["many"].warn_low == round(min(pick(0.01), 0.45), 3) and got["many"].fail_high == round(max(pick(0.99) * 1.3, 2.5), 3)


def test_alignment_pairs():
    assert qa.align_sequences(["a", "b", "c"], ["a", "c"]) == [(1, 1), (2, None), (3, 2)]
    assert qa.align_sequences(["a"], ["x", "y"]) == [(1, 1), (None, 2)]


def test_merge_restores_the_text_and_reports(spark):
    t, plan, slices, pu = made(spark)
    own = pu.select("source", "part_idx", F.col("index").alias("si"), "sep_newlines", F.col("text").alias("line"))
    tails = U.source_profile(t).select("source", "tail_newlines")
    merged = G.merge_text(own, tails)
    assert {r.result for r in G.check_merged(t, merged).collect()} == {"IDENTICAL"}
    out = pu.select("source", "part_idx", F.col("index").alias("oi"), F.col("text").alias("line"))
    state = plan.select("source", "part_idx", F.lit("DONE").alias("status"), F.lit(False).alias("needs_human_review"))
    assert G.precheck(plan, state, out, pu).count() == 0
    assert {r.reason for r in G.precheck(plan, state.where("part_idx > 1"), out.where("source = 'a'"), pu).collect()} == {"not done", "no output"}


def naive_alignment(a, b):
    """Longest common block (the earliest in a, then in b), then the same to its left and right; what is between pairs up."""

    def blocks(i, j, k, m):
        best = (0, i, k)
        for x in range(i, j):
            for y in range(k, m):
                n = 0
                while x + n < j and y + n < m and a[x + n] == b[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        n, x, y = best
        return [*blocks(i, x, k, y), (x, y, n), *blocks(x + n, j, y + n, m)] if n else []

    out, i, k = [], 0, 0
    for x, y, n in [*blocks(0, len(a), 0, len(b)), (len(a), len(b), 0)]:
        both = min(x - i, y - k)
        out += [(i + z + 1, k + z + 1) for z in range(both)]
        out += [(z + 1, None) for z in range(i + both, x)] + [(None, z + 1) for z in range(k + both, y)]
        out += [(x + z + 1, y + z + 1) for z in range(n)]
        i, k = x + n, y + n
    return out


def test_alignment_equals_a_naive_one(spark):
    rng = random.Random(6)
    src, out, want = [], [], {}
    for part in range(1, 31):
        a = [rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))]
        b = [x for x in a if rng.random() < 0.7] + [rng.choice("abxy") for _ in range(rng.randrange(0, 4))]
        rng.random() < 0.3 and rng.shuffle(b)
        assert qa.align_sequences(a, b) == naive_alignment(a, b)
        src += [("k", part, i + 1, x) for i, x in enumerate(a)]
        out += [("k", part, i + 1, x) for i, x in enumerate(b)]
        if len(a) != len(b):
            want[part] = [(i, j, a[i - 1] if i else None, b[j - 1] if j else None) for i, j in naive_alignment(a, b)]
    units = spark.createDataFrame(src, "source string, part_idx int, index int, text string")
    lines = spark.createDataFrame(out, "source string, part_idx int, oi int, line string")
    rows = qa.misaligned_pairs(units, lines, qa.counts(units, lines)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.part_idx, []).append((r.si, r.oi, r.s, r.t))
    key = lambda rows: sorted(rows, key=str)
    assert {p: key(x) for p, x in got.items()} == {p: key(x) for p, x in want.items()}


def brute_checks(src, out, pairs):
    """The levels of one part, rule by rule."""
    import re

    if not out:
        return {"v9": 2}
    got = {"v9": 0, "v10a": 0 if len(src) == len(out) else 2 if abs(len(out) - len(src)) / max(len(src), 1) > 0.1 else 1}
    seq = [j for i, j in pairs if i and j]
    got["v10b"] = 2 * any(y < x for x, y in zip(seq, seq[1:]))
    short, level, special = False, 0, False
    for i, j in pairs:
        if not i:
            continue
        s = src[i - 1]
        if not j:
            short = True
            special |= len(s) <= 3 or re.fullmatch(r"[\s\W_]+", s) is not None
            continue
        t = out[j - 1]
        short |= len(s) >= 15 and (len(t) <= 2 or len(t) < max(2, int(len(s) * 0.15)))
        if len(s) >= 8:
            r = len(t) / len(s)
            level = max(level, 2 if r < 0.3 or r > 2.5 else 1 if r < 0.45 or r > 1.8 else 0)
    joined, n = "".join(out), 0
    blocks = [joined[x : x + 30] for x in range(0, max(len(joined) - 30, 0), 30)]
    n = len(blocks) - len(set(blocks))
    twice = any(x == y and len(x) > 8 for x, y in zip(out, out[1:]))
    ratio = sum(map(len, out)) / sum(map(len, src)) if src else 0.0
    return got | {"v10c": 2 * short, "v10d": level, "v10e": 2 * (twice or n / max(len(blocks), 1) > 0.15), "v11": 2 * any(x.startswith("```") for x in out), "v12": 2 * special, "part_ratio_level": int(ratio < 0.6 or ratio > 2.5)}


def test_all_part_checks_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 45))).strip() or "x"
    src, out, want = [], [], {}
    for part in range(1, 61):
        a = [rng.choice([word(), word(), "***", "—"]) for _ in range(rng.randrange(1, 14))]
        b = []
        for x in a:
            b += rng.choice([[x], [x], [x], [x], [x, x], [], [x[: max(1, len(x) // 4)]], ["```"], [x * 3], [word()]])
        if rng.random() < 0.3:
            rng.shuffle(b)
        if rng.random() < 0.1:
            b = []
        pairs = [(i + 1, i + 1) for i in range(len(a))] if len(a) == len(b) else naive_alignment(a, b)
        want[part] = brute_checks(a, b, pairs)
        src += [("k", part, i + 1, x) for i, x in enumerate(a)]
        out += [("k", part, i + 1, x) for i, x in enumerate(b)]
    units = spark.createDataFrame(src, "source string, part_idx int, index int, text string")
    lines = spark.createDataFrame(out, "source string, part_idx int, oi int, line string")
    sizes = qa.counts(units, lines)
    pairs = qa.zip_pairs(units, lines, sizes).unionByName(qa.misaligned_pairs(units, lines, sizes))
    rows = {r.part_idx: r.asDict() for r in qa.part_checks(units, lines, pairs).collect()}
    assert {p: {k: v for k, v in rows[p].items() if k in w and v is not None} for p, w in want.items()} == want
    assert len({tuple(w.values()) for w in want.values()}) > 15
