"""Mixing, decontamination, token counts and languages against brute force."""

import hashlib
import random
import re

import pytest
from helpers import awkward, none, rows_of
from pyspark.sql import functions as F

from quire.llm import decontam as D
from quire.llm import langid as L
from quire.llm import mixing as M
from quire.llm import tokencount as K

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum(text):
    return ALNUM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_decontam(docs, bench):
    windows = {}
    for item, t in bench:
        w = alnum(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, items = alnum(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i : i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    items |= found
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaked():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(n))
    bench = [(1, text(25)), (2, text(12)), (3, "Short Item"), (4, ""), (5, None), (6, text(10)), (None, text(11)), (7, "Zz zz")]
    docs = [(0, text(300)), (1, f"{text(30)} {bench[0][1]} {text(20)}"), (2, bench[1][1].upper().replace(" ", ", ")), (3, f"{bench[0][1]} {bench[0][1]}"), (4, "zz " * 30), (5, None), (6, "")]
    docs += [(7, " ".join(bench[0][1].split()[3:17])), (7, "a short item"), (8, bench[5][1] + " " + bench[6][1])]
    return docs, bench


@pytest.mark.parametrize("small", [False, True])
def test_decontamination_equals_brute_force(spark, monkeypatch, small):
    docs, bench = leaked()
    if small:  # documents in pieces and the benchmark in several blocks
        monkeypatch.setattr(D, "SHARD_WORDS", 13)
        monkeypatch.setattr(D, "TEST_WORDS", 30)
        docs = docs + docs[1:3] + [(None, docs[1][1]), (None, docs[1][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert rows_of(D.report(a, b)) == brute_decontam(docs, bench)


def test_longest_matches_have_their_places(spark):
    docs, bench = leaked()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    hits = {(r.doc_id, h.item, h.start, h.at): h.n for r in D.matches(a, b).collect() for h in r.hits}
    assert hits[1, "1", 0, 30] >= 25 and hits[3, "1", 0, 25] == 25
    for (d, item, start, at), n in hits.items():
        texts = [alnum(t) for i, t in docs if i == d]
        want = alnum(next(t for i, t in bench if ("" if i is None else str(i)) == item))[start : start + n]
        assert any(t[at : at + n] == want for t in texts)


def test_decontamination_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    docs = awkward(spark)
    assert {r.doc_id for r in D.report(docs, bench).where("contaminated").collect()} == {27, 28}
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert D.report(none(spark), bench).count() == 0
    assert D.report(docs, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_decontamination_decides_row_by_row(spark, monkeypatch, small):
    docs, bench = leaked()
    if small:  # documents in pieces and the benchmark in several blocks
        monkeypatch.setattr(D, "SHARD_WORDS", 13)
        monkeypatch.setattr(D, "TEST_WORDS", 30)
    # contaminated and clean rows without an id, a clean row that shares the id of an affected one, and repeated rows
    docs += [(None, docs[1][1]), (None, "clean"), (None, None), (1, "clean too"), (1, None), (0, docs[3][1]), docs[0], docs[1]]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = [d for d in docs if not brute_decontam([d], bench)[0][-1]]
    assert rows_of(D.decontaminate(a, b)) == sorted(want, key=str) and (None, "clean") in want and (1, "clean too") in want
    assert rows_of(D.decontaminate(a, b.limit(0))) == sorted(docs, key=str)


def test_large_benchmark_passes_over_the_documents_once(spark, monkeypatch, tmp_path):
    """Several blocks: one scan of the documents, and only texts with a window go on; each block sees just those."""
    monkeypatch.setattr(D, "TEST_WORDS", 30)
    monkeypatch.setattr(D, "SCREEN_BITS", 1 << 16)
    docs, bench = leaked()
    docs += [(1000 + i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    a, b = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(bench, "item_id long, text string")
    written, blocks, stash, by_block = [], [], D.c.stash, D._by_block
    monkeypatch.setattr(D.c, "stash", lambda df: written.append(df) or stash(df))
    monkeypatch.setattr(D, "_by_block", lambda rows, found, *more: by_block(rows, (blocks.append(rows) or t for t in found), *more))
    out = D.report(a, b)
    assert rows_of(out) == brute_decontam(docs, bench)
    assert len(written) == 1 and written[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert str(tmp_path) not in "".join(out.inputFiles()) and len(blocks) > 1
    assert all("quire-" in df.inputFiles()[0] for df in blocks) and blocks[0].count() < 40


def test_screen_misses_no_window_and_may_be_full():
    import numpy as np

    rng = np.random.default_rng(2)
    words = rng.integers(1, 50, 3000).astype(np.uint64)
    row = np.sort(rng.integers(0, 60, 3000))
    items = [words[a : a + n] for a, n in ((5, 10), (70, 3), (900, 14), (2000, 1))]
    for bits in (8, 1 << 20):
        screen = D.Screen(bits)
        for x in items:
            screen.add(x)
        may = screen.may_hold(words, row, 60)
        for x in items:
            size = min(len(x), D.WINDOW)
            for k in range(len(x) - size + 1):
                for at in range(len(words) - size + 1):
                    if row[at] == row[at + size - 1] and (words[at : at + size] == x[k : k + size]).all():
                        assert may[row[at]]
    assert not D.Screen(1 << 20).may_hold(words, row, 60).any()


def test_suffix_array_is_sorted():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        w = rng.integers(0, 3, n).astype(np.uint64)
        order, _ = D.suffix_array(w, 10**6)
        assert [tuple(w[i:]) for i in order] == sorted(tuple(w[i:]) for i in range(n))


def brute_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for d, t, s in docs:
        per[s] = per.get(s, 0) + size(t)
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in per if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(per.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        level = (budget - sum(capped.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * per[s]]
        if not over:
            return per, {s: capped.get(s, weight[s] * level) for s in names}, size
        capped |= {s: 2.0 * per[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    docs = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    per, goal, size = brute_mix(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = M.mix(df).collect()
    assert rows_of(M.mix(df)) == sorted((tuple(r) for r in rows), key=str)
    source = {d: s for d, _, s in docs}
    taken = {}
    for r in rows:
        assert r["size"] == size(docs[r.doc_id][1]) and r.source_size == per[source[r.doc_id]]
        assert abs(r.target - goal[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in per:
        assert abs(taken[s] - goal[s]) <= 30


def test_a_larger_budget_takes_a_superset(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), "s") for i in range(300)], "doc_id long, text string, source string")
    rows = M.sized(docs)
    upto = [M.thresholds(rows, M.targets(rows, budget=b)).first().upto for b in (0.2, 0.5, 0.8)]
    assert upto == sorted(upto)


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    out = M.mix(docs)
    assert out.count() == docs.count() and out.where("size = 0 and taken <> 0").count() == 0
    applied = M.apply_mix(docs)
    assert applied.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "rep", "size", "source_size", "target", "taken"]
    assert applied.agg(F.sum("taken")).first()[0] == out.agg(F.sum("taken")).first()[0]
    assert M.mix(none(spark)).count() == 0


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.tokenizer_path())
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_counts_equal_the_library_at_every_prefix():
    rng, count, model = random.Random(1), library(), K.bpe(K.tokenizer_path())
    parts = ["a", "b", "'s", "'", "'ll", " ", "  ", "   ", "\n", "\t", "é", "日本", "🙂", "1", "23", "...", "<|endoftext|>", "<|", "aaa", "ing", " the", "　", "x²", "é"]
    for _ in range(250):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        p = K.PrefixCounts(model, s)
        table = p.all().tolist()
        assert model.tokens(s) == count(s)
        for i in range(len(s) + 1):
            assert table[i] == p.count(i) == count(s[:i]), (s, i)


def test_truncation_is_the_longest_fit():
    count, model = library(), K.bpe(K.tokenizer_path())
    s = "The quick brown fox doesn't jump over 1234 lazy dogs, it's asleep.  \n\n Then"
    for budget in range(0, 25):
        cut = K.PrefixCounts(model, s).truncate(budget)
        assert count(cut) <= budget
        assert all(count(s[:i]) > budget for i in range(len(cut) + 1, len(s) + 1))


def test_token_counts_of_awkward_rows(spark):
    count, docs = library(), awkward(spark)
    want = sorted(((r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in docs.collect()), key=str)
    assert rows_of(K.token_counts(docs)) == want
    assert K.token_counts(none(spark)).count() == 0
    few = docs.where("length(text) < 500")
    assert {r.doc_id: r.counts[-1] for r in K.prefix_counts(few).collect() if r.doc_id} == {r.doc_id: count(r.text) for r in few.collect() if r.doc_id}
    assert K.truncated(few, 3).count() == few.count()


def brute_grams(text):
    out = {}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"_{w}_"
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                if p[i : i + n] != "_":
                    out[p[i : i + n]] = out.get(p[i : i + n], 0) + 1
    return out


def brute_profile(counts, most):
    """Names by falling count, ties to the smaller key; a name's key reads its characters from the right, a blank being 0."""
    key = lambda g: sum((0 if ch == "_" else ord(ch)) << (21 * i) for i, ch in enumerate(reversed(g)))
    merged = {}
    for g, n in counts.items():
        merged[g.lstrip("_")] = merged.get(g.lstrip("_"), 0) + n
    return sorted(merged, key=lambda g: (-merged[g], key(g)))[:most]


def test_predictions_equal_brute_force(spark, monkeypatch):
    """Profiles, ranks and out-of-place distances by dictionaries."""
    monkeypatch.setattr(L, "PROFILE", 40)
    rng = random.Random(4)
    alphabet = {"aa": "abcdeé", "bb": "abxyz", "cc": "mnopß", "dd": "ab"}
    say = lambda x: " ".join("".join(rng.choice(alphabet[x]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25)))
    train = [(i, x, say(x)) for i, x in enumerate(rng.choice(list(alphabet)) for _ in range(60))] + [(90, None, "zz zz"), (91, "aa", None)]
    asked = [(i, say(rng.choice(list(alphabet)))) for i in range(40)] + [(50, None), (51, ""), (52, "12 ..."), (53, "日本")]
    totals = {}
    for _, x, text in train:
        if x and text:
            for g, n in brute_grams(text).items():
                totals.setdefault(x, {})[g] = totals.setdefault(x, {}).get(g, 0) + n
    model = {x: {g: i for i, g in enumerate(brute_profile(c, 40))} for x, c in totals.items()}
    want = []
    for i, text in asked:
        mine = brute_profile(brute_grams(text or ""), 40)
        far = {x: sum(abs(r[g] - k) if g in r else 40 for k, g in enumerate(mine)) for x, r in model.items()}
        best = min(sorted(far), key=far.get)
        want.append((i, best, round(1 - far[best] / (40 * len(mine)), 9)) if mine else (i, "und", 0.0))
    profiles = L.learn(spark.createDataFrame(train, "doc_id long, lang string, text string"), 40)
    got = L.identify(spark.createDataFrame(asked, "doc_id long, text string"), profiles, 40).collect()
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == want


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGS", 2)
    docs = spark.createDataFrame([(i, f"l{i}", "abc def " * 60) for i in range(3)], "doc_id long, lang string, text string")
    with pytest.raises(ValueError, match="languages"):
        L.learn(docs, 2)


def test_gram_counts_equal_brute_force(monkeypatch):
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(L, "STRETCH", stretch)
        for text in ("", "a", "The cat, the hat; été!", "x1y zz\nzz", "日本 a"):
            keys, n = L.counted(text)
            name = lambda k: "".join(chr(c) if c else "_" for c in ((k >> 42) & 0x1FFFFF, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF))
            got = {}
            for k, v in zip(keys.tolist(), n.tolist()):
                # shorter n-grams have leading zero places; a blank in front of a letter is one too
                got[name(k).lstrip("_")] = got.get(name(k).lstrip("_"), 0) + v
            want = {}
            for g, v in brute_grams(text).items():
                want[g.lstrip("_")] = want.get(g.lstrip("_"), 0) + v
            assert got == want, text


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    sound = {"aa": "the and of to in is that for with as".split(), "bb": "der die und das ist nicht ein mit auf sich".split()}
    docs = [(i, " ".join(rng.choice(sound[k]) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = L.learn(df.where("doc_id < 40"))
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in docs)


def test_languages_of_awkward_rows(spark):
    docs = awkward(spark)
    model = L.learn(docs)
    assert set(model) == {"en", "fr", "ja"} and max(map(len, model.values())) <= L.PROFILE
    got = rows_of(L.identify(docs, model))
    assert len(got) == docs.count() and all(r[1] == "und" for r in got if r[0] in (22, 23, 24))
    assert L.learn(none(spark)) == {}
    assert {r.lang_pred for r in L.identify(docs, {}).collect()} == {"und"}
