"""Checks from one row a part against those from joins, and how often a query reads the books."""

import os
import random

import pytest

from quire import queries as Q
from quire.operators import qa

DATA = "/root/testdata/sf0.001"


def parts_of(spark, n=60, seed=7):
    rng = random.Random(seed)
    words = ["a", "＊", "one line of text", "one line of text", "第 3 部分", "another, longer line of the text here", "```", "　x "]
    src, out = [], []
    for p in range(1, n + 1):
        s = [rng.choice(words) + rng.choice(["", " more", "!"]) for _ in range(rng.randrange(1, 12))]
        t = [x.strip() if rng.random() < 0.8 else rng.choice(words) for x in s if p % 2 or rng.random() < 0.8]
        src += [("a", p, i + 1, x) for i, x in enumerate(s)]
        out += [("a", p, i + 1, x) for i, x in enumerate(t if p % 9 else [])]
    rng.shuffle(src), rng.shuffle(out)
    return spark.createDataFrame(src, "source string, part_idx int, index int, text string"), spark.createDataFrame(out, "source string, part_idx int, oi int, line string")


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_checks_of_a_parts_row_equal_those_of_joins(spark):
    src, out = parts_of(spark)
    sizes = qa.counts(src, out)
    even, odd = qa.zip_pairs(src, out, sizes), qa.misaligned_pairs(src, out, sizes)
    texts = qa.part_texts(qa.beside(src, out))
    assert even.count() and odd.count()
    assert rows(qa.pairs_of(texts, align=False)) == rows(even)
    assert rows(qa.pairs_of(texts)) == rows(even.unionByName(odd))
    whole = qa.part_checks(src, out, even.unionByName(odd))
    assert whole.where("n_out = 0").count()
    assert qa.text_checks(texts).schema.simpleString() == whole.schema.simpleString()
    assert rows(qa.text_checks(texts)) == rows(whole)
    assert rows(qa.text_checks(texts, align=False)) == rows(whole.where("n_src = n_out"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name, folds", [("qa_all", 1), ("qa_parts", 1), ("calibration", 3), ("verify_writeback", 2)])
def test_books_are_folded_once_for_all_checks(spark, name, folds):
    plan = Q.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= folds
