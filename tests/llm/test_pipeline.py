"""The pipeline's stages, each against a brute-force version of its own input, on the driver's smallest tables."""

import os

import numpy as np
import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def brute_toxic(model, text):
    """The factorization machine's definition, pair by pair."""
    from quire.llm import toxicity

    terms = model.ids(np.array([t for t in toxicity.term_sets(pa.array([text], pa.string()))[0] if t in set(model.terms.tolist())], np.uint64))
    raw = model.b + sum(model.w[i] for i in terms)
    for k, i in enumerate(terms):
        raw += sum(model.v[i] @ model.v[j] for j in terms[:k])
    return raw


def brute_quality(model, text):
    """Forward and backward sums line by line, in plain numbers."""
    from quire.llm import quality

    bins, size, lines = quality.line_features(pa.array([text], pa.string()))
    u = model.theta[quality.with_neighbours(bins, lines)].sum(1)
    e, m = [np.array([1.0, np.exp(min(30, max(-30, x)))]) for x in u], np.exp(model.pair)
    ahead, back = [e[0] / e[0].sum()], [np.ones(2)]
    for x in e[1:]:
        a = (ahead[-1] @ m) * x
        ahead.append(a / a.sum())
    for x in reversed(e[1:]):
        b = m @ (x * back[0])
        back.insert(0, b / b.sum())
    good = np.array([a[1] * b[1] / (a * b).sum() for a, b in zip(ahead, back)])
    w = np.maximum(size, 1)
    q = min(1 - 1e-6, max(1e-6, float((good * w).sum() / w.sum())))
    return 1 / (1 + np.exp(-(model.slope * np.log(q / (1 - q)) + model.shift)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_stages_equal_brute_force(spark):
    from test_neardup import brute
    from test_text_ops import brute_decontam, brute_mix

    from quire.llm import common, quality, toxicity

    docs = common.read(spark, DATA, "documents")
    names, steps = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, common.stash(stage(spark, docs, DATA))
        steps[name] = (before, docs)
        assert name == "mixing" or docs.columns == names
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    labels = common.read(spark, DATA, "labels")

    a, b = steps["toxicity"]
    model = toxicity.learn(a, labels)
    assert set(texts(b)) == {d for d, t in texts(a).items() if brute_toxic(model, t) < 0} < set(texts(a))

    a, b = steps["quality"]
    model = quality.learn(a, labels)
    assert set(texts(b)) == {d for d, t in texts(a).items() if brute_quality(model, t) >= 0.7} < set(texts(a))

    a, b = steps["near_duplicates"]
    assert set(texts(b)) == {d for d, _, _, kept in brute(list(texts(a).items())) if kept} < set(texts(a))

    a, b = steps["decontamination"]
    items = [(r.item_id, r.text) for r in common.read(spark, DATA, "benchmark").collect()]
    assert set(texts(b)) == {r[0] for r in brute_decontam(list(texts(a).items()), items) if not r[-1]}

    a, b = steps["mixing"]
    rows = [(r.doc_id, r.text, r.source) for r in a.collect()]
    per, goal, size = brute_mix(rows)
    taken, largest = dict.fromkeys(per, 0), dict.fromkeys(per, 0)
    for r in b.collect():
        assert 0 < r.taken <= 2 * r["size"] and r["size"] == size(r.text) and r.taken % r["size"] == 0
        taken[r.source] += r.taken
    for _, t, s in rows:
        largest[s] = max(largest[s], size(t))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in per)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_run_gives_the_last_stage(spark):
    from helpers import rows_of

    from quire.llm import common

    docs = common.read(spark, DATA, "documents")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert rows_of(pipeline.run(spark, DATA)) == rows_of(docs)
