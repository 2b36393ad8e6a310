"""Graph search, link propagation, wrappers, and the two classifiers."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, none
from pyspark.sql import functions as F

from quire.llm import ann as A
from quire.llm import htmlwrap as H
from quire.llm import quality as Q
from quire.llm import toxicity as X
from quire.llm import urlfilter as U

VEC = "vec_id long, embedding array<float>, label int, id int, v string"


def brute_top(rows, is_query, k):
    out = {}
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q in fine:
        if is_query(q):
            scored = []
            for i, v in fine.items():
                if i != q and len(v) == len(fine[q]):
                    a = fine[q]
                    scored.append((-round(float(a @ v / math.sqrt((a @ a) * (v @ v))), 12), i))
            out[q] = sorted(scored)[:k]
    return out


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a hot vector
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VEC)
    want = brute_top(rows, lambda q: q % 50 == 0, 5)
    got = {}
    for r in A.search(df, F.col("id") % 50 == 0, shard_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    hit = sum(len({i for i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004] and all(abs(s - 1) < 1e-12 for _, s in got[0])


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_recall_of_full_shards(kind):
    """Shards beyond the beam's reach: recall against brute force, and how few distances a search computes."""
    rng = np.random.default_rng(9)
    n = 6000
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    middle = rng.normal(size=(60, 48))
    x = unit(rng.normal(size=(n, 48)) if kind == "uniform" else middle[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, 48)))
    q = unit(x[rng.integers(0, n, 150)] + 0.1 * rng.normal(size=(150, 48)))
    graph = A.Graph(x)
    tried = []
    near = graph._near
    graph._near = lambda a, b: tried.append(int((b >= 0).sum())) or near(a, b)
    found, want = graph.best(q, 5), np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len({*a} & {*b}) / 5 for a, b in zip(found.tolist(), want.tolist())]) >= 0.97
    assert sum(tried) / (150 * n) < (0.6 if kind == "uniform" else 0.3)


@pytest.mark.parametrize("kind", ["uniform", "clustered", "hot"])
def test_routed_search_recall(spark, monkeypatch, kind):
    """Many cells, some dealt over shards, query parts: clustered vectors visit few cells, others all; recall holds."""
    rng = np.random.default_rng(12)
    n, visited = 3000, []
    middle = rng.normal(size=(40, 24))
    own = rng.integers(0, 40, n) if kind == "clustered" else np.where(rng.random(n) < 0.4, 0, 1)
    x = rng.normal(size=(n, 24)) if kind == "uniform" else middle[own] + (0.1 if kind == "clustered" else np.where(own == 0, 0.05, 1)[:, None]) * rng.normal(size=(n, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(5000 + i, [1.0, 2.0, float(i)]) for i in range(30)]
    visits = A._visits
    monkeypatch.setattr(A, "_visits", lambda *a: visited.append(visits(*a)) or visited[-1])
    monkeypatch.setattr(A, "QUERY_ROWS", 40)
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VEC)
    got = {}
    for r in A.search(df, F.col("id") % 10 == 0, shard_rows=250).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_top(rows, lambda q: q % 10 == 0, 5)
    hit = sum(len(got[q] & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values())) and all(len(got[q]) == 5 for q in want)
    assert visited[0] <= 3 if kind == "clustered" else visited[0] > 3 if kind == "uniform" else True
    assert all(got[q] <= set(range(5000, 5030)) for q in want if q >= 5000)


def test_each_shard_has_a_partition_of_its_own(spark):
    for n in (1, 7, 200):
        keys = [r.key for r in A._spread(spark, n).collect()]
        parts = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "key int").select(F.pmod(F.hash("key"), F.lit(n))).collect()]
        assert len(keys) == n and len(set(parts)) >= 0.99 * n


def test_search_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [2.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0, float("inf")]), (5, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (6, [0.0, 3.0]), (150, [1.0, 1.0, 0.0]), (7, [])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], VEC)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in A.search(df, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 6, 0.0), (150, 1, 5, round(2 / math.sqrt(6), 9))]
    assert A.search(none(spark, VEC), F.col("id") % 50 == 0).count() == 0


def test_graph_degree_is_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    g = A.Graph(x / np.linalg.norm(x, axis=1, keepdims=True), degree=12, beam=32)
    assert g.edges.shape == (400, 12) and (g.edges != np.arange(400)[:, None]).all()
    reach, todo = {*g.entries.tolist()}, g.entries.tolist()
    while todo:
        for y in g.edges[todo.pop()]:
            if y >= 0 and y not in reach:
                reach.add(int(y))
                todo.append(int(y))
    assert len(reach) >= 396


@pytest.mark.parametrize("apart", [1e-2, 1e-4, 1e-6])
def test_graph_finds_the_nearest_of_near_copies(apart):
    """Fifty dense groups, and one that holds a third of the rows: more groups and larger ones than a beam of the old entries saw."""
    rng = np.random.default_rng(11)
    many = rng.normal(size=(50, 32))[rng.integers(0, 50, 2000)] + apart * rng.normal(size=(2000, 32))
    one = rng.normal(size=(2000, 32))
    one[:700] = one[0] + apart * rng.normal(size=(700, 32))
    for v in (many, one):
        asked, u, hit = np.arange(0, 2000, 10), A._unit(v), 0
        near = np.argsort(-(u[asked] @ u.T - 2 * (asked[:, None] == np.arange(2000))), axis=1)[:, :32]
        found: dict = {}
        for i, x, _ in A.Shard(np.arange(2000), v).top(asked, v[asked], 5):
            found.setdefault(i, set()).add(x)
        for i, c in zip(asked.tolist(), near):
            score = A._cosine(np.repeat(v[i][None], 32, 0), v[c])
            hit += len(found[i] & set(c[np.lexsort((c, -score))][:5].tolist()))
        assert hit >= 0.97 * 5 * len(asked)


PAGE = "page_id long, url string, html string, host string, text string, rule int"


def links(*to):
    return "".join(f'<a HREF = "{t}">x</a>' for t in to)


def test_urls_and_rules(spark):
    urls = ["HTTPS://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://x.org", "http://b.com/fr/1", "http://b.com/de/", "no scheme", None, "http://notexample.org/es/", "http://h?/p", "x://y://z/a"]
    df = spark.createDataFrame([(i, u, None, "h", "t", 1) for i, u in enumerate(urls)], PAGE)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("x.org", "", None, "allow"), 3: ("b.com", "/fr/1", "com/fr/", "allow"),
        4: ("b.com", "/de/", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notexample.org", "/es/", "org/", "allow"), 8: ("h", "", None, "allow"), 9: ("y:", "//z/a", None, "allow"),
    }
    assert U.filter_urls(none(spark, PAGE)).count() == 0


def test_distrust_flows_to_linking_hosts(spark):
    pages = [
        (1, "http://bad.com/de/1", ""), (2, "http://feeder.net/a", links("http://bad.com/de/9", "http://bad.com/x")), (3, "http://far.net/", links("http://feeder.net/a")),
        (4, "http://good.com/fr/1", links("http://friend.net/")), (5, "http://friend.net/", None), (6, "http://friend.net/b", links("http://bad.com/", "http://friend.net/self")),
    ]
    df = spark.createDataFrame([(*p, "h", "t", 1) for p in pages], PAGE)
    got = {r.host: r for r in U.filter_urls(df).collect()}
    assert got["feeder.net"].verdict == "block" and got["feeder.net"].distrust > got["far.net"].distrust > 0
    assert got["friend.net"].trust > 0 and got["friend.net"].verdict == ("block" if got["friend.net"].distrust > got["friend.net"].trust else "allow")
    brute = power(pages, reverse=True, seeds={"bad.com": 1.0})
    for h, r in got.items():
        assert abs(r.distrust - brute.get(h, 0.0)) < 1e-8


@pytest.mark.parametrize("feeders", [2, 10, 150])
def test_distrust_by_own_links_does_not_depend_on_the_others(spark, feeders):
    pages = [(1, "http://bad.com/de/1", "")] + [(10 + i, f"http://f{i}.net/", links("http://bad.com/x")) for i in range(feeders)]
    pages += [(5, "http://mostly.net/", links("http://bad.com/x", *["http://fine.net/"] * 9)), (6, "http://far.net/", links("http://f0.net/"))]
    df = spark.createDataFrame([(*p, "h", "t", 1) for p in pages], PAGE)
    got = {r.host: r for r in U.filter_urls(df, by="out").collect()}
    assert {got[f"f{i}.net"].verdict for i in range(feeders)} == {"block"} and got["mostly.net"].verdict == "allow"
    assert abs(got["f0.net"].distrust - 0.85 * 0.15) < 1e-8 and abs(got["far.net"].distrust - 0.85**2 * 0.15) < 1e-8
    with pytest.raises(ValueError):
        U.filter_urls(df, by="size")


def power(pages, reverse, seeds):
    """Plain power iteration over the summed links."""
    import re

    edge = {}
    for _, u, html in pages:
        s = u.split("://")[1].split("/")[0]
        for t in re.findall(r'"http://([^/"]+)', html or ""):
            if s != t:
                k = (t, s) if reverse else (s, t)
                edge[k] = edge.get(k, 0) + 1
    rank = dict(seeds)
    for _ in range(U.STEPS):
        new = {h: s * (1 - U.DAMPING) for h, s in seeds.items()}
        for (a, b), n in edge.items():
            new[b] = new.get(b, 0) + U.DAMPING * rank.get(a, 0) * n / sum(m for (x, _), m in edge.items() if x == a)
        rank = new
    return rank


def page(k, extra="", body=None):
    return f"""<!doctype html><html><head><title>T{k}</title><style>p{{}}</style></head><body><div id="hdr"><p>Site name</p></div><nav><a>Home</a></nav>
<div class="box"><p>Follow us today</p></div><div class="story"><h1>Title {k}</h1>{body or f"<p>First &amp; {k}<p>Second<br>line {k}"}</div>{extra}<script>var x = "</p>";</script><footer>f</footer>"""


def test_wrapper_tells_template_from_text(spark):
    rows = [(k, f"http://h.net/{k}", page(k)) for k in range(5)] + [(9, "http://other.net/", page(9)), (10, None, "<p>alone"), (11, "http://h.net/e", ""), (12, "http://h.net/n", None), (0, "http://h.net/0", page(0))]
    df = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], PAGE)
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert got[3].text == "Title 3\nFirst & 3\nSecond line 3" and got[3].n_chars == len(got[3].text)
    assert "Follow us today" in got[9].text  # one page shows no template
    assert got[10].text == "alone" and got[11].text == "" and got[12].text == "" and got[12].n_chars == 0
    assert H.extract(df).count() == len(rows) and H.extract(none(spark, PAGE)).count() == 0


@pytest.mark.parametrize("tag", ["div", "article"])
@pytest.mark.parametrize("extra", ["<blockquote>Only here</blockquote>", "<ul><li>Only here</ul>", "<table><tr><td>Only here</table>"])
def test_text_of_fewer_pages_than_a_template_is_kept(spark, tag, extra):
    body = lambda k, more="": f"<body><{tag}><h1>Title {k}</h1><p>Text {k}</p>{more}<section>Follow us</section></{tag}>"
    rows = [(k, f"http://h.net/{k}", body(k)) for k in range(4)] + [(4, "http://h.net/4", body(4, extra)), (5, "http://h.net/5", body(4, extra))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(*r, "h", "t", 1) for r in rows], PAGE)).collect()}
    assert got == {k: f"Title {k}\nText {k}" for k in range(4)} | dict.fromkeys((4, 5), "Title 4\nText 4\nOnly here")
    rows += [(k, f"http://h.net/{k}", body(k, extra)) for k in (6, 7)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(*r, "h", "t", 1) for r in rows], PAGE)).collect()}
    assert got[4] == "Title 4\nText 4" and got[7] == "Title 7\nText 7"  # three differing pages make a template


def test_article_without_its_surroundings():
    t = H.main_text(
        '<body><div class="site-header"><p>Logo</p></div><div class="cookie-notice">We use cookies</div><main><article class="post"><header><h1>T</h1><p>By X</p></header><p>One &eacute;&nbsp;x</p>'
        '<aside>side</aside><div class="ad">Buy</div><ul><li>a<li>b</ul><form><p>f</form><div class="share-buttons">Share</div><div id="comments"><article class="comment"><p>lol</p></article></div>'
        '<p style="display: none">hid</p></article></main><div class="sidebar"><article><p>rel</p></article></div>', None)
    assert t == "T\nOne é x\na\nb"
    assert H.main_text('<body class="page-with-sidebar"><div class="content-with-sidebar"><h1>T</h1><p>' + "word " * 30 + "</p></div>", None).startswith("T\nword")
    assert H.main_text("<p>un<b>closed<p>next <!-- x <p>gone", None) == "unclosed\nnext"


LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700, seed=3):
    """Insults count only beside a group; junk lines make bad documents."""
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["insultor"] * insult + ["groupers"] * group
        rng.shuffle(w)
        lines = [" ".join(w[k : k + 8]) + "." for k in range(0, len(w), 8)]
        bad = rng.random() < 0.3
        if bad:
            lines = ["$$$ ### !!! " + x.upper() for x in lines]
        docs.append((i, "\n".join(lines), "en", "s", 1, 2, "h", 3))
        labels.append((i, 0 if bad else 1, int(insult and group)))
    return docs, labels


def frames(spark):
    from helpers import DOCS

    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (4, 1, 0)], LABELS), dict((d, (q, t)) for d, q, t in labels)


def test_pairs_of_terms_are_learned(monkeypatch):
    """Rows of two terms, positive with both or neither: additive weights cannot tell these, a pair can."""
    monkeypatch.setattr(X, "EPOCHS", 200)
    rng = np.random.default_rng(4)
    terms = np.sort(rng.integers(1, 1 << 63, 2, dtype=np.uint64))
    rows = [np.array(x) for x in ([0], [1], [0, 1], []) * 200]
    y = np.array([0.0, 0.0, 1.0, 1.0] * 200)
    m = X.FactorizationMachine(terms, 0.0)
    m.fit(rows, y)
    assert ((m.raw(rows) > 0) == (y > 0)).all()


def test_raw_score_is_the_definition():
    rng = np.random.default_rng(4)
    m = X.FactorizationMachine(rng.integers(1, 1 << 63, 6, dtype=np.uint64), 0.3)
    m.w = rng.normal(size=6)
    m.v = rng.normal(size=(6, X.FACTORS))
    for r in ([0, 2, 5], [], [1]):
        want = m.b + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(r, 2))
        assert abs(m.raw([np.array(r, int)])[0] - want) < 1e-9


def test_toxicity_learns_and_rejects(spark):
    docs, labels, truth = frames(spark)
    model = X.learn(docs, labels)
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    right = sum((got[d] >= 0.5) == bool(t) for d, (_, t) in truth.items())
    assert right >= 0.97 * len(truth)
    kept = X.clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s < 0.5}


def paired_corpus(n, seed):
    """Toxic: one slur, or in a tenth of the rows an insult beside a group; either of these alone is in a twentieth of the clean rows."""
    rng = random.Random(seed)
    texts, kinds = [], []
    for i in range(n):
        w = [f"word{rng.randrange(60)}" for _ in range(30)]
        kind = rng.choices(["slur", "pair", "insult", "group", "plain"], [9, 1, 4.5, 4.5, 81])[0]
        w += {"slur": ["slurred"], "pair": ["insultor", "groupers"], "insult": ["insultor"], "group": ["groupers"], "plain": []}[kind]
        rng.shuffle(w)
        texts.append(" ".join(w))
        kinds.append(kind)
    return X.term_sets(pa.array(texts)), np.array(kinds)


def test_terms_that_matter_only_in_pairs_are_learned():
    sets, kinds = paired_corpus(4000, 1)
    toxic = np.isin(kinds, ["slur", "pair"]).astype(int)
    screened = np.concatenate([X._screened(sets, toxic, part) for part in range(16)])
    alone = X.term_sets(pa.array(["insultor groupers"]))[0]
    assert not np.isin(alone, screened).any()  # odds of about 2 each
    model = X.fit_sample(sets, toxic)
    assert np.isin(alone, model.terms).all() and len(model.terms) == len(screened) + len(alone)  # no plain word enters
    held, kinds = paired_corpus(4000, 2)
    found = model.raw([model.ids(s[model.known(s)]) for s in held]) >= 0
    assert (found == np.isin(kinds, ["slur", "pair"])).all()


def auc(score, y):
    rank = np.empty(len(y))
    rank[np.argsort(score, kind="stable")] = np.arange(len(y))
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_ten_insults_and_ten_groups(share):
    """Toxic only when any of ten insults meets any of ten groups, each as common in clean rows as chance has it."""
    rng = random.Random(1)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(20)]

    def rows(n):
        texts, y = [], []
        for _ in range(n):
            w = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
            insult, group = rng.random() < share, rng.random() < share
            w += rng.choices(names[:10], k=insult) + rng.choices(names[10:], k=group)
            rng.shuffle(w)
            texts.append(" ".join(w))
            y.append(int(insult and group))
        return X.term_sets(pa.array(texts)), np.array(y)

    sets, y = rows(6000)
    model = X.fit_sample(sets, y)
    held, z = rows(3000)
    ids = [model.ids(s[model.known(s)]) for s in held]
    assert auc(model.raw(ids), z) >= 0.95
    model.v[:] = 0  # the additive part alone is worse
    assert auc(model.raw(ids), z) < auc_of_pairs(held, z, names) + 0.01


def auc_of_pairs(held, z, names):
    """What the two counts, added up, can tell."""
    insult, group = (np.isin(np.concatenate(X.term_sets(pa.array(some))), np.concatenate(held)) for some in (names[:10], names[10:]))
    assert insult.all() and group.all()
    parts = [np.unique(np.concatenate(X.term_sets(pa.array(some)))) for some in (names[:10], names[10:])]
    return auc(np.array([float(np.isin(s, parts[0]).any()) + float(np.isin(s, parts[1]).any()) for s in held]), z)


def test_words_of_long_texts_do_not_enter():
    """Toxic rows are longer here, so each common word is in more of them; none of these tells anything."""
    rng = random.Random(5)
    texts, y = [], []
    for _ in range(4000):
        toxic = rng.random() < 0.2
        w = [f"{rng.choice('abcdefghij')}{rng.randrange(40)}" for _ in range(rng.choice((120, 150)) if toxic else rng.choice((30, 40, 140)))]
        texts.append(" ".join([*w, *["slurred"] * toxic]))
        y.append(int(toxic))
    sets = X.term_sets(pa.array(texts))
    found = np.concatenate([X._leaning(sets, np.array(y), part) for part in range(16)])
    slur = X.term_sets(pa.array(["slurred"]))[0]
    assert np.isin(slur, found).all() and len(found) == len(slur)


def test_training_rows_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(i, "x" * 100 if i % 7 else None) for i in range(60)], "doc_id long, text string")
    rows = X.labelled(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS), "toxic", 5, 0, 40).collect()
    assert sum(len(r.text or "") for r in rows) == 1000 and len(rows) <= 40 and rows_again(spark, docs) == {r.k for r in rows}


def rows_again(spark, docs):
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS)
    return {r.k for r in X.labelled(docs.repartition(3), marks, "toxic", 5, 0, 40).collect()}


def test_pair_counts_equal_brute_force(monkeypatch):
    """Both ways of counting and both directions, over blocks smaller than the vocabulary."""
    monkeypatch.setattr(X, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(6)
    vocabulary = np.sort(rng.integers(1, 1 << 63, 25, dtype=np.uint64))
    has = rng.random((3000, 25)) < np.linspace(0.03, 0.6, 25)
    y = ((rng.random(3000) < 0.3) | (has[:, 2] & has[:, 8])) & ~(has[:, 14] & has[:, 17])
    sets, y = [vocabulary[r] for r in has], y.astype(int)
    n, pos, want = len(y), int(y.sum()), set()
    odds = lambda k, m: float(X._odds(np.float64(k), np.float64(m), pos, n))
    least = math.log(25**2 / X.CHANCE)
    for a, b in itertools.combinations(range(25), 2):
        m, k = int((has[:, a] & has[:, b]).sum()), int(y[has[:, a] & has[:, b]].sum())
        one = [(odds(y[has[:, t]].sum(), has[:, t].sum()), y[has[:, t]].mean()) for t in (a, b)]
        up, down = max(pos / n, *(r for _, r in one)), min(pos / n, *(r for _, r in one))
        kl = lambda r: sum(x * math.log(x / m / q) for x, q in ((k, r), (m - k, 1 - r)) if x)
        rise = k > up * m and odds(k, m) >= X.ODDS * max(1, *(o for o, _ in one)) and kl(up) >= least
        fall = k < down * m and odds(k, m) <= min(1, *(o for o, _ in one)) / X.ODDS and kl(down) >= least
        want |= {a, b} if rise or fall else set()
    assert {2, 8, 14, 17} <= want and len(want) < 25
    order = np.argsort(-y, kind="stable")  # rows of so few terms are near copies by chance, so they go in as they are
    assert set(np.searchsorted(vocabulary, X._paired([sets[i] for i in order], y[order])).tolist()) == want


def test_near_copies_are_one_witness_of_a_pair():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(1, 1 << 63, 200, dtype=np.uint64)) for _ in range(50)]
    copies = [np.unique(np.append(s[: -1 - k], rng.integers(1, 1 << 63, 1, dtype=np.uint64))) for k, s in enumerate(base[:20])]
    none = np.empty(0, np.uint64)
    got = X._distinct([*base, *copies, none, *base[:3], none])
    assert len(got) == 52 and all(a is b for a, b in zip(got, base))


def test_quality_learns_and_rejects(spark):
    docs, labels, truth = frames(spark)
    model = Q.learn(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert sum((got[d] >= 0.7) == bool(q) for d, (q, _) in truth.items()) >= 0.99 * len(truth)
    kept = Q.good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s >= 0.7}


@pytest.mark.parametrize("op", [X, Q])
def test_classifiers_on_awkward_rows(spark, op):
    docs = awkward(spark)
    for marks in ([], [(1, 1, 1)], [(1, 1, 1), (2, 0, 0), (22, 0, 1), (23, 1, 0), (26, 1, 1), (None, 0, 0)]):
        model = op.learn(docs, spark.createDataFrame(marks, LABELS))
        rows = op.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert op.score(none(spark), model).count() == 0
    assert op.learn(none(spark), none(spark, LABELS)) is not None


def test_marginals_equal_enumeration():
    col = pa.array(["AB cd\nx\n\nlast | 1!", "", None, "one", "\n", "a a a b\na a a b"])
    bins, size, lines = Q.line_features(col)
    assert size.tolist() == [len(x) for t in col.to_pylist() for x in (t or "").split("\n")]
    m = Q.LineCrf()
    m.theta, m.pair = np.random.default_rng(1).normal(0, 1, Q.WIDTH), np.array([[0.5, -0.2], [0.1, 0.7]])
    u = m.theta[Q.with_neighbours(bins, lines)].sum(1)
    good, _ = m.forward_backward(u, lines)
    for a, b in zip(lines[:-1], lines[1:]):
        z, top = 0.0, np.zeros(b - a)
        for s in itertools.product((0, 1), repeat=b - a):
            e = math.exp(sum(u[a + i] * x for i, x in enumerate(s)) + sum(m.pair[x, y] for x, y in zip(s, s[1:])))
            z, top = z + e, top + e * np.array(s)
        assert np.allclose(top / z, good[a:b])


def test_document_score_is_the_definition():
    """Marginals by enumeration, their mean by line length, the logistic curve."""
    col = pa.array(["AB cd\nx\n\nlast | 1!", "", None, "one two three", "\n", "a a a b\na a b\n!!!!"])
    m = Q.LineCrf()
    rng = np.random.default_rng(3)
    m.theta, m.pair, m.slope, m.shift = rng.normal(0, 0.5, Q.WIDTH), np.array([[0.4, -0.3], [0.2, 0.6]]), 1.7, -0.4
    bins, size, lines = Q.line_features(col)
    u = m.theta[Q.with_neighbours(bins, lines)].sum(1)
    for row, got in enumerate(m.score(col)):
        a, b = lines[row], lines[row + 1]
        z, top = 0.0, np.zeros(b - a)
        for s in itertools.product((0, 1), repeat=int(b - a)):
            e = math.exp(sum(u[a + i] * x for i, x in enumerate(s)) + sum(m.pair[x, y] for x, y in zip(s, s[1:])))
            z, top = z + e, top + e * np.array(s)
        w = np.maximum(size[a:b], 1)
        q = float((top / z * w).sum() / w.sum())
        assert abs(got - 1 / (1 + math.exp(-(1.7 * math.log(q / (1 - q)) - 0.4)))) < 1e-9


def test_training_gradient_is_that_of_the_likelihood():
    """Expected counts from the chain against differences of the log-likelihood, by enumeration."""
    col = pa.array(["AB cd\nx\nlast | 1!", "one two\nthree"])
    bins, _, lines = Q.line_features(col)
    ids = Q.with_neighbours(bins, lines)
    state = [1, 1, 1, 0, 0]

    def likelihood(theta, pair):
        out, u = 0.0, theta[ids].sum(1)
        for a, b in zip(lines[:-1], lines[1:]):
            energy = lambda s: sum(u[a + i] * x for i, x in enumerate(s)) + sum(pair[x, y] for x, y in zip(s, s[1:]))  # noqa: E731, B023
            out += energy(state[a:b]) - math.log(sum(math.exp(energy(s)) for s in itertools.product((0, 1), repeat=int(b - a))))
        return out

    m = Q.LineCrf()
    rng = np.random.default_rng(2)
    m.theta, m.pair = rng.normal(0, 0.5, Q.WIDTH), rng.normal(0, 0.5, (2, 2))
    good, pairs = m.forward_backward(m.theta[ids].sum(1), lines)
    grad = np.bincount(ids.ravel(), np.repeat(np.array(state) - good, ids.shape[1]), Q.WIDTH)
    true = np.zeros((2, 2))
    for a, b in zip(lines[:-1], lines[1:]):
        for x, y in zip(state[a:b], state[a + 1 : b]):
            true[x, y] += 1
    for k in {*ids.ravel().tolist()}:
        step = np.zeros(Q.WIDTH)
        step[k] = 1e-5
        assert abs((likelihood(m.theta + step, m.pair) - likelihood(m.theta - step, m.pair)) / 2e-5 - grad[k]) < 1e-5
    for x, y in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[x, y] = 1e-5
        want = (likelihood(m.theta, m.pair + step) - likelihood(m.theta, m.pair - step)) / 2e-5
        assert abs(want - (true - pairs.sum(0))[x, y]) < 1e-5


def test_term_sets_equal_those_of_the_words():
    """A text's terms are its words' own, each with its prefixes of 4 and 5 bytes, whatever stands around them."""
    import re

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéÄ日9") for _ in range(rng.randrange(1, 9)))
    texts = ["".join(word() + rng.choice([" ", "\n", "!!", "_", "-", " \x00 "]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", None]
    lower = lambda t: t.translate({k: k + 32 for k in range(65, 91)})
    own = {}
    for t, got in zip(texts, X.term_sets(pa.array(texts, pa.string()))):
        want = set()
        for w in re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", t or ""):
            b = lower(w).encode()
            for key in [("w", b), *((p, b[:p]) for p in X.PREFIXES if len(b) >= p)]:
                if key not in own:
                    alone = X.term_sets(pa.array([b.decode("utf-8", "ignore")]))[0]
                    own[key] = None if key[0] != "w" else alone
                want.add(key)
        assert len(got) == len(want)
        for kind, b in want:
            if kind == "w":
                assert np.isin(own[kind, b], got).all()


def test_repeated_lines_and_words_are_seen():
    bins, _, _ = Q.line_features(pa.array(["a b c d e\na b c d e\nx x x x"]))
    names = list(Q.BINS)
    seen, again = bins[:, names.index("seen")], bins[:, names.index("again")]
    assert seen[0] == seen[2] != seen[1] and again[2] > again[0]
