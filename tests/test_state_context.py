import random
import time

import pytest
from pyspark.sql import functions as F

from quire.config import ContextLimits
from quire.operators import context as C
from quire.operators import prompt as R
from quire.operators import state as S
from quire.streaming import state as stream

ACTIONS = ("CLAIM", "COMMIT_PASS", "COMMIT_WARN", "COMMIT_FAIL", "LLM_ERROR", "TRUNCATED", "SETTLE", "APPROVE", "UNLOCK", "RESET")


def sequential(events):
    out = {}
    for key, seq, action in sorted(events):
        status, n, review = out.get(key, ("PENDING", 0, False))
        out[key] = stream.step(status, n, review, action)
    return out


def some_events(n=400):
    rng = random.Random(3)
    return [(rng.randrange(12), i + 1, rng.choice(ACTIONS)) for i in range(n)]


def test_fold_is_sequential_application(spark):
    events = some_events()
    df = spark.createDataFrame(events, "key long, seq long, action string")
    got = {r.key: (r.status, r.attempts, r.needs_human_review) for r in S.fold(df).collect()}
    assert got == sequential(events)


def test_three_failures_block_the_next_part(spark):
    events = [(1, i + 1, a) for i, a in enumerate(["CLAIM", "COMMIT_FAIL"] * 3)]
    df = spark.createDataFrame(events, "key long, seq long, action string")
    assert S.fold(df).first().status == "FAILED"
    rows = spark.createDataFrame([("a", 1, "DONE"), ("a", 2, "FAILED"), ("a", 3, "PENDING"), ("b", 1, "DONE")], "source string, part_idx int, status string")
    got = {r.source: (r.next_idx, r.blocked) for r in S.next_part(rows).collect()}
    assert got == {"a": (2, True), "b": (None, False)}


def test_stream_agrees_with_batch(spark, tmp_path):
    events = some_events(120)
    df = spark.createDataFrame(events, "key long, seq long, action string")
    src = str(tmp_path / "in")
    for lo in (0, 60):
        df.where((F.col("seq") > lo) & (F.col("seq") <= lo + 60)).coalesce(1).write.mode("append").parquet(src)
    q = stream.track(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(src))
    run = q.writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.table("tracked").groupBy("key").agg(F.max_by(F.struct("status", "attempts", "needs_human_review"), "seq").alias("s"))
    assert {r.key: tuple(r.s) for r in last.collect()} == sequential(events)


def test_a_silent_claim_is_reported_as_stale(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "key long, seq long, action string"
    spark.createDataFrame([(1, 1, "CLAIM"), (2, 1, "CLAIM"), (2, 2, "COMMIT_PASS")], schema).coalesce(1).write.parquet(src)
    q = stream.track(spark.readStream.schema(schema).parquet(src), stale_seconds=1)
    run = q.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and not spark.table("silent").where("stale").count():
        time.sleep(1)
    run.stop()
    assert [(r.key, r.status) for r in spark.table("silent").where("stale").collect()] == [(1, "IN_PROGRESS")]


def test_context_has_tails_sections_and_terms(spark):
    parts = spark.createDataFrame([("a", 1, "first part"), ("a", 2, "田中 met Bob in 東京"), ("a", 3, "nothing")], "source string, part_idx int, text string")
    sections = spark.createDataFrame([("characters.md", 0, 1, "田中（主角）", "hero"), ("terms.md", 1, 2, "places", "table"), ("facts.md", 5, 3, "absent", "x")], "file string, prio int, ord int, heading string, body string")
    terms = spark.createDataFrame([(i, "東京" if i == 50 else f"Bob{'' if i == 0 else i}", f"t{i}") for i in range(60)], "pos int, src_term string, tgt_term string")
    outputs = spark.createDataFrame([("a", 1, "erster Teil")], "source string, part_idx int, text string")
    got = {r.part_idx: r for r in C.context_block(parts, sections, terms, outputs).collect()}
    assert got[1].context == "" and got[1].hits == []
    assert got[2].hits == ["characters.md::田中（主角）", "terms.md::places", "terms.md::terms"]
    want = [C.TRANSLATED_HEAD, "erster Teil", "", C.RAW_HEAD, "first part", "", C.NOTES_HEAD, "[characters.md] 田中（主角）", "hero", "", "[terms.md] places", "table", "", "[terms.md] terms", "Bob → t0", "東京 → t50"]
    assert got[2].context == "\n".join(want)
    assert C.RAW_HEAD in got[3].context and C.TRANSLATED_HEAD not in got[3].context and got[3].hits == []
    many = spark.createDataFrame([("a", 1, " ".join(f"Bob{i}" for i in range(60)))], "source string, part_idx int, text string")
    assert C.context_block(many, sections, terms).first().context.count("→") == 40


@pytest.mark.parametrize("limit", [10**6, 0])
def test_both_searches_find_what_python_finds(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "NEEDLES", limit)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab𠮷樋ひ藤 ") for _ in range(n))
    parts = [(f"s{i % 3}", i, word(rng.randrange(60))) for i in range(40)]
    needles = sorted({word(rng.randrange(1, 9)) for _ in range(80)})
    han = lambda s: "".join(c for c in s if "\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf" or c in "々〆〇")
    want = {(s, i, k, h) for s, i, t in parts for k in needles for h, x in ((False, t), (True, han(t))) if k in x}
    df = spark.createDataFrame(parts, "source string, part_idx int, text string")
    got = [tuple(r) for r in C.occurring(df, spark.createDataFrame([(k,) for k in needles], "k string")).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [100, 0])
def test_context_block_joins_what_its_pieces_find(spark, monkeypatch, limit):
    """Against context_hits, gloss_hits and prev_tails, by either search."""
    monkeypatch.setattr(C, "NEEDLES", limit)
    rng = random.Random(limit)
    word = lambda n: "".join(rng.choice("ab漢字") for _ in range(n))
    parts = spark.createDataFrame([(s, i, word(rng.choice([0, 9, 30]))) for s in "xy" for i in range(1, 13)] + [(None, 1, "a")], "source string, part_idx int, text string")
    outputs = spark.createDataFrame([(s, i, word(5)) for s in "xy" for i in range(1, 13, 2)], "source string, part_idx int, text string")
    sections = spark.createDataFrame([(C.FILES[i % 6], i % 6, i // 4, word(rng.choice([0, 2, 3])) + rng.choice(["", "（z", "(z"]), word(4)) for i in range(24)], "file string, prio int, ord int, heading string, body string")
    terms = spark.createDataFrame([(i, word(rng.choice([0, 2, 4])), rng.choice(["t", "u", None])) for i in range(12)], "pos long, src_term string, tgt_term string")
    limits = ContextLimits(budget=9, translation_tail=3, raw_tail=4, glossary=2)
    got = {(r.source, r.part_idx): r for r in C.context_block(parts, sections, terms, outputs, limits=limits).collect()}
    assert set(got) == {(s, i) for s in "xy" for i in range(1, 13)}
    hits, named, tails = {}, {}, {}
    for r in C.context_hits(parts, sections, terms).collect():
        hits.setdefault((r.source, r.part_idx), []).append((r.prio, r.ord, r.file, r.heading, r.body))
    first = {(r.src_term, r.tgt_term): r.pos for r in reversed(terms.orderBy("pos").collect())}
    for r in C.gloss_hits(parts, terms).where("tgt_term is not null").distinct().collect():
        named.setdefault((r.source, r.part_idx), []).append((first[r.src_term, r.tgt_term], f"{r.src_term} → {r.tgt_term}"))
    for r in C.prev_tails(parts, outputs, limits=limits).collect():
        tails[r.source, r.part_idx] = r
    assert any(x[2] == "terms.md" for v in hits.values() for x in v) and len(named) > 5
    for k, r in got.items():
        found, used, texts = sorted(hits.get(k, [])), 0, []
        for _, _, file, heading, body in found:
            if used + len(body) <= 9 or not texts:
                used, texts = used + len(body), [*texts, f"[{file}] {heading}\n{body}"]
        listed = [x for _, x in sorted(named.get(k, []))]
        texts += ["\n".join(["[terms.md] terms", *listed[:2]])] if listed else []
        heads = ((C.TRANSLATED_HEAD, tails[k].translation_tail), (C.RAW_HEAD, tails[k].raw_tail), (C.NOTES_HEAD, "\n\n".join(texts)))
        assert r.context == "\n\n".join(f"{h}\n{t}" for h, t in heads if t)
        assert r.hits == [f"{f}::{h}" for _, _, f, h, _ in found] + (["terms.md::terms"] if listed else [])


def test_context_block_reads_the_parts_once(spark):
    text = lambda: spark.createDataFrame([("x", 1, "ab")], "source string, part_idx int, text string").mapInArrow(lambda it: it, "source string, part_idx int, text string")
    sections = spark.createDataFrame([("facts.md", 5, 1, "a", "b")], "file string, prio int, ord int, heading string, body string")
    terms = spark.createDataFrame([(1, "b", "c")], "pos long, src_term string, tgt_term string")
    rows = C.context_block(text(), sections, terms, text())
    # the parts, the outputs and the search
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3


def test_budget_skips_what_does_not_fit(spark):
    rows = [("a", 1, 0, 1, "big", "x" * 5000), ("a", 1, 0, 2, "mid", "x" * 4000), ("a", 1, 1, 3, "small", "x" * 3000), ("b", 1, 0, 1, "huge", "x" * 9000)]
    df = spark.createDataFrame(rows, "source string, part_idx int, prio int, ord int, heading string, body string")
    got = {r.source: (r.headings, r.used) for r in C.within_budget(df).collect()}
    assert got == {"a": ("big|small", 8000), "b": ("huge", 9000)}


def test_empty_projection_never_hits(spark):
    parts = spark.createDataFrame([("a", 1, "no such name")], "source string, part_idx int, text string")
    terms = spark.createDataFrame([("Alice", "x")], "src_term string, tgt_term string")
    assert C.gloss_hits(parts, terms).count() == 0


def test_transport_retries_then_gives_up(spark):
    calls = []

    def client(system, user, tokens):
        calls.append(tokens)
        if len(calls) < 3:
            raise R.Retry("busy")
        return user.upper(), "stop"

    assert R.call(client, "s", "u", 5, sleep=lambda s: None) == ("U", "stop")
    calls.clear()
    assert R.call(lambda *a: (_ for _ in ()).throw(R.Retry("down")), "s", "u", 5, sleep=lambda s: None)[0] is None
    df = spark.createDataFrame([("a", 1, "s", "text", 10)], "source string, part_idx int, system string, user string, max_tokens int")
    assert R.translate(df, lambda s, u, n: (u[::-1], "stop")).first().text == "txet"
