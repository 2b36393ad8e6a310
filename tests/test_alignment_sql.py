"""The SQL of sequence alignment, and the queries that check parts of unequal counts by it."""

import os
import random

import pytest

from quire import oracles as O
from quire import queries as Q
from quire.operators import qa

DATA = "/root/testdata/sf0.001"


def test_sql_aligns_as_the_operator_does():
    import duckdb

    rng = random.Random(6)
    parts = {}
    for p in range(400):
        a = [rng.choice("abcd") * rng.choice((1, 1, 9)) for _ in range(rng.randrange(1, 12))]
        b = [rng.choice([*a, "new", "a"]) for _ in range(rng.randrange(0, 12))] if p % 2 else [x for x in a if rng.random() < 0.8]
        if len(a) != len(b):
            parts[p] = a, b
    con = duckdb.connect()
    rows = lambda k: [("s", p, i + 1, x) for p, ab in parts.items() for i, x in enumerate(ab[k])]
    for name, k, cols in (("pu", 0, "index INT, text VARCHAR"), ("lines", 1, "oi INT, line VARCHAR")):
        con.execute(f"CREATE TABLE {name} (source VARCHAR, part_idx INT, {cols})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows(k))
    con.execute("CREATE TABLE pairs (source VARCHAR, part_idx INT, s VARCHAR, t VARCHAR)")
    con.execute("CREATE TABLE sizes (source VARCHAR, part_idx INT, n_src BIGINT, n_out BIGINT)")
    con.executemany("INSERT INTO sizes VALUES ('s', ?, ?, ?)", [(p, len(a), len(b)) for p, (a, b) in parts.items()])
    got: dict = {}
    for p, i, j in con.execute("WITH " + O._ALIGNED.strip() + " SELECT part_idx, si, oi FROM ij").fetchall():
        got.setdefault(p, []).append((i, j))
    order = lambda rows: sorted(rows, key=repr)
    assert {p: order(r) for p, r in got.items()} == {p: order(qa.align_sequences(a, b)) for p, (a, b) in parts.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_parts_of_unequal_counts_are_audited_and_written_back(spark):
    case = Q.Case(spark, DATA)
    odd = {(r.source, r.part_idx): r.n_out - r.n_src for r in qa.counts(case.part_units, case.lines).where("n_src <> n_out").collect()}
    back = {(r.source, r.part_idx): r for r in Q.q_verify_writeback(case).collect()}
    there = odd.keys() & back.keys()
    assert there and all(back[k].verify in ("WARN", "FAIL") and back[k].delta == odd[k] and back[k].needs_human_review for k in there)
    assert {s for s, _ in odd} == {r.source for r in Q.q_audit(case).where("code = 'V10.A'").collect()}
