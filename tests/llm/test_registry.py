"""Registered queries against their SQL on the driver's smallest tables, when those are there."""

import os

import pytest

from quire.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_html_wrapper": {"page_id", "url", "text", "n_chars"},
    "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_quality": {"doc_id", "held_out", "score", "predicted"},
    "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    flat = lambda df: sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df[cols].itertuples(index=False))
    assert flat(got) == flat(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_every_row(spark, name):
    out = registry.queries()[name](spark, DATA)
    table = "pages" if "page_id" in COLUMNS[name] else "documents"
    assert set(out.columns) == COLUMNS[name]
    assert out.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    q = registry.queries()
    lang = q["op4_language_id"](spark, data).where("held_out").join(docs, "doc_id")
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()
    good = q["op7_quality"](spark, data).where("held_out").join(labels, "doc_id")
    assert good.where("quality = predicted").count() >= 0.97 * good.count()
    toxic = q["op6_toxicity"](spark, data).where("held_out").join(labels, "doc_id")
    assert toxic.where("toxic = 0 and predicted = 1").count() == 0
    assert toxic.where("toxic = predicted").count() >= 0.95 * toxic.count()
