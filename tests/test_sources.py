import pytest

from quire.sources import readers, writers


def test_round_trip_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "book one.txt").write_bytes("﻿a\nb\n".encode())
    rows = readers.one_source(spark, str(tmp_path / "in"))
    assert rows.collect() == [("book one", "a\nb\n")]
    writers.write_text(rows, str(tmp_path / "out"), str(tmp_path / "in"))
    assert len(list((tmp_path / "out").glob("source=*/*.txt"))) == 1
    with pytest.raises(ValueError):
        writers.write_text(rows, str(tmp_path / "in"), str(tmp_path / "in"))
    (tmp_path / "in" / "two.txt").write_text("x")
    with pytest.raises(ValueError):
        readers.one_source(spark, str(tmp_path / "in"))


def test_existing_split_is_kept(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x")], "source string, part_idx int, text string")
    writers.write_parts(df, str(tmp_path / "parts"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        writers.write_parts(df, str(tmp_path / "parts"))
    writers.write_parts(df, str(tmp_path / "parts"), replace=True)


def test_notes_and_listing(spark, tmp_path):
    for f in ("characters.md", "odd.tmp"):
        (tmp_path / f).write_text("## A\nbody")
    assert {r.file for r in readers.read_notes(spark, str(tmp_path / "*.md")).collect()} == {"characters.md"}
    have = spark.createDataFrame([("characters.md",)], "name string")
    assert [r.name for r in readers.stray_files(spark, str(tmp_path), have).collect()] == ["odd.tmp"]
    assert writers.seed_notes(spark, have.withColumnRenamed("name", "file")).count() == 6


def test_json_must_be_well_formed(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1,\n "b": "x"}')
    assert readers.read_json(spark, str(tmp_path / "m.json"), "a int, b string").collect() == [(1, "x")]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "bad.json"), "a int").collect()
