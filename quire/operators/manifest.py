"""The manifest: one nested row a text, signed by the hash of its canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import PartLimits
from quire.operators.units import source_profile

SCHEMA_NAME, SCHEMA_VERSION = "quire/manifest", "1.0"
TOTALS = ("part_count", "total_char_count", "total_byte_count")
#: Stands where a catalog's parts go; it has a character that no other string of a catalog's head has.
_HERE = "\x00parts"


def canonical(value) -> bytes:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def _signature(text: str | None) -> str | None:
    """The hash of a JSON document's canonical form, without its own signature."""
    if text is None:
        return None
    doc = json.loads(text)
    doc.pop("manifest_sha256", None)
    return hashlib.sha256(canonical(doc)).hexdigest()


def _sign_batches(it):
    """Arrow batches whose last column is a document as JSON: that column becomes its signature."""
    for batch in it:
        signed = pa.array([_signature(x) for x in batch.columns[-1].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], signed], schema=pa.schema([*list(batch.schema)[:-1], pa.field("manifest_sha256", pa.string())]))


def _parts(slices: DataFrame, units_in_parts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, part_idx, char_count, byte_count, part): every part's catalog with its paragraphs nested."""
    on = [key, "part_idx"]
    para = F.struct(
        "paragraph_id", "index", F.col("rel_start").alias("start_char"), F.col("rel_end").alias("end_char"), "abs_start_char", "abs_end_char", "char_count", "sha256", "sep_newlines", "blank_before"
    )
    paras = units_in_parts.groupBy(*on).agg(F.count("*").alias("text_unit_count"), F.sort_array(F.collect_list(F.struct("index", para.alias("p")))).alias("ps"))
    rows = slices.join(paras, on, "left").join(labels, on, "left")
    part = F.struct(
        "part_id", F.col("part_idx").alias("index"), F.concat("part_id", F.lit(".txt")).alias("file"), "start_char", "end_char", "char_count", "byte_count", "sha256", "chapter_label", "first_heading",
        F.coalesce("text_unit_count", F.lit(0)).alias("text_unit_count"), "tail_newlines", "forced_cut", F.transform("ps", lambda x: x["p"]).alias("paragraphs"),
    )
    return rows.select(key, "part_idx", "char_count", "byte_count", part.alias("part"))


def _headed(per: DataFrame, texts: DataFrame, key: str, limits: PartLimits) -> DataFrame:
    """per(key, part_count, total_char_count, total_byte_count, ...) with what stands before the parts of a catalog."""
    src = F.struct("sha256", "char_count", "byte_count", "line_ending", "has_bom").alias("source_info")
    config = F.struct(F.lit(limits.target_min).alias("target_min"), F.lit(limits.target_max).alias("target_max"), F.lit(limits.hard_max).alias("hard_max"), F.lit(limits.min_part).alias("min_part"))
    rest = [n for n in per.columns if n not in (key, *TOTALS)]
    rows = per.join(source_profile(texts, key).select(key, src), key)
    return rows.select(key, F.lit(SCHEMA_NAME).alias("schema"), F.lit(SCHEMA_VERSION).alias("schema_version"), config.alias("config"), "source_info", *TOTALS, *rest)


def _totals() -> list[Column]:
    return [F.count("*").alias("part_count"), F.sum("char_count").alias("total_char_count"), F.sum("byte_count").alias("total_byte_count")]


def manifest(texts: DataFrame, slices: DataFrame, units_in_parts: DataFrame, labels: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    """One row a text with its parts and their paragraphs nested, for texts that a row can hold; `documents` is for longer ones."""
    rows = _parts(slices, units_in_parts, labels, key)
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part_idx", F.col("part").alias("p")))).alias("parts"), *_totals())
    return sign(_headed(per.withColumn("parts", F.transform("parts", lambda x: x["p"])), texts, key, limits))


def documents(texts: DataFrame, slices: DataFrame, units_in_parts: DataFrame, labels: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    """(key, part_count, total_char_count, total_byte_count, manifest_sha256, parts): what `manifest` gives, parts as JSON.

    A part's JSON is made in its own row; a text's is put together and signed part by part, so that a worker holds one copy of
    it, which is the result's own row, and nothing nested."""
    rows = _parts(slices, units_in_parts, labels, key)
    head = _headed(rows.groupBy(key).agg(*_totals()), texts, key, limits)
    head = head.select(key, *TOTALS, F.to_json(F.struct(*head.columns), {"ignoreNullFields": "false"}).alias("head"))
    made = rows.select(key, "part_idx", F.to_json("part").alias("plain"), F.to_json("part", {"ignoreNullFields": "false"}).alias("full"))
    made = made.join(head, key)
    number = F.row_number().over(Window.partitionBy(key).orderBy("part_idx"))
    made = made.select(key, *TOTALS, "head", "plain", "full", number.alias("n"))
    kind = made.schema[key].dataType.simpleString()
    return made.mapInArrow(_put_together, f"{key} {kind}, part_count long, total_char_count long, total_byte_count long, manifest_sha256 string, parts string")


def _put_together(it):
    """Parts in order to one row a text. The JSON grows in one buffer, which becomes the column without another copy."""
    row, text, signed, tail = None, bytearray(), None, b""

    def finished():
        signed.update(b"]" + tail)
        text.extend(b"]")
        ends = pa.array([0, len(text)], pa.int32()).buffers()[1]
        parts = pa.StringArray.from_buffers(1, ends, pa.py_buffer(text))
        return pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([signed.hexdigest()]), parts], [*row.schema.names[:4], "manifest_sha256", "parts"])

    for batch in it:
        for i in range(batch.num_rows):
            first = batch.column(7)[i].as_py() == 1
            if first:
                if row is not None:
                    yield finished()
                # a copy of the four values, as a slice would keep its whole batch
                row = pa.RecordBatch.from_arrays([pa.array([c[i].as_py()], c.type) for c in batch.columns[:4]], batch.schema.names[:4])
                before, after = canonical(json.loads(batch.column(4)[i].as_py()) | {"parts": _HERE}).split(canonical(_HERE))
                text, tail, signed = bytearray(b"["), after, hashlib.sha256(before + b"[")
            else:
                text.extend(b",")
                signed.update(b",")
            text.extend(batch.column(5)[i].as_buffer())
            signed.update(canonical(json.loads(batch.column(6)[i].as_py())))
    if row is not None:
        yield finished()


def sign(rows: DataFrame) -> DataFrame:
    """Add, or renew, manifest_sha256."""
    rows = rows.drop("manifest_sha256")
    rows = rows.withColumn("manifest_sha256", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    return rows.mapInArrow(_sign_batches, rows.schema)


def signature_errors(rows: DataFrame, key: str = "source") -> DataFrame:
    """Keys whose manifest does not match its own signature, schema or version."""
    again = sign(rows).select(key, F.col("manifest_sha256").alias("now"))
    both = rows.join(again, key)
    return both.where((F.col("manifest_sha256") != F.col("now")) | (F.col("schema") != SCHEMA_NAME) | (F.col("schema_version") != SCHEMA_VERSION)).select(key)
