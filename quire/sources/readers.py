"""Readers: whole texts, outputs, JSON catalogs, note files and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T


def read_texts(spark: SparkSession, path: str, keep_bom: bool = False) -> DataFrame:
    """(source, text) of the UTF-8 files at path, each one row; source is the file's name without its ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    text = F.col("value") if keep_bom else T.without_bom(F.col("value"))
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("source"), text.alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) where bytes matter: hashes of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def locate_source(spark: SparkSession, folder: str, given: str = "", setting: str = "") -> str:
    """The path of the source: the one given, else the one of the settings, else the only *.txt file of the folder."""
    for path in (given.strip(), setting.strip()):
        if path:
            return path
    found = [r.path for r in listing(spark, folder, r"\.txt$").select("path").limit(11).collect()]
    if len(found) != 1:
        raise ValueError(f"{folder} holds {len(found) if len(found) < 11 else 'many'} text files, not one: name the source ({', '.join(found[:10])})")
    return found[0]


def read_checked(spark: SparkSession, path: str, schema: StructType | str, name: str, version: str) -> DataFrame:
    """What write_manifest wrote: JSON lines that must all be of one schema name and version."""
    rows = read_json(spark, path, schema, lines=True)
    bad = rows.where(~F.col("schema").eqNullSafe(F.lit(name)) | ~F.col("schema_version").eqNullSafe(F.lit(version))).limit(1).collect()
    if bad:
        raise ValueError(f"{path} holds {bad[0]['schema']} {bad[0].schema_version}, not {name} {version}")
    return rows


def one_source(spark: SparkSession, path: str) -> DataFrame:
    """read_texts for a path that must hold exactly one file."""
    rows = read_texts(spark, path)
    n = len(rows.inputFiles())
    if n != 1:
        raise ValueError(f"{path} holds {n} files, not one")
    return rows


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """JSON documents of a fixed schema, one a file or (lines) one a line, as our writers make them; a missing path is an error, a
    malformed document too."""
    return spark.read.json(path, schema=schema, multiLine=not lines, mode="FAILFAST")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the note files of a folder."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("file"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, length, modified) of the files below path whose path matches, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(F.col("path").rlike(pattern)).orderBy("path")


def stray_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files below path that expected(name) does not have."""
    rows = listing(spark, path).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return rows.join(expected.select("name"), "name", "left_anti")
