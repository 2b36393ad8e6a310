"""Writers. Spark's commit protocol publishes a table only when all of it is written; a failed write leaves nothing."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


def write_parts(slices: DataFrame, path: str, key: str = "source", replace: bool = False) -> None:
    """Part texts, partitioned by key; an existing split is not overwritten unless asked."""
    slices.write.mode("overwrite" if replace else "errorifexists").partitionBy(key).parquet(path)


def write_manifest(manifest: DataFrame, path: str, replace: bool = False) -> None:
    manifest.write.mode("overwrite" if replace else "errorifexists").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """The transition log is only ever appended to."""
    events.write.mode("append").parquet(path)


def start_state(state: DataFrame, path: str, by: str, rebuild: bool = False) -> None:
    """The first snapshot of a project; refused where there is one, unless asked to rebuild it."""
    where, files = _hadoop(state.sparkSession, path)
    if files.exists(where) and not rebuild:
        raise ValueError(f"{path} has a state already")
    save_state(state, path, by)


def save_state(state: DataFrame, path: str, by: str) -> None:
    """The latest snapshot, stamped. It is written beside the old one and takes its place when whole, so `state` may come from
    there, and a failed write leaves the old one."""
    spark, new = state.sparkSession, f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    state.withColumns({"updated_at": F.current_timestamp(), "updated_by": F.lit(by)}).write.parquet(new)
    (now, files), (old, _), (made, _) = (_hadoop(spark, p) for p in (path, f"{path.rstrip('/')}.old", new))
    files.delete(old, True)
    if files.exists(now):
        files.rename(now, old)
    files.rename(made, now)
    files.delete(old, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def archive(outputs: DataFrame, path: str) -> None:
    """Earlier outputs, stamped, before a reset replaces them."""
    outputs.withColumn("archived_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_split(slices: DataFrame, manifest: DataFrame, problems: DataFrame, path: str, key: str = "source", replace: bool = False) -> None:
    """Parts, then their manifest, below path; refused if audit.self_check found problems."""
    found = problems.select(key, "code").distinct().limit(5).collect()
    if found:
        raise ValueError("the split fails its own checks: " + ", ".join(f"{r[0]} {r[1]}" for r in found))
    write_parts(slices, f"{path}/parts", key, replace)
    write_manifest(manifest, f"{path}/manifest", replace)


def stage_outputs(outputs: DataFrame, incoming: str, path: str, key: str = "source") -> DataFrame:
    """Write outputs(key, part_idx, text) as drafts, hash what arrived there, and append that to path; returns (key, part_idx,
    output_sha256, output_char_count) of the rows as stored."""
    spark = outputs.sparkSession
    outputs.select(key, "part_idx", "text").write.mode("errorifexists").parquet(incoming)
    rows = spark.read.parquet(incoming)
    rows = rows.withColumns({"output_sha256": T.sha256(F.col("text")), "output_char_count": F.length("text")})
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(rows.select(key, "part_idx"), [key, "part_idx"], "left_semi").select(key, "part_idx", "output_sha256", "output_char_count")


def _plain(path: str) -> str:
    """A path without scheme, doubled slashes and dots, for comparison."""
    return posixpath.normpath("/" + path.split("://", 1)[-1].removeprefix("file:").lstrip("/"))


def write_text(merged: DataFrame, path: str, source_path: str, key: str = "source") -> None:
    """Final texts as text files, one folder a key; never the source or the folder that holds it."""
    if _plain(path) in (_plain(source_path), posixpath.dirname(_plain(source_path))):
        raise ValueError("the result would overwrite its source")
    merged.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


#: Names of a project's note files.
SKELETON = ("characters.md", "terms.md", "locations.md", "relationships.md", "timeline.md", "facts.md", "conflicts.md")


def seed_notes(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """(file, text) of the note files that existing(file) lacks."""
    rows = spark.createDataFrame([(f, f"# {f.removesuffix('.md')}\n") for f in SKELETON], "file string, text string")
    return rows.join(existing.select("file"), "file", "left_anti")


def report_json(issues: DataFrame) -> DataFrame:
    """Issues as JSON lines, failures first."""
    return issues.orderBy(F.desc("level"), "code", "part_id").select(F.to_json(F.struct(*issues.columns)).alias("value"))


def report_text(issues: DataFrame, key: str = "source") -> DataFrame:
    """Issues as lines of text, failures first, each with its level's name; a key's issues stay together."""
    name = F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("level") + 1)
    line = F.concat_ws(" ", F.concat(F.lit("["), name, F.lit("]")), "code", "part_id", T.clipped(F.col("msg"), 200))
    return issues.orderBy(key, F.desc("level"), "code", "part_id").select(key, line.alias("value"))


def archive_name(name: Column, at: Column) -> Column:
    """A name with the time at which it was archived."""
    return F.concat(name, F.lit("."), F.date_format(at, "yyyyMMdd-HHmmss"))
