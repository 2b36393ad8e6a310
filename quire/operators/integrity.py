"""Integrity of source, manifest and parts. Every check returns issues(key, part_id, level, code, msg); none means pass.

level: 2 FAIL, 1 WARN, 0 PASS, so that verdicts are plain maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import PartLimits
from quire.functions import text as T
from quire.operators import pieces
from quire.operators.units import source_profile

WARN, FAIL = 1, 2
LEVELS = ("PASS", "WARN", "FAIL")


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def issue(rows: DataFrame, key: str, part: Column | None, level: Column | int, code: str, msg: Column | str) -> DataFrame:
    part = F.lit(None).cast("string") if part is None else part
    level = F.lit(level) if isinstance(level, int) else level
    msg = F.lit(msg) if isinstance(msg, str) else msg
    return rows.select(F.col(key).alias(key), part.alias("part_id"), level.cast("int").alias("level"), F.lit(code).alias("code"), msg.alias("msg"))


def issues(rows: DataFrame, key: str, part: Column | None, code: str, found: list[tuple[Column | str, int, Column | str]]) -> DataFrame:
    """The issues (condition, level, msg) of each row from one pass over rows; a union of filters would make rows once for each."""
    held = lambda x, make: make(x) if isinstance(x, str) else x
    made = [F.when(held(cond, F.expr), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), held(msg, F.lit).alias("msg"))) for cond, level, msg in found]
    part = F.lit(None).cast("string") if part is None else part
    return rows.select(F.col(key).alias(key), part.alias("part_id"), F.inline(F.array_compact(F.array(*made))))


def union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def v1_source(texts: DataFrame, recorded: DataFrame, key: str = "source") -> DataFrame:
    """The text against its recorded profile(key, sha256, byte_count, char_count): identity fails, BOM and line ending warn."""
    now = source_profile(texts, key)
    old = recorded.select(key, *[F.col(c).alias(f"o_{c}") for c in ("sha256", "byte_count", "char_count")])
    differs = [(F.col(c) != F.col(f"o_{c}"), FAIL, f"{c} differs") for c in ("sha256", "byte_count", "char_count")]
    ending = ("line_ending not in ('LF', 'NONE')", WARN, F.concat(F.lit("line ending "), F.col("line_ending")))
    return issues(now.join(old, key), key, None, "V1", [*differs, ("has_bom", WARN, "byte-order mark"), ending])


def v2_manifest(slices: DataFrame, manifest: DataFrame, key: str = "source") -> DataFrame:
    """slices(part rows) against manifest(key, part_count, total_char_count, total_byte_count)."""
    w = Window.partitionBy(key).orderBy("part_idx")
    odd = slices.withColumn("rn", F.row_number().over(w)).where((F.col("rn") != F.col("part_idx")) | (F.col("part_id") != F.format_string("part_%03d", "rn")))
    sums = slices.groupBy(key).agg(F.count("*").alias("n"), F.sum("char_count").alias("c"), F.sum("byte_count").alias("b"))
    rows = manifest.join(sums, key, "left").na.fill(0, ["n", "c", "b"])
    return union(
        [
            issue(odd, key, F.col("part_id"), FAIL, "V2", "part ids are not consecutive"),
            issues(rows, key, None, "V2", [("n <> part_count", FAIL, "part count differs"), ("c <> total_char_count or b <> total_byte_count", FAIL, "totals differ")]),
        ]
    )


def v3_parts(manifest_parts: DataFrame, slices: DataFrame, key: str = "source") -> DataFrame:
    """Every part of the manifest exists with its hash and sizes."""
    now = slices.select(key, "part_id", *[F.col(c).alias(f"n_{c}") for c in ("sha256", "byte_count", "char_count")])
    rows = manifest_parts.join(now, [key, "part_id"], "left")
    differs = [(F.col("n_sha256").isNotNull() & (F.col(c) != F.col(f"n_{c}")), FAIL, f"{c} differs") for c in ("sha256", "byte_count", "char_count")]
    return issues(rows, key, F.col("part_id"), "V3", [("n_sha256 is null", FAIL, "part is missing"), *differs])


def v4_continuity(parts: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """Parts tile the text: no gap or overlap, none empty, first at 0, last at the end."""
    w = Window.partitionBy(key).orderBy("part_idx")
    rows = parts.withColumn("before", F.lag("end_char", 1, 0).over(w)).withColumn("next", F.lead("part_idx").over(w))
    rows = rows.join(pieces.lengths(texts, key), key)
    found = [("start_char <> before", "gap or overlap"), ("end_char <= start_char", "empty part"), ("next is null and end_char <> n", "does not reach the end")]
    return issues(rows, key, F.format_string("part_%03d", "part_idx"), "V4", [(cond, FAIL, msg) for cond, msg in found])


def part_totals(slices: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """V5: sums over parts beside the text's own sizes, a byte-order mark apart."""
    sums = slices.groupBy(key).agg(F.sum("char_count").cast("long").alias("sum_chars"), F.sum("byte_count").cast("long").alias("sum_bytes"), F.count("*").alias("n_parts"))
    if pieces.in_pieces(texts):
        bom = F.col("n_bom").cast("long")
        own = pieces.profile(texts, key).select(key, (F.col("char_count") - bom).alias("chars"), (F.col("byte_count") - 3 * bom).alias("bytes"))
    else:
        own = texts.select(key, F.length(T.without_bom(F.col("text"))).cast("long").alias("chars"), F.octet_length(T.without_bom(F.col("text"))).cast("long").alias("bytes"))
    rows = own.join(sums, key, "left").na.fill(0, ["sum_chars", "sum_bytes", "n_parts"])
    return rows.withColumn("ok", (F.col("sum_chars") == F.col("chars")) & (F.col("sum_bytes") == F.col("bytes")))


def rebuild_check(slices: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """V6: the parts in order give the text again. A text without all its parts fails."""
    built = pieces.profile(slices.select(key, F.col("part_idx").alias(pieces.SEQ), "text"), key).select(key, F.col("sha256").alias("built"), F.col("char_count").alias("n"))
    rows = source_profile(texts, key).select(key, "sha256").join(built, key, "left")
    return rows.select(key, F.coalesce(F.col("built") == F.col("sha256"), F.lit(False)).alias("ok"), F.coalesce("n", F.lit(0)).alias("built_chars"))


def v7_sizes(slices: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    n = F.col("char_count")
    level = F.when(n > limits.hard_max, FAIL).when((n > limits.target_max) | (n < limits.min_part), WARN).otherwise(0)
    return issue(slices.withColumn("lv", level).where("lv > 0"), key, F.col("part_id"), F.col("lv"), "V7", F.concat(n.cast("string"), F.lit(" characters")))


def size_report(slices: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    n = F.col("char_count")
    return slices.groupBy(key).agg(
        F.count("*").alias("n_parts"), F.min(n).alias("smallest"), F.max(n).alias("largest"), F.sum(n).cast("long").alias("chars"),
        F.count_if(n.between(limits.target_min, limits.target_max)).alias("in_band"), F.count_if(n > limits.hard_max).alias("over_hard"),
        F.count_if((n > limits.target_max) & (n <= limits.hard_max)).alias("over_target"), F.count_if(n < limits.min_part).alias("under_min"),
    )


def first_separators(units_in_parts: DataFrame, slices: DataFrame, key: str = "source") -> DataFrame:
    """The first unit of each part: its separator beside the newlines that end the text before it plus those that open the part."""
    w = Window.partitionBy(key).orderBy("part_idx")
    # newlines just before a part's first unit: those that open the part, and while parts end in newlines, theirs
    lead = slices.select(key, "part_idx", (F.length("text") - F.length(F.regexp_replace("text", "^\n+", ""))).alias("opening"), F.lag("tail_newlines", 1, 0).over(w).alias("closing"))
    first = units_in_parts.where("index = 1").select(key, "part_idx", "paragraph_id", "sep_newlines")
    rows = first.join(lead, [key, "part_idx"])
    return rows.select(key, "part_idx", "paragraph_id", "sep_newlines", (F.col("opening") + F.col("closing")).alias("newlines_before"))


def v8_units(stored: DataFrame, slices: DataFrame, key: str = "source") -> DataFrame:
    """Units found again in each part's own text against the stored ones: offsets, hashes and separators (not the first's)."""
    from quire.operators.units import units

    # parts of one text come from one task; here each is read by itself
    texts = slices.repartition(key, "part_idx").select(F.struct(key, "part_idx").alias("k"), "text")
    again = units(texts, "k").select(F.col(f"k.{key}").alias(key), F.col("k.part_idx").alias("part_idx"), F.col("idx").alias("index"), F.col("start_char").alias("a_start"), F.col("end_char").alias("a_end"), F.col("sha256").alias("a_sha"), F.col("sep_newlines").alias("a_sep"))
    rows = stored.select(key, "part_idx", "index", "rel_start", "rel_end", "sha256", "sep_newlines").join(again, [key, "part_idx", "index"], "full_outer")
    unit = lambda what: F.concat(F.lit("unit "), F.col("index").cast("string"), F.lit(what))
    both = F.col("sha256").isNotNull() & F.col("a_sha").isNotNull()
    found = [
        ("sha256 is null or a_sha is null", FAIL, unit(" has no counterpart")),
        (both & F.expr("rel_start <> a_start or rel_end <> a_end or sha256 <> a_sha"), FAIL, unit(" differs")),
        (both & F.expr("index > 1 and sep_newlines <> a_sep"), FAIL, unit(" separator differs")),
    ]
    return issues(rows, key, F.format_string("part_%03d", "part_idx"), "V8", found)


def verdicts(issues: DataFrame, key: str = "source") -> DataFrame:
    """The highest level and the counts of each, by key."""
    return issues.groupBy(key).agg(F.max("level").alias("lv"), F.count_if(F.col("level") == FAIL).alias("n_fail"), F.count_if(F.col("level") == WARN).alias("n_warn")).select(key, level_name(F.col("lv")).alias("verdict"), "n_fail", "n_warn")
