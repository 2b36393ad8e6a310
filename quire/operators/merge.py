"""The final text from verified parts, and the checks before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import pieces
from quire.operators.units import source_profile


def precheck(parts: DataFrame, state: DataFrame, lines: DataFrame, units: DataFrame, key: str = "source", strict: bool = False) -> DataFrame:
    """(key, part_idx, reason) that forbid a merge: not done, no output, wrong number of lines, or (strict) unreviewed."""
    on = [key, "part_idx"]
    n_out = lines.groupBy(*on).agg(F.count("*").alias("n_out"))
    n_src = units.groupBy(*on).agg(F.count("*").alias("n_src"))
    rows = parts.select(*on).join(state.select(*on, "status", "needs_human_review"), on, "left").join(n_src, on, "left").join(n_out, on, "left").na.fill(0, ["n_src", "n_out"])
    rule = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(
        F.array(
            rule(F.coalesce("status", F.lit("PENDING")) != "DONE", "not done"),
            rule((F.col("n_out") == 0) & (F.col("n_src") > 0), "no output"),
            rule((F.col("n_out") > 0) & (F.col("n_out") != F.col("n_src")), "line count"),
            rule(F.lit(strict) & F.coalesce("needs_human_review", F.lit(False)), "review"),
        )
    )
    return rows.select(*on, F.explode(reasons).alias("reason"))


def merge_text(pairs: DataFrame, tails: DataFrame, key: str = "source") -> DataFrame:
    """(key, text): lines in order, each after its unit's separator; pairs(key, part_idx, si, sep_newlines, line) and
    tails(key, tail_newlines) give what stands between and after them."""
    piece = F.concat(F.repeat(F.lit("\n"), F.col("sep_newlines")), F.col("line"))
    ordered = F.array_sort(F.collect_list(F.struct("part_idx", "si", piece.alias("p"))))
    rows = pairs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("body"))
    return rows.join(tails, key).select(key, F.concat("body", F.repeat(F.lit("\n"), F.col("tail_newlines"))).alias("text"))


def merge_pieces(pairs: DataFrame, tails: DataFrame, key: str = "source") -> DataFrame:
    """merge_text's texts in pieces (key, seq, text), a piece a part, the last with the newlines after it."""
    piece = F.concat(F.repeat(F.lit("\n"), F.col("sep_newlines")), F.col("line"))
    ordered = F.array_sort(F.collect_list(F.struct("si", piece.alias("p"))))
    rows = pairs.groupBy(key, F.col("part_idx").alias(pieces.SEQ)).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("body"))
    last = F.lead(pieces.SEQ).over(Window.partitionBy(key).orderBy(pieces.SEQ)).isNull()
    rows = rows.withColumn("last", last).join(tails, key)
    return rows.select(key, pieces.SEQ, F.concat("body", F.when(F.col("last"), F.repeat(F.lit("\n"), F.col("tail_newlines"))).otherwise("")).alias("text"))


def merge_stats(merged: DataFrame, texts: DataFrame, key: str = "source") -> DataFrame:
    """(key, chars, source_chars, ratio, sha256)."""
    rows = source_profile(merged, key).select(key, "char_count", "sha256").join(pieces.lengths(texts, key, "source_chars"), key)
    n = F.col("char_count")
    ratio = F.when(F.col("source_chars") > 0, n / F.col("source_chars")).otherwise(F.lit(0.0))
    return rows.select(key, n.alias("chars"), "source_chars", ratio.alias("ratio"), "sha256")


def check_merged(expected: DataFrame, current: DataFrame, key: str = "source") -> DataFrame:
    """IDENTICAL, DIFFERENT or MISSING by hash of the texts."""
    sha = lambda texts, name: source_profile(texts, key).select(key, F.col("sha256").alias(name))
    rows = sha(expected, "e").join(sha(current, "c"), key, "left")
    return rows.select(key, F.when(F.col("c").isNull(), "MISSING").when(F.col("c") == F.col("e"), "IDENTICAL").otherwise("DIFFERENT").alias("result"))
