"""Punctuation by language pair: a registry of expressions; pairs without an entry are left alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

Handler = Callable[[Column, Column], tuple[Column, Column]]


def ja_to_zh_hans(src: Column, cur: Column) -> tuple[Column, Column]:
    """(line, tags). White corner brackets inside corner brackets become single quotes; a source line that is one white
    bracket quotation keeps that form; remaining corner brackets become double quotes."""
    niju, kakko = F.contains(src, F.lit("『")), F.contains(src, F.lit("「"))
    nested = niju & kakko & F.contains(cur, F.lit("『"))
    free = ~(F.contains(cur, F.lit("『")) | F.contains(cur, F.lit("《")) | F.contains(cur, F.lit("‘")))
    span = T.strip(F.regexp_extract(src, "(?s)『(.*?)』", 1))
    alone = niju & ~kakko & free & (F.length(span) >= F.greatest(F.length(T.strip(src)), F.lit(1)) * 0.8) & (F.regexp_count(cur, F.lit("“")) == 1)
    one = F.when(nested, F.translate(cur, "『』", "‘’")).when(alone, F.translate(cur, "“”", "『』")).otherwise(cur)
    corner = one.rlike("[「」]")
    line = F.when(corner, F.translate(one, "「」", "“”")).otherwise(one)
    tags = F.array_compact(F.array(F.when(niju, "has-niju"), F.when(nested, "nested"), F.when(alone, "standalone"), F.when(corner, "kakko")))
    return line, tags


HANDLERS: dict[tuple[str, str], Handler] = {("ja", "zh-hans"): ja_to_zh_hans}


def fix_line(src: Column, cur: Column, source_lang: str, target_lang: str) -> tuple[Column, Column]:
    handler = HANDLERS.get((source_lang, target_lang))
    return handler(src, cur) if handler else (cur, F.array().cast("array<string>"))


def registered(source_lang: str, target_lang: str) -> bool:
    return (source_lang, target_lang) in HANDLERS


def punctuate(units: DataFrame, outputs: DataFrame, source_lang: str, target_lang: str, key: str = "source") -> DataFrame:
    """punctuate_parts of outputs(key, part_idx, text) beside units(key, part_idx, index, text), which count from 1."""
    on = [key, "part_idx"]
    src = units.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]).alias("units"))
    return punctuate_parts(outputs.select(*on, "text").join(src, on, "left"), source_lang, target_lang, key)


def punctuate_parts(rows: DataFrame, source_lang: str, target_lang: str, key: str = "source") -> DataFrame:
    """(key, part_idx, text, sha256, fits, changed, tags) of rows(key, part_idx, text, units), each a part: the non-blank lines, beside the
    part's units by place, rewritten for the pair of languages; blank lines stay. A part whose numbers differ does not fit and is left
    alone, as everything is for a pair without an entry. Nothing is written; the caller writes what changed, with its new hash."""
    on = [key, "part_idx"]
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("ln"), x.alias("cur"), x.rlike(T.NOT_BLANK).alias("full")))
    rows = rows.where("text is not null").select(*on, F.coalesce("units", F.array().cast("array<string>")).alias("units"), lines.alias("lines"))
    n_out = F.size(F.filter("lines", lambda x: x["full"]))
    rows = rows.select(*on, "units", "lines", ((F.size("units") == n_out) | (n_out == 0)).alias("fits"))
    row = lambda x, src, apply: F.struct(x["ln"].alias("ln"), x["cur"].alias("cur"), src.alias("src"), apply.alias("apply"))
    # only where a part fits is its every line beside its unit
    full = F.when(F.col("fits"), F.zip_with(F.filter("lines", lambda x: x["full"]), "units", lambda x, u: row(x, u, F.lit(True))))
    other = F.filter("lines", lambda x: ~x["full"] | ~F.col("fits"))
    both = F.concat(F.coalesce(full, F.array()), F.transform(other, lambda x: row(x, F.lit(None).cast("string"), F.lit(False))))
    rows = rows.select(*on, "fits", F.inline(F.filter(both, lambda x: x["ln"].isNotNull())))
    line, tags = fix_line(F.col("src"), F.col("cur"), source_lang, target_lang)
    rows = rows.select(*on, "ln", "cur", "fits", F.when(F.col("apply"), line).otherwise(F.col("cur")).alias("line"), F.when(F.col("apply"), tags).otherwise(F.array().cast("array<string>")).alias("tags"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    rows = rows.groupBy(*on).agg(joined.alias("text"), F.first("fits").alias("fits"), F.count_if(F.col("cur") != F.col("line")).alias("changed"), F.flatten(F.collect_list("tags")).alias("tags"))
    return rows.select(*on, "text", T.sha256(F.col("text")).alias("sha256"), "fits", "changed", F.array_sort("tags").alias("tags"))
