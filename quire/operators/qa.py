"""Alignment of a source's units with the lines of its counterpart, and the checks on them.

src: (key, part_idx, index, text); out: (key, part_idx, oi, line), both counted from 1 within a part. Parts of equal
counts pair by position, a plain equi-join; only the others go to Python for a sequence alignment.
"""

from __future__ import annotations

import dataclasses
import difflib
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quire.config import RatioBands
from quire.functions import text as T

WARN, FAIL = 1, 2
_D, _S = r"\p{Nd}", f"[{T.SPACE}]"
#: Marks that must not occur in a counterpart's lines, each tried on stripped lines.
FORBIDDEN = (
    ("fence", r"^```"),
    ("paragraph number", rf"^{_S}*[-*]{_S}+\[[pP]{_D}+\]"),
    ("paragraph number", rf"\[p{_D}{{3}}\]"),
    ("part number", rf"\[part_?{_D}+\]"),
    ("meta talk", rf"^(以下是|下面是)?{_S}*(译文|翻译)[:：]"),
    ("omission mark", r"（此处省略）|（以下略）|（中略）|\[未翻译\]|\[省略\]"),
    ("chapter number", rf"^第{_S}*{_D}+{_S}*部分"),
    ("heading mark", rf"^#{{1,6}}{_S}"),
)
#: Kana characters, and the share of them above which they are residue.
KANA = "[぀-ゟ゠-ヿ]"
KANA_MAX = 0.15
SHINGLE, REPEAT_MAX, ADJACENT_MIN = 30, 0.15, 8


def out_lines(parts_out: DataFrame, key: str = "source") -> DataFrame:
    """The stripped non-blank lines of parts_out(key, part_idx, text)."""
    kept = F.filter(F.transform(F.split("text", "\n", -1), T.strip), lambda x: x != "")
    return parts_out.select(key, "part_idx", F.posexplode(kept).alias("p", "line")).select(key, "part_idx", (F.col("p") + 1).alias("oi"), "line")


def clean_output(raw: Column) -> Column:
    """A model's raw answer as lines: fences, whole-line chatter and blank lines go, the rest is stripped."""
    #: Whole lines by which a model opens or closes its answer.
    fence = f"^{_S}*```[a-zA-Z]*{_S}*\\z"
    chatter = f"^{_S}*(好的|以下是|下面是|译文如下|翻译如下|这是译文|已翻译|希望对你有帮助|Note:|Sure|Here is)[:：,]?{_S}*\\z"
    lines = F.split(F.regexp_replace(raw, "\r\n?", "\n"), "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(fence) & ~x.rlike(chatter) & (T.strip(x) != ""))
    return F.array_join(F.transform(kept, T.strip), "\n")


def counts(src: DataFrame, out: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, n_src, n_out) of every part with units."""
    a = src.groupBy(key, "part_idx").agg(F.count("*").alias("n_src"))
    b = out.groupBy(key, "part_idx").agg(F.count("*").alias("n_out"))
    return a.join(b, [key, "part_idx"], "left").na.fill(0, ["n_out"])


def zip_pairs(src: DataFrame, out: DataFrame, sizes: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, si, oi, s, t) of the parts with equal counts."""
    on = [key, "part_idx", "si"]
    same = sizes.where("n_src = n_out").select(key, "part_idx")
    a = src.select(key, "part_idx", F.col("index").alias("si"), T.strip(F.col("text")).alias("s")).join(same, [key, "part_idx"], "left_semi")
    return a.join(out.select(key, "part_idx", F.col("oi").alias("si"), F.col("line").alias("t")), on).select(key, "part_idx", "si", F.col("si").alias("oi"), "s", "t")


def align_sequences(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions (from 1) by the longest matching blocks; what has no counterpart pairs with None."""
    out: list[tuple[int | None, int | None]] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        both = j - i if op == "equal" else min(j - i, m - k) if op == "replace" else 0
        out += [(i + x + 1, k + x + 1) for x in range(both)]
        out += [(x + 1, None) for x in range(i + both, j)]
        out += [(None, x + 1) for x in range(k + both, m)]
    return out


def misaligned_pairs(src: DataFrame, out: DataFrame, sizes: DataFrame, key: str = "source") -> DataFrame:
    """Like zip_pairs for the parts with unequal counts, by sequence alignment; si or oi is null without a counterpart."""
    odd = sizes.where("n_src <> n_out").select(key, "part_idx")
    kind = src.schema[key].dataType.simpleString()
    a = src.join(odd, [key, "part_idx"], "left_semi").select(key, "part_idx", F.col("index").alias("i"), T.strip(F.col("text")).alias("x"))
    b = out.join(odd, [key, "part_idx"], "left_semi").select(F.col(key).alias(key), F.col("part_idx").alias("part_idx"), F.col("oi").alias("i"), F.col("line").alias("x"))

    def align(group, left, right):
        s, t = left.sort_values("i")["x"].tolist(), right.sort_values("i")["x"].tolist()
        rows = [(group[0], group[1], i, j, s[i - 1] if i else None, t[j - 1] if j else None) for i, j in align_sequences(s, t)]
        pdf = pd.DataFrame(rows, columns=[key, "part_idx", "si", "oi", "s", "t"])
        return pdf.astype({"si": "Int32", "oi": "Int32"})

    return a.groupBy(key, "part_idx").cogroup(b.groupBy(key, "part_idx")).applyInPandas(align, f"{key} {kind}, part_idx int, si int, oi int, s string, t string")


def pair_checks(pairs: DataFrame, bands: RatioBands = RatioBands()) -> DataFrame:
    """pairs with short (C), ratio_level (D) and special_missing (V12)."""
    s, t = F.length("s"), F.length("t")
    ratio = F.when((s >= 8) & F.col("t").isNotNull(), t / s)
    short = (s >= 15) & ((t <= 2) | (t < F.greatest(F.lit(2), F.floor(s * 0.15))))
    level = (
        F.when((ratio < bands.unit_fail_low) | (ratio > bands.unit_fail_high), FAIL)
        .when((ratio < bands.unit_warn_low) | (ratio > bands.unit_warn_high), WARN)
        .otherwise(0)
    )
    lost = F.col("s").isNotNull() & F.col("t").isNull()
    return pairs.withColumns({"unit_ratio": ratio, "short": F.coalesce(short, F.lit(False)) | lost, "ratio_level": level, "special_missing": lost & T.is_symbol_or_short(F.col("s"))})


def order_jumps(pairs: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, jumps): matched pairs whose counterpart lies before the previous one's."""
    w = Window.partitionBy(key, "part_idx").orderBy("si")
    rows = pairs.where("si is not null and oi is not null").withColumn("was", F.lag("oi").over(w))
    return rows.groupBy(key, "part_idx").agg(F.count_if(F.col("oi") < F.col("was")).alias("jumps"))


def adjacent_duplicates(out: DataFrame, key: str = "source") -> DataFrame:
    w = Window.partitionBy(key, "part_idx").orderBy("oi")
    same = (F.col("line") == F.lag("line").over(w)) & (F.length("line") > ADJACENT_MIN)
    return out.withColumn("same", F.coalesce(same, F.lit(False))).groupBy(key, "part_idx").agg(F.count_if("same").alias("n_adjacent"))


def _shingles(text: Column) -> Column:
    """A text's blocks of SHINGLE characters; they start before its last SHINGLE ones, so a text of whole blocks leaves out its last."""
    n = F.ceil(F.greatest(F.length(text) - SHINGLE, F.lit(0)) / SHINGLE).cast("int")
    return F.slice(F.regexp_extract_all(text, F.lit(f"(?s).{{{SHINGLE}}}"), F.lit(0)), F.lit(1), n)


def shingle_repeats(out: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, n_blocks, n_repeated) of the 30-character blocks of a part's joined lines."""
    return part_lines(out, key).select(key, "part_idx", "n_blocks", "n_repeated")


def forbidden(out: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, and for each pattern how many lines it marks)."""
    return out.groupBy(key, "part_idx").agg(*[F.count_if(F.col("line").rlike(p)).alias(f"f{i + 1}") for i, (_, p) in enumerate(FORBIDDEN)])


def marked_lines(out: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, pattern, name, n, sample): for each pattern that marks lines of a part, how many, and the start of the first."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(i + 1).alias("pattern"), F.lit(name).alias("name"))) for i, (name, p) in enumerate(FORBIDDEN)]))
    rows = out.select(key, "part_idx", "oi", T.clipped(F.col("line"), 40).alias("sample"), F.inline(hits))
    return rows.groupBy(key, "part_idx", "pattern", "name").agg(F.count("*").alias("n"), F.min_by("sample", "oi").alias("sample"))


def kana_ratio(x: Column) -> Column:
    """Share of kana in the characters that are not white space."""
    return F.regexp_count(x, F.lit(KANA)) / F.greatest(F.length(F.regexp_replace(x, _S, "")), F.lit(1))


#: Detectors of source-language residue in a counterpart: language key -> condition on its text. Add entries to register.
RESIDUE = {"ja": lambda x: kana_ratio(x) > KANA_MAX}


def has_residue(x: Column, lang: str) -> Column:
    """False for a language without a detector."""
    return RESIDUE[lang](x) if lang in RESIDUE else F.lit(False)


def part_lines(out: DataFrame, key: str = "source", lang: str = "") -> DataFrame:
    """(key, part_idx, n_out, out_chars, marked, residue, n_adjacent, n_blocks, n_repeated): what the lines of a part tell, from one aggregate."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("oi", "line"))), lambda x: x["line"])
    return _line_facts(out.groupBy(key, "part_idx").agg(ordered.alias("ls")), "ls", lang, key, "part_idx")


def _line_facts(rows: DataFrame, name: str, lang: str, *kept: str) -> DataFrame:
    """part_lines' columns beside those kept, of rows whose array name holds a part's lines in order."""
    ls = F.col(name)
    marked = F.exists(ls, lambda x: functools.reduce(Column.__or__, [x.rlike(p) for _, p in FORBIDDEN]))
    again = F.transform(ls, lambda x, i: F.coalesce((i > 0) & (F.length(x) > ADJACENT_MIN) & (x == F.get(ls, i - 1)), F.lit(False)))
    rows = rows.withColumn("joined", F.array_join(ls, "")).withColumn("b", _shingles(F.col("joined")))
    return rows.select(
        *kept, F.size(ls).alias("n_out"), F.length("joined").alias("out_chars"), marked.cast("int").alias("marked"),
        has_residue(F.array_join(ls, "\n"), lang).cast("int").alias("residue"), F.size(F.filter(again, lambda x: x)).alias("n_adjacent"),
        F.size("b").alias("n_blocks"), (F.size("b") - F.size(F.array_distinct("b"))).alias("n_repeated"),
    )


def part_pairs(pairs: DataFrame, key: str = "source", bands: RatioBands = RatioBands(), kept: tuple[str, ...] = ()) -> DataFrame:
    """(key, part_idx, short, ratio_level, special, ratio_median, jumps): what the pairs of a part tell, from one aggregate; kept are
    columns that all pairs of a part share."""
    order = F.filter(F.array_sort(F.collect_list(F.struct("si", "oi"))), lambda x: x["si"].isNotNull() & x["oi"].isNotNull())
    most = lambda c: F.max(F.col(c).cast("int")).alias(c)
    rows = pair_checks(pairs, bands).groupBy(key, "part_idx").agg(most("short"), most("ratio_level"), most("special_missing"), F.median("unit_ratio").alias("ratio_median"), order.alias("o"), *[F.first(c).alias(c) for c in kept])
    back = F.transform("o", lambda x, i: F.coalesce((i > 0) & (x["oi"] < F.get("o", i - 1)["oi"]), F.lit(False)))
    return rows.select(key, "part_idx", "short", "ratio_level", F.col("special_missing").alias("special"), "ratio_median", F.size(F.filter(back, lambda x: x)).alias("jumps"), *kept)


def part_checks(src: DataFrame, out: DataFrame, pairs: DataFrame, key: str = "source", bands: RatioBands = RatioBands(), lang: str = "") -> DataFrame:
    """One row a part: the level of every check (0 pass, 1 warn, 2 fail; null where an empty counterpart leaves it open)."""
    on = [key, "part_idx"]
    rows = src.groupBy(*on).agg(F.count("*").alias("n_src"), F.sum(F.length(T.strip(F.col("text")))).alias("src_chars"))
    rows = rows.join(part_lines(out, key, lang), on, "left").join(part_pairs(pairs, key, bands), on, "left").na.fill(0, ["n_out"])
    return _levels(rows, on, bands)


def beside(src: DataFrame, out: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, side, i, x): src's units (side 0) and out's lines (side 1) by their place in the part."""
    a = src.select(key, "part_idx", F.lit(0).alias("side"), F.col("index").alias("i"), F.col("text").alias("x"))
    return a.unionByName(out.select(key, "part_idx", F.lit(1).alias("side"), F.col("oi").alias("i"), F.col("line").alias("x")))


def part_texts(rows: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, ss, ts) of every part with units: its stripped units and its lines in order, from rows as `beside` gives them."""
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("i", "x")))), lambda r: T.strip(r["x"]) if k == 0 else r["x"])
    return rows.groupBy(key, "part_idx").agg(side(0).alias("ss"), side(1).alias("ts")).where("size(ss) > 0")


@F.pandas_udf(ArrayType(StructType([StructField("si", IntegerType()), StructField("oi", IntegerType())])))
def _places(ss: pd.Series, ts: pd.Series) -> pd.Series:
    """align_sequences of the rows that are not null."""
    return pd.Series([None if s is None else [{"si": i, "oi": j} for i, j in align_sequences(list(s), list(t))] for s, t in zip(ss, ts)], dtype=object)


def with_pairs(texts: DataFrame, align: bool = True) -> DataFrame:
    """part_texts' rows with pairs, an array of (si, oi, s, t): by position where counts are equal, else by sequence alignment;
    without align, the parts with equal counts only."""
    even = F.transform("ss", lambda s, i: F.struct((i + 1).alias("si"), (i + 1).alias("oi"), s.alias("s"), F.get("ts", i).alias("t")))
    same = F.size("ss") == F.size("ts")
    if not align:
        return texts.where(same).withColumn("pairs", even)
    # only parts whose counts differ reach Python with their texts
    rows = texts.withColumn("at", _places(F.when(~same, F.col("ss")), F.when(~same, F.col("ts"))))
    odd = F.transform("at", lambda p: F.struct(p["si"].alias("si"), p["oi"].alias("oi"), F.get("ss", p["si"] - 1).alias("s"), F.get("ts", p["oi"] - 1).alias("t")))
    return rows.withColumn("pairs", F.when(same, even).otherwise(odd)).drop("at")


def pairs_of(texts: DataFrame, align: bool = True, key: str = "source") -> DataFrame:
    """(key, part_idx, si, oi, s, t): zip_pairs and, with align, misaligned_pairs of part_texts' rows, without another exchange."""
    return with_pairs(texts, align).select(key, "part_idx", F.inline("pairs"))


def text_checks(texts: DataFrame, align: bool = True, key: str = "source", bands: RatioBands = RatioBands(), lang: str = "") -> DataFrame:
    """part_checks of part_texts' rows with the pairs of with_pairs. The rows are read once, and what a part needs is all in its row,
    so nothing is joined or dealt again."""
    on = [key, "part_idx"]
    chars = F.aggregate("ss", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.length(x), F.lit(0)))
    rows = with_pairs(texts, align).select(*on, "ts", "pairs", F.size("ss").cast("long").alias("n_src"), chars.alias("src_chars"))
    facts = ("n_src", "src_chars", "n_out", "out_chars", "marked", "residue", "n_adjacent", "n_blocks", "n_repeated")
    rows = _line_facts(rows, "ts", lang, *on, "pairs", "n_src", "src_chars")
    return _levels(part_pairs(rows.select(*on, *facts, F.inline("pairs")), key, bands, facts), on, bands)


def _levels(rows: DataFrame, on: list[str], bands: RatioBands) -> DataFrame:
    full = F.col("n_out") > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    only = lambda c: F.when(full, c)
    delta = F.abs(F.col("n_out") - F.col("n_src")) / F.greatest("n_src", F.lit(1))
    repeated = zero("n_repeated") / F.greatest(zero("n_blocks"), F.lit(1))
    ratio = F.when(F.col("src_chars") > 0, zero("out_chars") / F.col("src_chars")).otherwise(F.lit(0.0))
    rows = rows.select(
        *on, F.col("n_src"), F.col("n_out").cast("long").alias("n_out"),
        F.when(full, 0).otherwise(FAIL).alias("v9"),
        only(F.when(F.col("n_src") == F.col("n_out"), 0).when(delta > 0.10, FAIL).otherwise(WARN)).alias("v10a"),
        only(F.when(zero("jumps") > 0, FAIL).otherwise(0)).alias("v10b"),
        only(zero("short") * FAIL).alias("v10c"),
        only(zero("ratio_level")).alias("v10d"),
        only(F.when((zero("n_adjacent") > 0) | (repeated > REPEAT_MAX), FAIL).otherwise(0)).alias("v10e"),
        only(F.greatest(zero("marked"), zero("residue")) * FAIL).alias("v11"),
        only(zero("special") * FAIL).alias("v12"),
        only(F.when((ratio < bands.part_warn_low) | (ratio > bands.part_warn_high), WARN).otherwise(0)).alias("part_ratio_level"),
        only(ratio).alias("ratio"), "ratio_median",
    )
    return rows.withColumn("level", F.greatest("v9", "v10a", "v10b", "v10c", "v10d", "v10e", "v11", "v12", "part_ratio_level"))


def with_bands(rows: DataFrame, stored: DataFrame, key: str = "source", defaults: RatioBands = RatioBands()) -> tuple[DataFrame, RatioBands]:
    """rows and the bands to check them by: a key's stored bands where it has them, else the defaults, value by value."""
    names = [f.name for f in dataclasses.fields(RatioBands)]
    had = [n for n in names if n in stored.columns]
    rows = rows.join(stored.select(key, *[F.col(n).alias(f"band_{n}") for n in had]), key, "left")
    return rows, RatioBands(**{n: F.coalesce(F.col(f"band_{n}"), F.lit(getattr(defaults, n))) if n in had else getattr(defaults, n) for n in names})


def calibrated(pairs: DataFrame, key: str = "source", bands: RatioBands = RatioBands(), least: int = 30) -> DataFrame:
    """Bands per key from its pairs of at least 8 characters: from nearest-rank p1 and p99, only ever wider than bands."""
    rows = pairs.where("s is not null and t is not null and length(s) >= 8").select(key, (F.length("t") / F.length("s")).alias("r"))
    # nearest rank from counts of equal ratios, so no group's values meet in one array
    w = Window.partitionBy(key).orderBy("r")
    hist = rows.groupBy(key, "r").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(w))
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.median("r").alias("median"))
    at = lambda q: F.least(F.greatest(F.bround((F.col("n") - 1) * q, 0), F.lit(0)), F.col("n") - 1).cast("long") + 1
    rank = lambda q: F.min(F.when(F.col("upto") >= at(q), F.col("r")))
    got = hist.join(n, key).groupBy(key, "n", "median").agg(rank(0.01).alias("p1"), rank(0.99).alias("p99"))
    enough = F.col("n") >= least
    wider = lambda pick, own, default: F.when(enough, F.round(pick(own, F.lit(default)), 3)).otherwise(F.lit(default))
    return got.select(
        key, "n", "median", "p1", "p99",
        wider(F.least, F.col("p1"), bands.unit_warn_low).alias("warn_low"), wider(F.greatest, F.col("p99"), bands.unit_warn_high).alias("warn_high"),
        wider(F.least, F.col("p1") * 0.8, bands.unit_fail_low).alias("fail_low"), wider(F.greatest, F.col("p99") * 1.3, bands.unit_fail_high).alias("fail_high"),
    )
