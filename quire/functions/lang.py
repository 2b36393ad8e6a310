"""Languages and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

#: Codes of simplified and traditional Chinese, and languages' names in prompts.
ZH_HANS = ("zh", "zh-cn", "zh-hans", "zh-chs", "zh-hans-cn")
ZH_HANT = ("zh-tw", "zh-hk", "zh-mo", "zh-hant", "zh-cht", "zh-hant-tw", "zh-hant-hk")
NAMES = {
    "ja": "日语", "zh": "中文", "zh-cn": "简体中文", "zh-hans": "简体中文", "zh-tw": "繁体中文", "zh-hant": "繁体中文",
    "en": "英语", "ko": "韩语", "fr": "法语", "de": "德语", "es": "西班牙语", "ru": "俄语", "it": "意大利语",
    "pt": "葡萄牙语", "nl": "荷兰语", "pl": "波兰语", "th": "泰语", "vi": "越南语",
}
TITLE_MAX = 80


def norm_lang(code: Column) -> Column:
    """The key under which a language's handlers are found; empty for none."""
    x = F.replace(F.lower(T.strip(F.coalesce(code, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(x.isin(*ZH_HANS), "zh-hans").when(x.isin(*ZH_HANT), "zh-hant").otherwise(F.split_part(x, F.lit("-"), F.lit(1)))


def lang_pair(source: Column, target: Column) -> Column:
    """The pair of keys under which a pair of languages is registered."""
    return F.struct(norm_lang(source).alias("source_lang"), norm_lang(target).alias("target_lang"))


def lang_name(code: Column, explicit: Column, default: str) -> Column:
    """An explicit name, else the known name of the code, else the code, else the default."""
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    given = F.nullif(T.strip(F.coalesce(explicit, F.lit(""))), F.lit(""))
    key = F.nullif(F.lower(T.strip(F.coalesce(code, F.lit("")))), F.lit(""))
    return F.coalesce(given, F.try_element_at(known, key), key, F.lit(default))


def sanitize_title(raw: Column) -> Column:
    """A title as the stem of a file name; null if nothing is left."""
    x = T.strip(raw)
    x = F.when(F.lower(x).endswith(".txt"), T.strip(F.regexp_replace(x, "(?i)\\.txt\\z", ""))).otherwise(x)
    x = F.regexp_replace(x, "[\\x00-\\x1f\\x7f]", "")
    x = F.regexp_replace(x, '[\\\\/:*?"<>|]', "_")
    x = T.strip(F.regexp_replace(x, f"[{T.SPACE}]+", " "))
    tail = lambda c: T.strip(F.regexp_replace(c, "[. ]+\\z", ""))
    x = tail(x)
    x = F.when(F.length(x) > TITLE_MAX, tail(F.left(x, F.lit(TITLE_MAX)))).otherwise(x)
    return F.nullif(x, F.lit(""))


def out_name(title: Column, source_stem: Column) -> Column:
    """The file of the result: the title's, unless there is none or it is the source itself."""
    clean = sanitize_title(title)
    return F.when(clean.isNotNull() & (clean != source_stem), F.concat(clean, F.lit(".txt"))).otherwise(F.concat(source_stem, F.lit("_translated.txt")))
