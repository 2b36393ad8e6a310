"""Small hand-written inputs for what the driver's tables do not hold; queries and their SQL share them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = [
    (1, "以下是：\n\n  First line \n```text\nSecond\r\nThird\r\n```\n"), (2, "Sure\nSure thing\nHere is:\n\n"), (3, "译文如下：\n　一行　\n\n二行"), (4, ""), (5, "   \n\n"),
    (6, "```\n```py3\nonly\n"), (7, "Note: kept as it goes on\nNote:\n好的，\nend"),
]
MARKED = [
    (1, "```python"), (2, " - [p12] text"), (3, "see [p001] here"), (4, "[part_12]"), (5, "[part3] x"), (6, "译文：abc"), (7, "以下是 翻译: x"), (8, "x（以下略）"), (9, "[未翻译]"),
    (10, "第 12 部分"), (11, "# head"), (12, "####### seven"), (13, "plain"), (14, "#nospace"), (15, "第三部分"),
]
KANA = [(1, "すべて かな"), (2, "漢字だけ漢字漢字漢字漢"), (3, "abc"), (4, ""), (5, "かなあ" + "漢" * 17), (6, "かなあい" + "漢" * 16), (7, " 　\n")]
NOTES = [
    ("characters.md", "# People\n\n> 仅记录人物\nintro\n## 田中（主角）\nbody one\nbody two\n\n## Bob (friend)\n> 仅记录 other\n> kept quote\nlast"),
    ("terms.md", "| 原文 | 译文 |\n|---|---|\n## 术语\n| 原文 | 译文 | 备注 |\n| --- | --- | --- |\n| 東京 | 东京 | city |\n|| empty |\n| only |\n| Term | skip |\n|  大阪  | 大坂 |\nnot a row\n## 空\n"),
    ("conflicts.md", "## never\nx"),
    ("facts.md", "no heading at all"),
]
QUOTES = [
    (1, "「彼は『行く』と言った」", "“他说『去』。”"), (2, "『本日は晴天なり』", "“今天是晴天”"), (3, "『本日』は長い説明の中にある言葉", "“今天”是词"), (4, "「はい」", "「是」"), (5, "普通の行", "普通「行」"),
    (6, "『題』", "《题》"), (7, "『二つ』", "“一”“二”"), (8, "x", "y"), (9, "「外『内』」", "「外『内』」"),
]
LANGS = [(1, "ja-JP"), (2, "zh"), (3, "zh_CN"), (4, "zh-Hant"), (5, "zh-MO"), (6, "EN"), (7, ""), (8, None), (9, " fr "), (10, "pt-BR"), (11, "ko"), (12, "zh-sg"), (13, "xx")]
TITLES = [
    (1, "x.txt"), (2, "a/b:c"), (3, "  spaced   out  "), (4, "dots... "), (5, "n" * 100), (6, ""), (7, None), (8, "   "), (9, "new\nline\ttab"), (10, "x.TXT"), (11, 'q"<>|?*\\'), (12, "y" * 78 + ". z"), (13, "..."),
]
GLOSS_TEXTS = [("a", 1, "樋ひ藤とうさんは東京へ"), ("a", 2, "Alice went home"), ("b", 1, "大阪")]
TERMS = [("樋藤", "Hito"), ("Alice", "爱丽丝"), ("東京", "东京"), ("Bob", "鲍勃")]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
