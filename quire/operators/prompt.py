"""Prompts per part, and a pluggable model transport."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.lang import lang_name, out_name, sanitize_title

RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
TRIES = 3


def max_tokens(chars: Column) -> Column:
    """1.6 tokens a character, from 4096 to 32000."""
    return F.least(F.greatest(F.floor(chars * 1.6), F.lit(4096)), F.lit(32000)).cast("int")


def blocks(code: Column, genre: Column) -> Column:
    """Names of the parts of the system prompt: head, and as the language and genre ask, readings, registers, genre."""
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return F.array_compact(F.array(F.lit("head"), F.when(c.startswith("ja"), "ruby"), F.when(c.startswith("ja") | c.startswith("ko"), "keigo"), F.when(F.trim(F.coalesce(genre, F.lit(""))) != "", "genre")))


HEAD = (
    "You translate fiction from {src} to {tgt}. Translate the given text completely and faithfully: add, drop, merge or reorder nothing. "
    "Keep to the established names and terms. Output only the translation, one line for every source line, in the same order; "
    "lines of symbols keep a line of their own."
)
BLOCKS = {
    "head": HEAD,
    "ruby": "Readings inlined after characters are pronunciation, not text: translate the word once and never repeat it.",
    "keigo": "Differences of politeness and register must show in {tgt}.",
    "genre": "Genre: {genre}. Follow its conventions and reveal nothing before the text does.",
}


def system_prompt(code: Column, src_name: Column, tgt_code: Column, tgt_name: Column, genre: Column) -> Column:
    src, tgt = lang_name(code, src_name, "the source language"), lang_name(tgt_code, tgt_name, "the target language")
    names = blocks(code, genre)
    texts = F.create_map(*[F.lit(x) for pair in BLOCKS.items() for x in pair])
    joined = F.array_join(F.transform(names, lambda n: F.element_at(texts, n)), "\n\n")
    for name, value in (("{src}", src), ("{tgt}", tgt), ("{genre}", F.trim(F.coalesce(genre, F.lit(""))))):
        joined = F.replace(joined, F.lit(name), value)
    return joined


def user_prompt(part_id: Column, label: Column, n_lines: Column, text: Column, context: Column) -> Column:
    head = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("part: "), part_id, F.lit("\nchapter: "), label, F.lit("\nlines: "), n_lines.cast("string"), F.lit("\n\n"), text)


TITLE_PROMPT = "You translate titles of fiction from {src} to {tgt}. Answer with the translated title alone, without quotation marks or comment."


def title_prompt(code: Column, src_name: Column, tgt_code: Column, tgt_name: Column) -> Column:
    src, tgt = lang_name(code, src_name, "the source language"), lang_name(tgt_code, tgt_name, "the target language")
    return F.replace(F.replace(F.lit(TITLE_PROMPT), F.lit("{src}"), src), F.lit("{tgt}"), tgt)


def percent(x: Column) -> Column:
    """A share as a percentage of one decimal, for messages."""
    return F.format_string("%.1f%%", x * 100)


def claim_token() -> Column:
    """A token no other claim has."""
    return F.uuid()


Client = Callable[[str, str, int], tuple[str, str]]


class Retry(Exception):
    """A transport failure worth another try."""


def call(client: Client, system: str, user: str, tokens: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str]:
    """(text, finish) of a client, with growing pauses between tries; (None, error) after the last."""
    error = ""
    for k in range(TRIES):
        try:
            return client(system, user, tokens)
        except Retry as e:
            error = str(e)
            if k + 1 < TRIES:
                sleep(2**k * 5 + random.uniform(0, 3))
    return None, f"error: {error}"


def translate(prompts: DataFrame, client: Client, key: str = "source") -> DataFrame:
    """(key, part_idx, text, finish) of prompts(key, part_idx, system, user, max_tokens), row by row on the workers. A part's
    prompt holds the end of the one before, so a caller sends the k-th parts of all texts together, one wave at a time."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(it) -> Iterator:
        import pandas as pd

        for pdf in it:
            got = [call(client, s, u, int(n)) for s, u, n in zip(pdf["system"], pdf["user"], pdf["max_tokens"])]
            yield pd.DataFrame({key: pdf[key], "part_idx": pdf["part_idx"], "text": [g[0] for g in got], "finish": [g[1] for g in got]})

    return prompts.select(key, "part_idx", "system", "user", "max_tokens").mapInPandas(run, f"{key} {kind}, part_idx int, text string, finish string")


def translate_titles(titles: DataFrame, client: Client, key: str = "source", tokens: int = 200) -> DataFrame:
    """(key, title, file) of titles(key, raw, system): the model's title as a file's stem, and the file's name; without an answer
    that leaves something, title is null and the name falls back to the key's."""
    rows = titles.select(key, F.lit(1).alias("part_idx"), "system", F.col("raw").alias("user"), F.lit(tokens).alias("max_tokens"))
    got = translate(rows, client, key).select(key, sanitize_title(F.split_part(T.strip(F.col("text")), F.lit("\n"), F.lit(1))).alias("title"))
    return got.select(key, "title", out_name(F.col("title"), F.col(key).cast("string")).alias("file"))
