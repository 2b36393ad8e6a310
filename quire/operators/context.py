"""Context for a part: note sections and glossary terms that occur in it, under a budget of characters.

sections: (file, prio, ord, heading, body); terms: (src_term, tgt_term); parts: (key, part_idx, text). All keys of sections
and terms are looked for in one pass over the parts, by an automaton over them, while they are at most NEEDLES of
NEEDLE_CHARS characters together, which is counted first. More of them meet the parts by an equi-join on their first
characters. Neither way compares every part with every key.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.config import ContextLimits
from quire.functions import text as T
from quire.operators.pieces import FLUSH_CHARS

#: Note files by priority, header words of term tables, and separators of table heads.
FILES = ("characters.md", "terms.md", "locations.md", "relationships.md", "timeline.md", "facts.md")
HEADER_WORDS = ("原文", "原文词", "源语言", "源文", "术语", "词条", "外文", "外语", "日文", "source", "original", "term", "word")
RULES = ("---", ":---", "---:", ":--", "--:")


def md_sections(files: DataFrame) -> DataFrame:
    """files(file, text) to (file, prio, ord, heading, body): one row a '## ' section; text before the first has heading ''."""
    rows = files.where(F.col("file").isin(*FILES)).select("file", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    note = F.col("line").startswith("> ") & T.strip(F.regexp_replace("line", "^[> ]+", "")).startswith("仅记录")
    head = F.col("line").startswith("## ")
    w = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(head | ~note).withColumn("ord", F.sum(head.cast("int")).over(w).cast("int"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    title = F.max(F.when(head, T.strip(F.substr("line", F.lit(4)))))
    prio = F.array_position(F.array(*[F.lit(f) for f in FILES]), F.col("file")).cast("int") - 1
    return rows.groupBy("file", "ord").agg(F.coalesce(title, F.lit("")).alias("heading"), T.strip(ordered).alias("body")).select("file", prio.alias("prio"), "ord", "heading", "body")


def md_terms(sections: DataFrame) -> DataFrame:
    """(ord, ln, src_term, tgt_term) of the pipe tables in terms.md's sections."""
    rows = sections.where("file = 'terms.md'").select("ord", F.posexplode(F.split("body", "\n", -1)).alias("ln", "line")).where(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+\z", ""), r"\|", -1), T.strip)
    rows = rows.withColumn("c", cells).where((F.size("c") >= 2) & (F.col("c")[0] != ""))
    rows = rows.where(~F.lower(F.col("c")[0]).isin(*HEADER_WORDS) & (F.size(F.array_except("c", F.array(*[F.lit(r) for r in RULES]))) > 0))
    return rows.select("ord", "ln", F.col("c")[0].alias("src_term"), F.col("c")[1].alias("tgt_term"))


_NOT_HAN = re.compile(T.NOT_HAN)

#: What tasks take as an automaton at most; length of the prefixes that join beyond it.
NEEDLES, NEEDLE_CHARS, PREFIX = 100_000, 8_000_000, 4


def _few(needles: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The distinct needles(k), and as a list if they are few enough for an automaton."""
    names = needles.select("k").where("k <> ''").distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("k")), F.lit(0)).alias("chars")).first()
    if size.n <= NEEDLES and size.chars <= NEEDLE_CHARS:
        try:
            import ahocorasick  # noqa: F401

            return names, [r.k for r in names.collect()]
        except ImportError:
            pass
    return names, None


def _hay(parts: DataFrame, key: str, *more: str) -> DataFrame:
    return parts.select(key, "part_idx", F.col("text").cast("string").alias("text"), *more)


def occurring(parts: DataFrame, needles: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, k, in_han): which needles(k) occur in a part's text, and (in_han) which in its Han projection."""
    names, few = _few(needles)
    hay = _hay(parts, key)
    return _by_prefix(hay, names, key) if few is None else _by_automaton(hay, few, key)


def occurring_by_part(parts: DataFrame, needles: DataFrame, key: str = "source") -> DataFrame:
    """parts, every part a row, with what occurring finds in it as arrays in_text and in_han in the place of text."""
    names, few = _few(needles)
    more = [c for c in parts.columns if c not in (key, "part_idx", "text")]
    if few is None:
        found = _by_prefix(_hay(parts, key), names, key).groupBy(key, "part_idx")
        found = found.agg(*[F.collect_set(F.when(F.col("in_han") == han, F.col("k"))).alias(name) for name, han in (("in_text", False), ("in_han", True))])
        none = F.array().cast("array<string>")
        rows = parts.drop("text").join(found, [key, "part_idx"], "left")
        return rows.select(key, "part_idx", *more, *[F.coalesce(n, none).alias(n) for n in ("in_text", "in_han")])
    hay = _hay(parts, key, *more)

    def run(it):
        find = _automaton(few)
        lists, names = pa.list_(pa.string()), [key, "part_idx", *more, "in_text", "in_han"]

        def made(part, found):
            return pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != 2] + [pa.array(x, lists) for x in found], names)

        for batch in it:
            first, size, found = 0, 0, ([], [])
            for at in range(batch.num_rows):
                for kept, some in zip(found, find(batch.column(2)[at].as_py())):
                    kept.append([few[i] for i in some])
                    size += sum(map(len, kept[-1]))
                if size >= FLUSH_CHARS:
                    yield made(batch.slice(first, at + 1 - first), found)
                    first, size, found = at + 1, 0, ([], [])
            if first < batch.num_rows:
                yield made(batch.slice(first), found)

    kinds = [hay.schema[c] for c in (key, "part_idx", *more)]
    return hay.mapInArrow(run, StructType([*kinds, *[StructField(n, ArrayType(StringType())) for n in ("in_text", "in_han")]]))


def _automaton(names: list[str]):
    """A function that gives the numbers of the names in a text, and of those in its Han projection."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for i, k in enumerate(names):
        words.add_word(k, i)
    words.make_automaton()
    find = lambda text: sorted({i for _, i in words.iter(text)}) if text and names else []
    return lambda text: (find(text), find(_NOT_HAN.sub("", text or "")))


def _by_automaton(hay: DataFrame, names: list[str], key: str) -> DataFrame:
    kind = hay.schema[key].dataType.simpleString()

    def run(it):
        find = _automaton(names)
        for batch in it:
            for at in range(batch.num_rows):
                for in_han, found in zip((False, True), find(batch.column(2)[at].as_py())):
                    if found:
                        part, n = batch.slice(at, 1), len(found)
                        same = pa.array([0] * n)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(same), part.column(1).take(same), pa.array([names[i] for i in found]), pa.array([in_han] * n)], [key, "part_idx", "k", "in_han"])

    return hay.mapInArrow(run, f"{key} {kind}, part_idx int, k string, in_han boolean")


def _by_prefix(hay: DataFrame, names: DataFrame, key: str) -> DataFrame:
    out, hay = None, hay.withColumn("han", T.han_only(F.col("text")))
    for in_han, column in ((False, "text"), (True, "han")):
        for size in range(1, PREFIX + 1):
            grams = F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
            some = names.where(F.length("k") == size) if size < PREFIX else names.where(F.length("k") >= size)
            rows = hay.select(key, "part_idx", F.explode(grams).alias("gram")).join(some.select("k", F.left("k", F.lit(size)).alias("gram")), "gram")
            rows = rows.join(hay.select(key, "part_idx", F.col(column).alias("whole")), [key, "part_idx"]).where(F.contains("whole", "k"))
            rows = rows.select(key, "part_idx", "k", F.lit(in_han).alias("in_han"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _bare(heading: Column) -> Column:
    return F.split_part(F.split_part(heading, F.lit("（"), F.lit(1)), F.lit("("), F.lit(1))


def context_hits(parts: DataFrame, sections: DataFrame, terms: DataFrame | None = None, key: str = "source") -> DataFrame:
    """(key, part_idx, file, prio, ord, heading, body) of the sections whose heading, its part before a bracket, or for
    terms.md any source term, occurs in the part or in its Han projection."""
    base = sections.where("heading <> ''")
    keys = base.select("file", "ord", F.explode(F.array_distinct(F.array("heading", _bare(F.col("heading"))))).alias("k"))
    if terms is not None:
        # a term stands for all sections of terms.md at once; they are joined by file below
        keys = keys.unionByName(terms.select(F.lit("terms.md").alias("file"), F.lit(None).cast("int").alias("ord"), F.col("src_term").alias("k")))
    found = occurring(parts, keys, key).join(keys.distinct(), "k").select(key, "part_idx", "file", "ord").distinct()
    whole = base.select("file", "prio", "ord", "heading", "body")
    one = found.where("ord is not null").join(whole, ["file", "ord"])
    every = found.where("ord is null").drop("ord").join(whole, "file")
    out = one.select(key, "part_idx", "file", "prio", "ord", "heading", "body")
    return out if terms is None else out.unionByName(every.select(*out.columns)).distinct()


def gloss_hits(parts: DataFrame, terms: DataFrame, key: str = "source") -> DataFrame:
    """(key, part_idx, src_term, tgt_term) of the terms that occur in a part, or whose Han characters occur in its Han projection."""
    t = terms.where("src_term <> ''").select("src_term", "tgt_term")
    keys = t.select("src_term", "tgt_term", F.col("src_term").alias("k"), F.lit(False).alias("in_han"))
    keys = keys.unionByName(t.select("src_term", "tgt_term", T.han_only(F.col("src_term")).alias("k"), F.lit(True).alias("in_han"))).where("k <> ''")
    keys = keys.groupBy("src_term", "tgt_term", "k", "in_han").agg(F.count("*").alias("copies"))
    found = occurring(parts, keys, key).join(keys, ["k", "in_han"]).groupBy(key, "part_idx", "src_term", "tgt_term").agg(F.max("copies").alias("copies"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(key, "part_idx", "src_term", "tgt_term")


def within_budget(hits: DataFrame, key: str = "source", budget: int = ContextLimits.budget) -> DataFrame:
    """The sections chosen of each part by (prio, ord): one that would exceed the budget is skipped, later smaller ones may fit; the first is always taken."""
    items = F.array_sort(F.collect_list(F.struct("prio", "ord", F.length("body").alias("n"), "heading")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("chosen"))

    def step(acc, x):
        fits = (acc["used"] + x["n"] <= budget) | (F.size(acc["chosen"]) == 0)
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["chosen"], F.array(x["heading"])).alias("chosen"))).otherwise(acc)

    rows = hits.groupBy(key, "part_idx").agg(F.count("*").alias("n_hits"), F.aggregate(items, start, step).alias("r"))
    return rows.select(key, "part_idx", "n_hits", F.col("r.used").alias("used"), F.size("r.chosen").alias("n_chosen"), F.array_join("r.chosen", "|").alias("headings"))


def prev_tails(parts: DataFrame, outputs: DataFrame | None = None, key: str = "source", limits: ContextLimits = ContextLimits()) -> DataFrame:
    """(key, part_idx, raw_tail, translation_tail): the ends of the part before, raw and translated (null without)."""
    w = Window.partitionBy(key).orderBy("part_idx")
    rows = parts.select(key, "part_idx", F.right("text", F.lit(limits.raw_tail)).alias("r"))
    if outputs is not None:
        rows = rows.join(outputs.select(key, "part_idx", F.right("text", F.lit(limits.translation_tail)).alias("t")), [key, "part_idx"], "left")
    else:
        rows = rows.withColumn("t", F.lit(None).cast("string"))
    return rows.select(key, "part_idx", F.lag("r").over(w).alias("raw_tail"), F.lag("t").over(w).alias("translation_tail"))


#: Heads of the context block's pieces; wording is our own.
TRANSLATED_HEAD = "[End of the previous part's translation: for names and tone only, do not output]"
RAW_HEAD = "[End of the previous part's source: for what goes on only, do not translate]"
NOTES_HEAD = "[Notes of this project: keep to them]"


def _chosen(items: Column, budget: int) -> Column:
    """The sections of a sorted list that fit, as text: one that would exceed the budget is skipped, the first is always taken."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("texts"))

    def step(acc, x):
        text = F.concat(F.lit("["), x["file"], F.lit("] "), x["heading"], F.lit("\n"), x["body"])
        fits = (acc["used"] + F.length(x["body"]) <= budget) | (F.size(acc["texts"]) == 0)
        return F.when(fits, F.struct((acc["used"] + F.length(x["body"])).alias("used"), F.concat(acc["texts"], F.array(text)).alias("texts"))).otherwise(acc)

    return F.aggregate(items, start, step)["texts"]


def _stands_for(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """(k, in_han, section, term, any_term): what a key found in a text or a Han projection stands for, one of the three a row."""
    base = sections.where("heading <> ''")
    whole = base.select("file", "ord", F.struct("prio", "ord", "file", "heading", "body").alias("section"))
    keys = base.select("file", "ord", F.explode(F.array_distinct(F.array("heading", _bare(F.col("heading"))))).alias("k")).distinct()
    # as in context_hits, a key without an ord stands for its whole file
    both = keys.where("ord is not null").join(whole, ["file", "ord"]).unionByName(keys.where("ord is null").join(whole.drop("ord"), "file"))
    either = F.explode(F.array(F.lit(False), F.lit(True))).alias("in_han")
    found = both.select("k", "section").distinct().select("k", either, "section")
    t = terms.where("src_term <> ''").groupBy("src_term", "tgt_term").agg(F.min("pos").alias("pos"))
    term = F.struct("pos", "src_term", "tgt_term").alias("term")
    named = t.where("tgt_term is not null")
    named = named.select(F.col("src_term").alias("k"), F.lit(False).alias("in_han"), term).unionByName(named.select(T.han_only(F.col("src_term")).alias("k"), F.lit(True).alias("in_han"), term))
    some = t.select(F.col("src_term").alias("k")).distinct().select("k", either, F.lit(True).alias("any_term"))
    return found.unionByName(named, True).unionByName(some, True).where("k <> ''")


def context_block(parts: DataFrame, sections: DataFrame, terms: DataFrame, outputs: DataFrame | None = None, key: str = "source", limits: ContextLimits = ContextLimits()) -> DataFrame:
    """(key, part_idx, context, hits) of parts(key, part_idx, text): the tails of the part before, the sections that occur under the
    budget, and the first terms(pos, src_term, tgt_term) that occur; hits names what occurs, chosen or not. The parts are read once: a
    part's row keeps its tails and what occurs in it, and the text goes. They are dealt out by part first, so long texts spread."""
    on = [key, "part_idx"]
    rows = parts.where(F.col(key).isNotNull() & F.col("part_idx").isNotNull())
    rows = rows.select(*on, "text", F.right("text", F.lit(limits.raw_tail)).alias("r")).repartition(*on)
    keys = _stands_for(sections, terms)
    rows = occurring_by_part(rows, keys, key)
    if outputs is not None:
        rows = rows.join(outputs.select(*on, F.right("text", F.lit(limits.translation_tail)).alias("t")), on, "left")
    else:
        rows = rows.withColumn("t", F.lit(None).cast("string"))
    w = Window.partitionBy(key).orderBy("part_idx")
    rows = rows.select(*on, "in_text", "in_han", F.lag("r").over(w).alias("raw_tail"), F.lag("t").over(w).alias("translation_tail")).repartition(*on)
    k = lambda name, in_han: F.transform(name, lambda x: F.struct(x.alias("k"), F.lit(in_han).alias("in_han")))
    rows = rows.select(*on, "raw_tail", "translation_tail", F.posexplode_outer(F.concat(k("in_text", False), k("in_han", True))).alias("i", "x"))
    # the tails go along with a part's first key only
    once = lambda name: F.when(F.coalesce("i", F.lit(0)) == 0, F.col(name)).alias(name)
    rows = rows.select(*on, once("raw_tail"), once("translation_tail"), "x.k", "x.in_han").join(keys, ["k", "in_han"], "left")
    rows = rows.groupBy(*on).agg(
        F.max("raw_tail").alias("raw_tail"), F.max("translation_tail").alias("translation_tail"), F.collect_set("section").alias("sections"), F.collect_set("term").alias("terms"),
        F.coalesce(F.bool_or("any_term"), F.lit(False)).alias("any_term"),
    )
    every = sections.where("heading <> '' and file = 'terms.md'").agg(F.collect_set(F.struct("prio", "ord", "file", "heading", "body")).alias("every"))
    rows = rows.crossJoin(F.broadcast(every))
    items = F.array_sort(F.when(F.col("any_term"), F.array_union("sections", "every")).otherwise(F.col("sections")))
    rows = rows.select(*on, "raw_tail", "translation_tail", items.alias("items"), F.array_sort("terms").alias("terms"))
    listed = F.transform(F.slice("terms", 1, limits.glossary), lambda x: F.concat(x["src_term"], F.lit(" → "), x["tgt_term"]))
    gloss = F.when(F.size("terms") > 0, F.concat(F.lit("[terms.md] terms\n"), F.array_join(listed, "\n")))
    notes = F.array_join(F.concat(_chosen(F.col("items"), limits.budget), F.array_compact(F.array(gloss))), "\n\n")
    piece = lambda head, text: F.when(text.isNotNull() & (text != ""), F.concat(F.lit(head + "\n"), text))
    block = F.array_compact(F.array(piece(TRANSLATED_HEAD, F.col("translation_tail")), piece(RAW_HEAD, F.col("raw_tail")), piece(NOTES_HEAD, notes)))
    hits = F.concat(F.transform("items", lambda x: F.concat(x["file"], F.lit("::"), x["heading"])), F.when(F.size("terms") > 0, F.array(F.lit("terms.md::terms"))).otherwise(F.array().cast("array<string>")))
    return rows.select(*on, F.array_join(block, "\n\n").alias("context"), hits.alias("hits"))
