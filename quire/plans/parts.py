"""Size-bounded parts: at each step the strongest boundary within reach, however early it lies.

Planning is a fold over one text, so it runs in Arrow workers; everything after it is relational. A text of one row needs no
shuffle for it. A text in pieces is read piece by piece: a cut depends on the next hard_max characters only, so a worker
holds those and a piece, and can hand on the parts' texts as they are cut. Levels, in the order they are tried: STRONG, MID, PARA (within target_max), SENT (the last sentence mark
within hard_max, with the marks and spaces after it), LINE (the last line start, or the end, within hard_max), FORCED.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.config import PartLimits
from quire.functions import text as T
from quire.operators import pieces

_MARK = re.compile("[" + re.escape(T.SENTENCE_END) + "]")
_LINE = re.compile(r"[^\n]+")
_SKIP = frozenset(T.TRAIL_SKIP)
SCHEMA = "part_idx int, start_char long, end_char long, forced_cut boolean, cut_level string"


def _last_sentence(text: str, start: int, stop: int) -> int | None:
    """Where the last sentence of text[start:stop] ends, looking backwards in growing stretches."""
    width = 256
    while True:
        lo = max(start, stop - width)
        marks = [m.end() for m in _MARK.finditer(text, lo, stop)]
        if marks:
            end = marks[-1]
            while end < stop and text[end] in _SKIP:
                end += 1
            return end
        if lo == start:
            return None
        width *= 4


class Planner:
    """Cuts a text that comes in pieces: feed and finish give (start, end, forced, level, text) of its parts, which tile it.

    A part is cut once all lines that begin within its reach are complete. buf holds the text from base on, at is where the
    next part begins; every line up to scan is in the lists of starts.
    """

    def __init__(self, limits: PartLimits):
        self.limits, self.buf, self.base, self.at, self.scan = limits, "", 0, 0, 0
        self.levels = [("STRONG", limits.strong, []), ("MID", limits.mid, []), ("PARA", limits.para, [])]
        self.every: list[int] = []
        self.last_end: int | None = None
        self.began = False

    def _lines(self, stop: int) -> None:
        """Take in the lines up to stop, where one ends."""
        for m in _LINE.finditer(self.buf, self.scan - self.base, stop - self.base):
            start = m.start() + self.base
            blank = 0 if self.last_end is None or not self.began else start - self.last_end - 1
            self.last_end = m.end() + self.base
            if m.group().strip():
                self.began = True
                if start > 0:
                    self.every.append(start)
                    for _, level, found in self.levels:
                        if blank >= level:
                            found.append(start)
        self.scan = stop

    def _reach(self, found: list[int], cap: int) -> int | None:
        k = bisect_right(found, self.at + cap)
        return found[k - 1] if k and found[k - 1] > self.at else None

    def _cut(self, n: int | None) -> tuple[int, int, bool, str, str]:
        """The next part; n is the length of the text once it is known, and else beyond reach."""
        limits, at, end, level = self.limits, self.at, None, ""
        stop = at + limits.hard_max if n is None else min(at + limits.hard_max, n)
        for level, _, found in self.levels:
            end = self._reach(found, limits.target_max)
            if end is not None:
                break
        if end is None:
            end, level = _last_sentence(self.buf, at - self.base, stop - self.base), "SENT"
            end = None if end is None else end + self.base
            if end is not None and limits.strict_units and end != n:
                k = bisect_right(self.every, end)
                end = self.every[k - 1] if k and self.every[k - 1] > at else None
        if end is None:
            end, level = n if stop == n else self._reach(self.every, limits.hard_max), "LINE"
        if end is None:
            end, level = stop, "FORCED"
        self.at = end
        return at, end, level == "FORCED" and end != n, level, self.buf[at - self.base : end - self.base]

    def feed(self, text: str):
        self.buf, self.base = self.buf[self.at - self.base :] + text, self.at
        for found in (self.every, *[f for *_, f in self.levels]):
            del found[: bisect_right(found, self.at)]
        stop = self.buf.rfind("\n") + self.base
        if stop > self.scan:
            self._lines(stop)
        while self.at + self.limits.hard_max < self.scan:
            yield self._cut(None)

    def finish(self):
        n = self.base + len(self.buf)
        self._lines(n)
        while self.at < n:
            yield self._cut(n)


def greedy(text: str, limits: PartLimits) -> list[tuple[int, int, bool, str]]:
    """(start, end, forced, level) of parts that tile the text."""
    made = Planner(limits)
    return [p[:4] for p in (*made.feed(text), *made.finish())]


def absorb_small(parts: list[tuple], limits: PartLimits) -> list[tuple]:
    """Join a part under min_part to its neighbours while the result stays within target_max: the last part to the one
    before it, an inner one to both."""
    parts = list(parts)
    i = 1
    while len(parts) >= 2:
        s, e, f, level = parts[-1]
        if e - s < limits.min_part and e - parts[-2][0] <= limits.target_max:
            parts[-2:] = [(parts[-2][0], e, parts[-2][2] or f, level)]
            continue
        # neighbours only grow, so what did not fit before the last join does not fit now
        while i < len(parts) - 1:
            a, b, d = parts[i - 1 : i + 2]
            if b[1] - b[0] < limits.min_part and d[1] - a[0] <= limits.target_max:
                parts[i - 1 : i + 2] = [(a[0], d[1], a[2] or b[2] or d[2], d[3])]
                i = max(1, i - 1)
                break
            i += 1
        else:
            return parts
    return parts


class _Numbered:
    """A planner's parts in the columns of SCHEMA, with their texts if asked for; small ones are joined at the end."""

    def __init__(self, limits: PartLimits, merge_small: bool, with_text: bool):
        self.plan, self.limits, self.merge_small, self.with_text = Planner(limits), limits, merge_small, with_text
        self.kept: list[tuple] = []
        self.n = 0

    def _number(self, parts):
        for p in parts:
            self.n += 1
            yield (self.n, *(p if self.with_text else p[:4]))

    def feed(self, text: str):
        parts = self.plan.feed(text)
        if not self.merge_small:
            return self._number(parts)
        self.kept += [p[:4] for p in parts]
        return ()

    def finish(self):
        parts = self.plan.finish()
        if not self.merge_small:
            return self._number(parts)
        return self._number(absorb_small([*self.kept, *[p[:4] for p in parts]], self.limits))


class _Placed:
    """The units of a text that comes in pieces with the part each begins in: a unit waits until its part is cut."""

    FIELDS = f"part_idx int, index int, part_start long, before string, {pieces.Units.FIELDS}"

    def __init__(self, limits: PartLimits):
        self.plan, self.units = Planner(limits), pieces.Units()
        self.wait: deque[tuple] = deque()
        self.n, self.before = 0, None

    def _placed(self, parts):
        for start, end, *_ in parts:
            self.n += 1
            index = 0
            while self.wait and self.wait[0][2] < end:
                unit = self.wait.popleft()
                index += 1
                yield (self.n, index, start, self.before if index == 1 else None, *unit)
                self.before = unit[-1]

    def feed(self, text: str):
        # a part is cut after the lines that begin in it are complete, so its units are here
        self.wait.extend(self.units.feed(text))
        return self._placed(self.plan.feed(text))

    def finish(self):
        self.wait.extend(self.units.finish())
        return self._placed(self.plan.finish())


def _plan(texts: DataFrame, key: str, limits: PartLimits, merge_small: bool) -> DataFrame:
    if pieces.in_pieces(texts):
        return pieces.fold(texts, key, lambda: _Numbered(limits, merge_small, False), SCHEMA)
    kind = texts.schema[key].dataType

    def run(it):
        for batch in it:
            keys, rows = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = greedy(text or "", limits)
                parts = absorb_small(parts, limits) if merge_small else parts
                keys += [k] * len(parts)
                rows += [(i + 1, *p) for i, p in enumerate(parts)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            names = [key, "part_idx", "start_char", "end_char", "forced_cut", "cut_level"]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    return texts.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} {kind.simpleString()}, {SCHEMA}")


def plan_greedy(texts: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    """The parts before small ones are absorbed."""
    return _plan(texts, key, limits, False)


def plan_parts(texts: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    return _plan(texts, key, limits, True)


def _cut(key: str, names: list[str]):
    """(key, text, list of parts) to the parts with their texts; a text is read once, however many parts it has."""

    def run(it):
        for batch in it:
            cuts = batch.column(2)
            flat, owner = cuts.flatten(), pc.list_parent_indices(cuts)
            texts = batch.column(1).to_pylist()
            made = [(texts[i] or "")[a:b] for i, a, b in zip(owner.to_pylist(), flat.field("start_char").to_pylist(), flat.field("end_char").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *[flat.field(n) for n in names], pa.array(made, pa.string())], [key, *names, "text"])

    return run


def part_slices(texts: DataFrame, parts: DataFrame, key: str = "source") -> DataFrame:
    """parts with part_id, text, sizes, hash and tail_newlines, of texts of one row; those of a text in pieces come with its plan."""
    if pieces.in_pieces(texts):
        raise ValueError("texts in pieces are cut while they are planned: plan_slices")
    names = [n for n in parts.columns if n != key]
    cuts = parts.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("cuts"))
    rows = texts.select(key, F.col("text").cast("string").alias("text")).join(cuts, key)
    rows = rows.mapInArrow(_cut(key, names), StructType([rows.schema[key], *[parts.schema[n] for n in names], StructField("text", StringType())]))
    return _measured(rows, parts.columns)


def plan_slices(texts: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    """plan_greedy's parts with what part_slices adds, from one pass over texts in pieces; a text without a key has none."""
    rows = pieces.fold(texts.where(F.col(key).isNotNull()), key, lambda: _Numbered(limits, False, True), f"{SCHEMA}, text string")
    return _measured(rows, [n for n in rows.columns if n != "text"])


def _measured(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(
        *names, F.format_string("part_%03d", "part_idx").alias("part_id"), "text", F.length("text").alias("char_count"), F.octet_length("text").alias("byte_count"),
        T.sha256(F.col("text")).alias("sha256"), T.tail_newlines(F.col("text")).alias("tail_newlines"),
    )


def part_units(unit_rows: DataFrame, parts: DataFrame, key: str = "source") -> DataFrame:
    """Units with the part they begin in. Parts tile a text, so this is an as-of join: one sort, last part seen."""
    cuts = parts.select(key, F.col("start_char").alias("at"), F.lit(0).alias("kind"), F.col("part_idx").alias("p"), F.col("start_char").alias("p_start"))
    names = [c for c in unit_rows.columns if c != key]
    rows = unit_rows.select(key, F.col("start_char").alias("at"), F.lit(1).alias("kind"), F.struct(*names).alias("u"))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = cuts.unionByName(rows, allowMissingColumns=True)
    both = both.withColumn("part_idx", F.last("p", True).over(w)).withColumn("part_start", F.last("p_start", True).over(w)).where("kind = 1")
    rows = both.select(key, "part_idx", "part_start", "u.*")
    pidx = F.row_number().over(Window.partitionBy(key, "part_idx").orderBy("start_char"))
    return _in_part(rows.withColumn("index", pidx), key)


def plan_units(texts: DataFrame, key: str = "source", limits: PartLimits = PartLimits()) -> DataFrame:
    """part_units of plan_greedy's parts and, for the first of a part, before: the text of the unit before it. One pass over texts in
    pieces places the units, so no sort or join has to bring a text together again."""
    from quire.operators.units import measured

    rows = pieces.fold(texts, key, lambda: _Placed(limits), _Placed.FIELDS)
    return _in_part(measured(rows, F.col("sep"), key, "part_idx", "index", "part_start", "before"), key, "before")


def _in_part(rows: DataFrame, key: str, *more: str) -> DataFrame:
    rel = F.col("start_char") - F.col("part_start")
    return rows.select(
        key, "part_idx", F.format_string("part_%03d", "part_idx").alias("part_id"), F.format_string("part_%03d:p%03d", "part_idx", "index").alias("paragraph_id"), "index",
        rel.alias("rel_start"), (rel + F.col("char_count")).alias("rel_end"), F.col("start_char").alias("abs_start_char"), F.col("end_char").alias("abs_end_char"),
        "char_count", "sha256", "sep_newlines", "blank_before", "ln", "text", *more,
    )


def chapter_labels(units_in_parts: DataFrame, parts: DataFrame, key: str = "source", strong: int = 5) -> DataFrame:
    """(key, part_idx, chapter_label, first_heading, n_headings): a part's volume and its first three headings, or what it continues."""
    from quire.operators.units import is_heading

    t = T.strip(F.col("text"))
    w = Window.partitionBy(key).orderBy("abs_start_char").rowsBetween(Window.unboundedPreceding, 0)
    rows = units_in_parts.withColumn("bu", F.last(F.when(t.rlike(T.VOLUME), t), True).over(w))
    title = F.when(is_heading(F.col("text"), F.col("blank_before"), strong) & ~t.rlike(T.VOLUME), t)
    found = F.array_sort(F.collect_list(F.when(title.isNotNull(), F.struct("abs_start_char", title.alias("t")))))
    # the volume of a part is that of its first unit that has one
    per = rows.groupBy(key, "part_idx").agg(F.transform(found, lambda x: x["t"]).alias("titles"), F.min_by("bu", F.when(F.col("bu").isNotNull(), F.col("abs_start_char"))).alias("bu"))
    rows = parts.select(key, "part_idx").join(per, [key, "part_idx"], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    before = Window.partitionBy(key).orderBy("part_idx").rowsBetween(Window.unboundedPreceding, -1)
    first = F.try_element_at("titles", F.lit(1))
    rows = rows.withColumn("carry", F.coalesce(F.last(first, True).over(before), F.lit("")))
    bu = F.coalesce("bu", F.lit(""))
    heads = F.concat(F.array_join(F.slice("titles", 1, 3), " + "), F.when(F.size("titles") > 3, " …").otherwise(""))
    going = F.concat(F.lit("承前（"), F.col("carry"), F.lit("）"))
    label = F.when(F.size("titles") > 0, F.when(bu != "", F.concat(bu, F.lit(" / "), heads)).otherwise(heads)).otherwise(
        F.when((bu != "") & (F.col("carry") != ""), F.concat(bu, F.lit(" / "), going)).when(bu != "", bu).when(F.col("carry") != "", going).otherwise("")
    )
    return rows.select(key, "part_idx", label.alias("chapter_label"), F.coalesce(first, F.lit("")).alias("first_heading"), F.size("titles").alias("n_headings"))
