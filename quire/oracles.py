"""DuckDB SQL of the registered queries, written from the operators' definitions."""

from __future__ import annotations

from quire import samples
from quire.functions import lang as L
from quire.functions import text as T
from quire.operators import context as C
from quire.operators import manifest as MF
from quire.operators import qa

W = r"[\s\x{0b}\x1c-\x1f\x{85}\p{Z}]"
NUM = "cast(substr(source, 4) as int)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(name: str, rows: list[tuple], cols: str) -> str:
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def re2(p: str) -> str:
    """A pattern of the operators (Java) as RE2 and inside an SQL string."""
    return p.replace(f"[{T.SPACE}]", W).replace(T.SPACE, W[1:-1]).replace("\\z", "$").replace("'", "''")


def hexclass(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


BOOK = """
d0 AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
book AS (SELECT source, string_agg(CASE WHEN rn = 1 THEN '' WHEN rn % 12 = 1 THEN repeat(chr(10), 6) WHEN rn % 4 = 1 THEN repeat(chr(10), 4) ELSE repeat(chr(10), 2) END || text, '' ORDER BY rn) AS text FROM d0 GROUP BY source)"""


def units_of(table: str, key: str, name: str = "units") -> str:
    return f"""
{name}0 AS (SELECT {key}, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS text FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM {table})),
{name}1 AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY {key} ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM {name}0),
{name}2 AS (SELECT *, ln - lag(ln) OVER (PARTITION BY {key} ORDER BY ln) AS sep FROM {name}1 WHERE length(text) > 0),
{name}3 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ln) AS idx FROM {name}2 WHERE length({strip('text')}) > 0),
{name} AS (SELECT {key}, ln::INT AS ln, idx::INT AS idx, start_char::BIGINT AS start_char, (start_char + length(text))::BIGINT AS end_char, length(text)::INT AS char_count, sha256(text) AS sha256,
  (CASE WHEN idx = 1 THEN 0 ELSE sep END)::INT AS sep_newlines, greatest(CASE WHEN idx = 1 THEN 0 ELSE sep END - 1, 0)::INT AS blank_before, text FROM {name}3)"""


UNITS = BOOK + "," + units_of("book", "source")
_MARK, _SKIP = hexclass(T.SENTENCE_END)[1:-1], hexclass(T.TRAIL_SKIP)[1:-1]
_reach = lambda col, cap: f"list_max(list_filter({col}, lambda x: x > e AND x <= least(e + {cap}, n)))"
PLAN = UNITS + f""",
cuts AS (SELECT book.source, length(book.text) AS n, book.text,
  list(start_char) FILTER (WHERE blank_before >= 5 AND start_char > 0) AS strong, list(start_char) FILTER (WHERE blank_before >= 3 AND start_char > 0) AS mid,
  list(start_char) FILTER (WHERE blank_before >= 1 AND start_char > 0) AS para, list_append(coalesce(list(start_char) FILTER (WHERE start_char > 0), []), length(book.text)) AS every
  FROM book JOIN units USING (source) GROUP BY 1, 2, 3),
plan0 AS (
  WITH RECURSIVE p AS (
    SELECT source, 0 AS part_idx, 0::BIGINT AS s, 0::BIGINT AS e, '' AS cut_level FROM cuts
    UNION ALL
    SELECT source, part_idx + 1, e, coalesce(st, mi, pa, se, li, least(e + 20000, n))::BIGINT,
      CASE WHEN st IS NOT NULL THEN 'STRONG' WHEN mi IS NOT NULL THEN 'MID' WHEN pa IS NOT NULL THEN 'PARA' WHEN se IS NOT NULL THEN 'SENT' WHEN li IS NOT NULL THEN 'LINE' ELSE 'FORCED' END
    FROM (SELECT source, part_idx, e, n, {_reach('strong', 15000)} AS st, {_reach('mid', 15000)} AS mi, {_reach('para', 15000)} AS pa, {_reach('every', 20000)} AS li,
        CASE WHEN k < length(win) THEN least(e + length(win) - k + length(regexp_extract(substr(text, (e + length(win) - k + 1)::BIGINT, 20000), '^[{_SKIP}]*')), e + length(win)) END AS se
      FROM (SELECT *, length(regexp_extract(reverse(win), '^[^{_MARK}]*')) AS k FROM (SELECT p.*, c.n, c.text, strong, mid, para, every, substr(c.text, p.e + 1, least(20000, c.n - p.e)) AS win FROM p JOIN cuts c USING (source) WHERE p.e < c.n))))
  SELECT * FROM p WHERE part_idx > 0),
plan AS (SELECT source, part_idx::INT AS part_idx, s AS start_char, e AS end_char, cut_level = 'FORCED' AND e < n AS forced_cut, cut_level FROM plan0 JOIN cuts USING (source))"""
SLICES = PLAN + """,
slices AS (SELECT *, format('part_{:03d}', part_idx) AS part_id, length(t)::INT AS char_count, strlen(t)::INT AS byte_count, sha256(t) AS sha256, (length(t) - length(rtrim(t, chr(10))))::INT AS tail_newlines
  FROM (SELECT plan.*, substr(text, start_char + 1, end_char - start_char) AS t FROM plan JOIN book USING (source)))"""
PUNITS = SLICES + """,
pu AS (SELECT u.*, p.part_idx, p.start_char AS part_start, (row_number() OVER (PARTITION BY u.source, p.part_idx ORDER BY u.start_char))::INT AS index
  FROM units u JOIN plan p ON u.source = p.source AND u.start_char >= p.start_char AND u.start_char < p.end_char)"""
LINES = PUNITS + f""",
tr AS (SELECT source, ln, part_idx, CASE WHEN ln % 97 = 0 AND {NUM} % 2 = 0 THEN NULL WHEN ln % 53 = 0 THEN left(t, 2) WHEN ln % 61 = 0 AND b IS NOT NULL THEN b WHEN ln % 71 = 0 THEN '```' WHEN ln % 83 = 0 THEN t || ' ' || t ELSE t END AS line
  FROM (SELECT *, lag(t) OVER (PARTITION BY source ORDER BY ln) AS b FROM (SELECT source, ln, part_idx, {strip('text')} AS t FROM pu))),
lines AS (SELECT source, part_idx, (row_number() OVER (PARTITION BY source, part_idx ORDER BY ln))::INT AS oi, line FROM tr WHERE line IS NOT NULL),
sizes AS (SELECT a.source, a.part_idx, n_src, coalesce(n_out, 0) AS n_out FROM (SELECT source, part_idx, count(*) AS n_src FROM pu GROUP BY 1, 2) a LEFT JOIN (SELECT source, part_idx, count(*) AS n_out FROM lines GROUP BY 1, 2) b USING (source, part_idx))"""
PAIRS = LINES + f""",
pairs AS (SELECT p.source, p.part_idx, p.index AS si, {strip('p.text')} AS s, l.line AS t FROM pu p JOIN sizes z USING (source, part_idx) JOIN lines l ON l.source = p.source AND l.part_idx = p.part_idx AND l.oi = p.index WHERE n_src = n_out),
pc AS (SELECT *, CASE WHEN length(s) >= 8 THEN length(t) / length(s)::DOUBLE END AS r, length(s) >= 15 AND (length(t) <= 2 OR length(t) < greatest(2, floor(length(s) * 0.15))) AS short FROM pairs)"""
OUTS = LINES + """,
outs AS (SELECT source, part_idx, string_agg(line, chr(10) ORDER BY oi) AS text FROM lines GROUP BY 1, 2)"""
_LEVEL = "CASE WHEN r < 0.3 OR r > 2.5 THEN 2 WHEN r < 0.45 OR r > 1.8 THEN 1 ELSE 0 END"
_BLOCKS = """sh AS (SELECT source, part_idx, string_agg(line, '' ORDER BY oi) AS j FROM lines GROUP BY 1, 2),
sb AS (SELECT source, part_idx, ceil(greatest(length(j) - 30, 0) / 30.0)::INT AS n_blocks, list_transform(range(0, ceil(greatest(length(j) - 30, 0) / 30.0)::INT), lambda i: substr(j, i * 30 + 1, 30)) AS b FROM sh),
sr AS (SELECT source, part_idx, n_blocks, (len(b) - len(list_distinct(b)))::INT AS n_repeated FROM sb)"""
_ADJ = "ad AS (SELECT source, part_idx, count(*) FILTER (WHERE line = w AND length(line) > 8) AS n_adjacent FROM (SELECT *, lag(line) OVER (PARTITION BY source, part_idx ORDER BY oi) AS w FROM lines) GROUP BY 1, 2)"
_STATE = PLAN + f""",
st AS (SELECT * FROM (SELECT source, part_idx, CASE WHEN part_idx <= {NUM} THEN 'DONE' WHEN part_idx = {NUM} + 1 AND {NUM} % 3 = 0 THEN 'FAILED' WHEN part_idx = {NUM} + 1 THEN 'IN_PROGRESS' END AS status, part_idx % 4 = 0 AS review FROM plan) WHERE status IS NOT NULL),
ps AS (SELECT plan.source, plan.part_idx, coalesce(status, 'PENDING') AS status, coalesce(review, false) AS review FROM plan LEFT JOIN st USING (source, part_idx))"""
_EVENTS = """
ev AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'CLAIM' WHEN 'view' THEN 'COMMIT_PASS' WHEN 'click' THEN 'COMMIT_WARN' WHEN 'error' THEN 'COMMIT_FAIL' WHEN 'purchase' THEN 'RESET' END AS action
  FROM events WHERE event_type IN ('signup', 'view', 'click', 'error', 'purchase')),
f AS (WITH RECURSIVE s AS (
  SELECT DISTINCT key, 0::BIGINT AS seq, '' AS action, '' AS was, 'PENDING' AS status, 0 AS attempts, false AS review FROM ev
  UNION ALL
  SELECT s.key, e.seq, e.action, s.status,
    CASE WHEN e.action = 'RESET' THEN 'PENDING' WHEN e.action = 'CLAIM' AND s.status IN ('PENDING', 'IN_PROGRESS') THEN 'IN_PROGRESS'
      WHEN s.status = 'IN_PROGRESS' AND e.action IN ('COMMIT_PASS', 'COMMIT_WARN') THEN 'DONE' WHEN s.status = 'IN_PROGRESS' AND e.action = 'COMMIT_FAIL' AND s.attempts >= 3 THEN 'FAILED' ELSE s.status END,
    CASE WHEN e.action = 'RESET' THEN 0 WHEN e.action = 'CLAIM' AND s.status IN ('PENDING', 'IN_PROGRESS') THEN s.attempts + 1 ELSE s.attempts END,
    CASE WHEN e.action = 'RESET' THEN false WHEN s.status = 'IN_PROGRESS' AND e.action = 'COMMIT_PASS' THEN false WHEN s.status = 'IN_PROGRESS' AND e.action IN ('COMMIT_WARN', 'COMMIT_FAIL') THEN true ELSE s.review END
  FROM s JOIN ev e ON e.key = s.key AND e.seq = s.seq + 1) SELECT * FROM s WHERE seq > 0)"""
_SECTIONS = "sec AS (SELECT (" + str(list(C.FILES)) + ")[(item_id % 6)::INT + 1] AS file, (item_id % 6)::INT AS prio, item_id::INT AS ord, left(text, 20) AS heading, text AS body FROM benchmark)"
_HITS = _SECTIONS + """,
hits AS (SELECT DISTINCT d.doc_id, s.file, s.ord, s.prio, s.heading, s.body FROM documents d JOIN sec s ON s.heading <> '' AND (contains(d.text, s.heading) OR (split_part(split_part(s.heading, '（', 1), '(', 1) <> '' AND contains(d.text, split_part(split_part(s.heading, '（', 1), '(', 1)))))"""
_TITLE_STEPS = (
    f"a AS (SELECT id, {strip('raw')} AS x FROM t), b AS (SELECT id, CASE WHEN ends_with(lower(x), '.txt') THEN {strip('left(x, length(x) - 4)')} ELSE x END AS x FROM a),"
    "c AS (SELECT id, regexp_replace(regexp_replace(x, '[\\x00-\\x1f\\x7f]', '', 'g'), '[\\\\/:*?\"<>|]', '_', 'g') AS x FROM b),"
    f"e AS (SELECT id, {strip(f'''regexp_replace(x, '{W}+', ' ', 'g')''')} AS x FROM c), g AS (SELECT id, {strip('''rtrim(x, '. ')''')} AS x FROM e),"
    f"h AS (SELECT id, CASE WHEN length(x) > 80 THEN {strip('''rtrim(left(x, 80), '. ')''')} ELSE x END AS x FROM g), z AS (SELECT id, nullif(x, '') AS title FROM h)"
)
_MERGED = PUNITS + ", mg AS (SELECT source, string_agg(repeat(chr(10), sep_newlines) || translate(pu.text, 'aeiou', 'AEIOU'), '' ORDER BY start_char) AS body FROM pu GROUP BY 1), merged AS (SELECT mg.source, body || repeat(chr(10), length(book.text) - length(rtrim(book.text, chr(10)))) AS text, length(book.text) AS n FROM mg JOIN book USING (source))"
_V4 = f"""
moved AS (SELECT source, part_idx, CASE WHEN part_idx % 5 = 0 THEN start_char + 1 ELSE start_char END AS a, end_char AS b FROM plan),
mw AS (SELECT moved.*, coalesce(lag(b) OVER w, 0) AS before, lead(part_idx) OVER w AS nx, n FROM moved JOIN cuts USING (source) WINDOW w AS (PARTITION BY source ORDER BY part_idx)),
v4 AS (SELECT source, format('part_{{:03d}}', part_idx) AS part_id, 2 AS level, 'V4' AS code, 'gap or overlap' AS msg FROM mw WHERE a <> before
  UNION ALL SELECT source, format('part_{{:03d}}', part_idx), 2, 'V4', 'empty part' FROM mw WHERE b <= a UNION ALL SELECT source, format('part_{{:03d}}', part_idx), 2, 'V4', 'does not reach the end' FROM mw WHERE nx IS NULL AND b <> n)"""
_V3 = "v3 AS (SELECT source, part_id, 2 AS level, 'V3' AS code, CASE WHEN part_idx % 7 = 0 THEN 'part is missing' ELSE 'sha256 differs' END AS msg FROM slices WHERE part_idx % 7 = 0 OR part_idx % 5 = 0)"
_V7 = "v7 AS (SELECT source, part_id, CASE WHEN char_count > 20000 THEN 2 ELSE 1 END AS level, 'V7' AS code, char_count::VARCHAR || ' characters' AS msg FROM slices WHERE char_count > 15000 OR char_count < 2000)"
_HEAD = f"length({strip('text')}) BETWEEN 1 AND 40 AND NOT regexp_matches({strip('text')}, '{re2(T.SYMBOL_ONLY)}') AND NOT starts_with(text, '　') AND NOT regexp_matches({strip('text')}, '[。、．]$') AND blank_before >= 5"
_LABELS = PUNITS + f""",
lt AS (SELECT source, part_idx, start_char, {strip('text')} AS t, CASE WHEN regexp_matches({strip('text')}, '{re2(T.VOLUME)}') THEN {strip('text')} END AS vol, ({_HEAD}) AND NOT regexp_matches({strip('text')}, '{re2(T.VOLUME)}') AS head FROM pu),
lb AS (SELECT *, last_value(vol IGNORE NULLS) OVER (PARTITION BY source ORDER BY start_char ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bu FROM lt),
lp AS (SELECT source, part_idx, coalesce(list(t ORDER BY start_char) FILTER (WHERE head), []) AS titles, arg_min(bu, start_char) FILTER (WHERE bu IS NOT NULL) AS bu FROM lb GROUP BY 1, 2),
lq AS (SELECT plan.source, plan.part_idx, coalesce(titles, []) AS titles, coalesce(bu, '') AS bu FROM plan LEFT JOIN lp USING (source, part_idx)),
lr AS (SELECT *, coalesce(last_value(titles[1] IGNORE NULLS) OVER (PARTITION BY source ORDER BY part_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS carry, array_to_string(titles[1:3], ' + ') || CASE WHEN len(titles) > 3 THEN ' …' ELSE '' END AS heads FROM lq),
labels AS (SELECT source, part_idx, CASE WHEN len(titles) > 0 THEN CASE WHEN bu <> '' THEN bu || ' / ' || heads ELSE heads END WHEN bu <> '' AND carry <> '' THEN bu || ' / 承前（' || carry || '）' WHEN bu <> '' THEN bu WHEN carry <> '' THEN '承前（' || carry || '）' ELSE '' END AS chapter_label,
  coalesce(titles[1], '') AS first_heading, len(titles)::INT AS n_headings FROM lr)"""
_QUOTE = "q AS (SELECT id, cur, contains(src, '『') AS niju, contains(src, '『') AND contains(src, '「') AND contains(cur, '『') AS nested, contains(src, '『') AND NOT contains(src, '「') AND NOT (contains(cur, '『') OR contains(cur, '《') OR contains(cur, '‘')) AND length(" + strip("regexp_extract(src, '(?s)『(.*?)』', 1)") + ") >= greatest(length(" + strip("src") + "), 1) * 0.8 AND length(cur) - length(replace(cur, '“', '')) = 1 AS alone FROM t), r AS (SELECT *, CASE WHEN nested THEN translate(cur, '『』', '‘’') WHEN alone THEN translate(cur, '“”', '『』') ELSE cur END AS x FROM q), fixed AS (SELECT id, CASE WHEN regexp_matches(x, '[「」]') THEN translate(x, '「」', '“”') ELSE x END AS line, array_to_string(list_filter([CASE WHEN niju THEN 'has-niju' END, CASE WHEN nested THEN 'nested' END, CASE WHEN alone THEN 'standalone' END, CASE WHEN regexp_matches(x, '[「」]') THEN 'kakko' END], lambda y: y IS NOT NULL), ',') AS tags FROM r)"
_MD = values("t", samples.NOTES, "file, text") + f""",
a AS (SELECT file, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM (SELECT file, string_split(text, chr(10)) AS ls FROM t WHERE file IN ({', '.join(map(lit, C.FILES))}))),
b AS (SELECT *, starts_with(line, '## ') AS head FROM a WHERE starts_with(line, '## ') OR NOT (starts_with(line, '> ') AND starts_with({strip("regexp_replace(line, '^[> ]+', '')")}, '仅记录'))),
c AS (SELECT *, sum(head::INT) OVER (PARTITION BY file ORDER BY ln) AS ord FROM b),
s AS (SELECT file, (list_position({list(C.FILES)}, file) - 1)::INT AS prio, ord::INT AS ord, coalesce(max(CASE WHEN head THEN {strip("substr(line, 4)")} END), '') AS heading, {strip("string_agg(line, chr(10) ORDER BY ln)")} AS body FROM c GROUP BY 1, 2, 3)"""
_NORM = "replace(lower(" + strip("coalesce(code, '')") + "), '_', '-')"
_FLAGS = ", ".join(f"regexp_matches(line, '{re2(p)}') AS f{i + 1}" for i, (_, p) in enumerate(qa.FORBIDDEN))
_NFLAGS = ", ".join(f"count(*) FILTER (WHERE regexp_matches(line, '{re2(p)}')) AS f{i + 1}" for i, (_, p) in enumerate(qa.FORBIDDEN))
_ANY = " OR ".join(f"regexp_matches(line, '{re2(p)}')" for _, p in qa.FORBIDDEN)
_FENCE = f"^{W}*```[a-zA-Z]*{W}*$"
_CHAT = f"^{W}*(好的|以下是|下面是|译文如下|翻译如下|这是译文|已翻译|希望对你有帮助|Note:|Sure|Here is)[:：,]?{W}*$"
_KANA = "length(t) - length(regexp_replace(t, '[\\x{3040}-\\x{30ff}]', '', 'g'))"
_KR = f"({_KANA}) / greatest(length(regexp_replace(t, '{W}', '', 'g')), 1)::DOUBLE"
_HAN = "regexp_replace({}, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}々〆〇]', '', 'g')".format
_NAME = "CASE " + " ".join(f"WHEN k = {lit(a)} THEN {lit(b)}" for a, b in L.NAMES.items()) + " WHEN k = '' THEN '?' ELSE k END"


_PLANNED = PLAN + """,
absorbed AS (
  WITH RECURSIVE a AS (
    SELECT source, list(struct_pack(s := start_char, e := end_char, f := forced_cut, l := cut_level) ORDER BY part_idx) AS p, 0 AS k FROM plan GROUP BY 1
    UNION ALL
    SELECT source, CASE WHEN t THEN list_concat(p[1:n - 2], [struct_pack(s := p[n - 1].s, e := p[n].e, f := p[n - 1].f OR p[n].f, l := p[n].l)])
        ELSE list_concat(list_concat(p[1:i - 2], [struct_pack(s := p[i - 1].s, e := p[i + 1].e, f := p[i - 1].f OR p[i].f OR p[i + 1].f, l := p[i + 1].l)]), p[i + 2:]) END, k + 1
    FROM (SELECT *, len(p) AS n, len(p) >= 2 AND p[len(p)].e - p[len(p)].s < 2000 AND p[len(p)].e - p[len(p) - 1].s <= 15000 AS t,
        list_min(list_filter(range(2, len(p)), lambda i: p[i].e - p[i].s < 2000 AND p[i + 1].e - p[i - 1].s <= 15000)) AS i FROM a) WHERE t OR i IS NOT NULL)
  SELECT source, arg_max(p, k) AS p FROM a GROUP BY 1)"""
_QA = PAIRS + "," + _BLOCKS + "," + _ADJ + f""",
lc AS (SELECT source, part_idx, sum(length(line)) AS out_chars, bool_or({_ANY}) AS marked FROM lines GROUP BY 1, 2),
sc AS (SELECT source, part_idx, sum(length({strip('text')})) AS src_chars FROM pu GROUP BY 1, 2),
pp AS (SELECT source, part_idx, bool_or(short) AS short, max({_LEVEL}) AS lv, median(r) AS md FROM pc GROUP BY 1, 2),
qo AS (SELECT z.source, z.part_idx, z.n_src, z.n_out, 0 AS v9, 0 AS v10a, 0 AS v10b, CASE WHEN short THEN 2 ELSE 0 END AS v10c, lv AS v10d, CASE WHEN n_adjacent > 0 OR n_repeated / greatest(n_blocks, 1)::DOUBLE > 0.15 THEN 2 ELSE 0 END AS v10e, CASE WHEN marked THEN 2 ELSE 0 END AS v11, 0 AS v12,
  out_chars / src_chars::DOUBLE AS ratio, md AS ratio_median FROM sizes z JOIN lc USING (source, part_idx) JOIN sc USING (source, part_idx) JOIN pp USING (source, part_idx) JOIN ad USING (source, part_idx) JOIN sr USING (source, part_idx) WHERE n_src = n_out),
qw AS (SELECT *, CASE WHEN ratio < 0.6 OR ratio > 2.5 THEN 1 ELSE 0 END AS part_ratio_level FROM qo),
ql AS (SELECT *, greatest(v10c, v10d, v10e, v11, part_ratio_level) AS level FROM qw)"""
#: Pairs of the parts with unequal counts as difflib's SequenceMatcher aligns them: the longest run of equal lines (the first of
#: equals) splits a range in two, until none is left; what stands between two runs pairs by position.
_ALIGNED = f"""
odd AS (SELECT * FROM sizes WHERE n_src <> n_out),
eq AS (SELECT p.source, p.part_idx, p.index AS i, l.oi AS j FROM pu p JOIN odd USING (source, part_idx) JOIN lines l ON l.source = p.source AND l.part_idx = p.part_idx AND l.line = {strip('p.text')}),
bk AS (WITH RECURSIVE x AS (
  SELECT source, part_idx, 1::BIGINT AS a, n_src + 1 AS b, 1::BIGINT AS c, n_out + 1 AS d, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS k FROM odd
  UNION ALL
  SELECT source, part_idx, unnest([a, i + k]), unnest([i, b]), unnest([c, j + k]), unnest([j, d]), i, j, unnest([k, 0]) FROM (
    SELECT *, row_number() OVER (PARTITION BY source, part_idx, a, c ORDER BY k DESC, i, j) AS rn FROM (
      SELECT source, part_idx, a, b, c, d, min(i) AS i, min(j) AS j, count(*) AS k FROM (
        SELECT x.source, x.part_idx, a, b, c, d, eq.i, eq.j, eq.i - row_number() OVER (PARTITION BY x.source, x.part_idx, a, c, eq.i - eq.j ORDER BY eq.i) AS g
        FROM x JOIN eq ON eq.source = x.source AND eq.part_idx = x.part_idx AND eq.i >= a AND eq.i < b AND eq.j >= c AND eq.j < d)
      GROUP BY source, part_idx, a, b, c, d, i - j, g)) WHERE rn = 1)
  SELECT source, part_idx, i, j, k FROM x WHERE k > 0 UNION ALL SELECT source, part_idx, n_src + 1, n_out + 1, 0 FROM odd),
gp AS (SELECT *, coalesce(lag(i + k) OVER w, 1) AS a, coalesce(lag(j + k) OVER w, 1) AS c FROM bk WINDOW w AS (PARTITION BY source, part_idx ORDER BY i, j, k DESC)),
ij AS (SELECT source, part_idx, i + n AS si, j + n AS oi FROM (SELECT *, unnest(range(0, k)) AS n FROM gp)
  UNION ALL SELECT source, part_idx, CASE WHEN a + n < i THEN a + n END, CASE WHEN c + n < j THEN c + n END FROM (SELECT *, unnest(range(0, greatest(i - a, j - c))) AS n FROM gp)),
every AS (SELECT source, part_idx, s, t FROM pairs UNION ALL SELECT ij.source, ij.part_idx, {strip('p.text')}, l.line FROM ij
  LEFT JOIN pu p ON p.source = ij.source AND p.part_idx = ij.part_idx AND p.index = ij.si LEFT JOIN lines l ON l.source = ij.source AND l.part_idx = ij.part_idx AND l.oi = ij.oi),
pd AS (SELECT *, CASE WHEN length(s) >= 8 THEN length(t) / length(s)::DOUBLE END AS r, s IS NOT NULL AND t IS NULL AS gone,
  coalesce(length(s) >= 15 AND (length(t) <= 2 OR length(t) < greatest(2, floor(length(s) * 0.15))), false) OR (s IS NOT NULL AND t IS NULL) AS short FROM every)"""
_QA_ALL = PAIRS + "," + _BLOCKS + "," + _ADJ + "," + _ALIGNED + f""",
lc AS (SELECT source, part_idx, sum(length(line)) AS out_chars, bool_or({_ANY}) AS marked FROM lines GROUP BY 1, 2),
sc AS (SELECT source, part_idx, sum(length({strip('text')})) AS src_chars FROM pu GROUP BY 1, 2),
pp AS (SELECT source, part_idx, bool_or(short) AS short, max({_LEVEL}) AS lv, bool_or(gone AND (length(s) <= 3 OR regexp_matches(s, '^[^\\p{{L}}\\p{{N}}]+$'))) AS special FROM pd GROUP BY 1, 2),
qo AS (SELECT z.source, z.part_idx, z.n_src, z.n_out, CASE WHEN z.n_out > 0 THEN 0 ELSE 2 END AS v9, CASE WHEN z.n_out > 0 THEN CASE WHEN n_src = z.n_out THEN 0 WHEN abs(z.n_out - n_src) / greatest(n_src, 1)::DOUBLE > 0.1 THEN 2 ELSE 1 END END AS v10a,
  CASE WHEN z.n_out > 0 THEN 0 END AS v10b, CASE WHEN z.n_out > 0 THEN CASE WHEN short THEN 2 ELSE 0 END END AS v10c, CASE WHEN z.n_out > 0 THEN lv END AS v10d,
  CASE WHEN z.n_out > 0 THEN CASE WHEN n_adjacent > 0 OR n_repeated / greatest(n_blocks, 1)::DOUBLE > 0.15 THEN 2 ELSE 0 END END AS v10e, CASE WHEN z.n_out > 0 THEN CASE WHEN marked THEN 2 ELSE 0 END END AS v11,
  CASE WHEN z.n_out > 0 THEN CASE WHEN special THEN 2 ELSE 0 END END AS v12, CASE WHEN z.n_out > 0 THEN out_chars / src_chars::DOUBLE END AS ratio
  FROM sizes z JOIN sc USING (source, part_idx) JOIN pp USING (source, part_idx) LEFT JOIN lc USING (source, part_idx) LEFT JOIN ad USING (source, part_idx) LEFT JOIN sr USING (source, part_idx)),
qw AS (SELECT *, CASE WHEN n_out > 0 THEN CASE WHEN ratio < 0.6 OR ratio > 2.5 THEN 1 ELSE 0 END END AS part_ratio_level FROM qo),
ql AS (SELECT *, greatest(v9, v10a, v10b, v10c, v10d, v10e, v11, v12, part_ratio_level) AS level FROM qw)"""
_V8 = "@ps," + units_of("ps", "k", "again") + ", old AS (SELECT source, part_idx, index, start_char - part_start AS a, start_char - part_start + char_count AS b, sha256, sep_newlines FROM pu), new AS (SELECT split_part(k, ':', 1) AS source, split_part(k, ':', 2)::INT AS part_idx, idx AS index, start_char AS a, end_char AS b, sha256, sep_newlines FROM again), j AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.part_idx, n.part_idx) AS part_idx, coalesce(o.index, n.index) AS index, o.sha256 AS x, n.sha256 AS y, o.a <> n.a OR o.b <> n.b OR o.sha256 <> n.sha256 AS d, o.sep_newlines <> n.sep_newlines AS e FROM old o FULL JOIN new n ON o.source = n.source AND o.part_idx = n.part_idx AND o.index = n.index), v8 AS (SELECT source, part_idx FROM j WHERE x IS NULL OR y IS NULL UNION ALL SELECT source, part_idx FROM j WHERE d UNION ALL SELECT source, part_idx FROM j WHERE index > 1 AND e)"
_CODES = {"v9": "V9", "v10a": "V10.A", "v10b": "V10.B", "v10c": "V10.C", "v10d": "V10.D", "v10e": "V10.E", "v11": "V11", "v12": "V12", "part_ratio_level": "V10.part-ratio"}
_AUDIT = _QA_ALL + "," + _V8.replace("@ps", "ps AS (SELECT source || ':' || part_idx AS k, t AS text FROM slices WHERE part_idx % 11 <> 5)") + f""",
miss AS (SELECT * FROM slices WHERE part_idx % 11 = 5),
have AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part_idx) AS rn FROM slices WHERE part_idx % 11 <> 5),
lost AS (SELECT DISTINCT source FROM miss),
found AS (SELECT source, 'V1' AS code, 2 AS level FROM book WHERE {NUM} % 5 = 0 UNION ALL SELECT source, 'V1', 2 FROM book WHERE {NUM} % 7 = 0
  UNION ALL SELECT source, 'V2', 2 FROM have WHERE rn <> part_idx UNION ALL SELECT source, 'V2', 2 FROM lost UNION ALL SELECT source, 'V2', 2 FROM lost
  UNION ALL SELECT source, 'V3', 2 FROM miss UNION ALL SELECT source, 'V5', 2 FROM lost UNION ALL SELECT source, 'V6', 2 FROM lost
  UNION ALL SELECT source, 'V7', CASE WHEN char_count > 20000 THEN 2 ELSE 1 END FROM have WHERE char_count > 15000 OR char_count < 2000 UNION ALL SELECT source, 'V8', 2 FROM v8
  {" ".join(f"UNION ALL SELECT source, '{code}', {c} FROM qw WHERE {c} > 0" for c, code in _CODES.items())}
  UNION ALL SELECT source, 'STATE', 2 FROM book WHERE {NUM} % 3 = 0 UNION ALL SELECT source, 'STATE', 2 FROM book WHERE {NUM} % 4 = 0)"""
_CAL = PAIRS + ", k AS (SELECT source, list_sort(list(r)) AS rs, count(r) AS n FROM pc WHERE r IS NOT NULL GROUP BY 1), g AS (SELECT source, n, rs[round_even((n - 1) * 0.01, 0)::INT + 1] AS p1, rs[round_even((n - 1) * 0.99, 0)::INT + 1] AS p99 FROM k), bands AS (SELECT source, CASE WHEN n >= 30 THEN round(least(p1, 0.45), 3) ELSE 0.45 END AS wl, CASE WHEN n >= 30 THEN round(greatest(p99, 1.8), 3) ELSE 1.8 END AS wh, CASE WHEN n >= 30 THEN round(least(p1 * 0.8, 0.3), 3) ELSE 0.3 END AS fl, CASE WHEN n >= 30 THEN round(greatest(p99 * 1.3, 2.5), 3) ELSE 2.5 END AS fh FROM g WHERE " + NUM + " % 2 = 0)"
_SET = "rows AS (SELECT source, part_idx, CASE part_idx % 3 WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'IN_PROGRESS' ELSE status END AS s FROM st)"
_TERMS = "terms AS (SELECT item_id AS pos, left(text, 12) AS src_term, item_id::VARCHAR AS tgt_term FROM benchmark WHERE left(text, 12) <> '')"
_BLOCK = OUTS + "," + _SECTIONS + "," + _TERMS + """,
ch AS (SELECT DISTINCT d.source, d.part_idx, s.prio, s.ord, s.file, s.heading, s.body FROM slices d JOIN sec s ON s.heading <> '' AND s.file <> 'terms.md' AND (contains(d.t, s.heading) OR (split_part(split_part(s.heading, '（', 1), '(', 1) <> '' AND contains(d.t, split_part(split_part(s.heading, '（', 1), '(', 1))))),
cr AS (SELECT *, row_number() OVER (PARTITION BY source, part_idx ORDER BY prio, ord) AS rn FROM ch),
cb AS (WITH RECURSIVE x AS (SELECT source, part_idx, rn, length(body)::BIGINT AS used, ['[' || file || '] ' || heading || chr(10) || body] AS texts, [file || '::' || heading] AS names FROM cr WHERE rn = 1
  UNION ALL SELECT x.source, x.part_idx, h.rn, CASE WHEN used + length(h.body) <= 500 THEN used + length(h.body) ELSE used END, CASE WHEN used + length(h.body) <= 500 THEN list_append(texts, '[' || h.file || '] ' || h.heading || chr(10) || h.body) ELSE texts END, list_append(names, h.file || '::' || h.heading)
    FROM x JOIN cr h ON h.source = x.source AND h.part_idx = x.part_idx AND h.rn = x.rn + 1) SELECT source, part_idx, arg_max(texts, rn) AS texts, arg_max(names, rn) AS names FROM x GROUP BY 1, 2),
cg AS (SELECT source, part_idx, '[terms.md] terms' || chr(10) || array_to_string(list(src_term || ' → ' || tgt_term ORDER BY pos, src_term)[1:40], chr(10)) AS gloss FROM slices d JOIN terms ON contains(d.t, src_term) GROUP BY 1, 2),
pt AS (SELECT s.source, s.part_idx, lag(right(s.t, 600)) OVER w AS r, lag(right(o.text, 1200)) OVER w AS q FROM slices s LEFT JOIN outs o USING (source, part_idx) WINDOW w AS (PARTITION BY s.source ORDER BY s.part_idx)),
bl AS (SELECT pt.source, pt.part_idx, list_concat(coalesce(names, []), CASE WHEN gloss IS NULL THEN [] ELSE ['terms.md::terms'] END) AS hits, r, q, array_to_string(list_concat(coalesce(texts, []), CASE WHEN gloss IS NULL THEN [] ELSE [gloss] END), chr(10) || chr(10)) AS notes FROM pt LEFT JOIN cb USING (source, part_idx) LEFT JOIN cg USING (source, part_idx)),
bx AS (SELECT source, part_idx, hits, array_to_string(list_filter([CASE WHEN q <> '' THEN '""" + C.TRANSLATED_HEAD.replace("'", "''") + """' || chr(10) || q END, CASE WHEN r <> '' THEN '""" + C.RAW_HEAD.replace("'", "''") + """' || chr(10) || r END, CASE WHEN notes <> '' THEN '""" + C.NOTES_HEAD + """' || chr(10) || notes END], lambda y: y IS NOT NULL), chr(10) || chr(10)) AS context FROM bl)"""
_PASS = LINES + ", t AS (SELECT source || ':' || p.part_idx || ':' || l.oi AS id, translate(p.text, 'qxzj', '「」『』') AS src, translate(l.line, 'qxzj', '「」『』') AS cur FROM pu p JOIN sizes z USING (source, part_idx) JOIN lines l ON l.source = p.source AND l.part_idx = p.part_idx AND l.oi = p.index WHERE n_src = n_out)," + _QUOTE + """,
pl AS (SELECT l.source, l.part_idx, oi, translate(l.line, 'qxzj', '「」『』') AS cur, coalesce(x.line, translate(l.line, 'qxzj', '「」『』')) AS line, x.tags, n_src = n_out AS fits FROM lines l JOIN sizes z USING (source, part_idx) LEFT JOIN fixed x ON x.id = l.source || ':' || l.part_idx || ':' || l.oi)"""
_JPARA = {"canon": "abs_end_char := end_char, abs_start_char := start_char, blank_before := blank_before, char_count := char_count, end_char := start_char - part_start + char_count, index := index, paragraph_id := pid, sep_newlines := sep_newlines, sha256 := sha256, start_char := start_char - part_start",
          "plain": "paragraph_id := pid, index := index, start_char := start_char - part_start, end_char := start_char - part_start + char_count, abs_start_char := start_char, abs_end_char := end_char, char_count := char_count, sha256 := sha256, sep_newlines := sep_newlines, blank_before := blank_before"}
_JPART = {"canon": "byte_count := byte_count, chapter_label := chapter_label, char_count := char_count, end_char := end_char, file := part_id || '.txt', first_heading := first_heading, forced_cut := forced_cut, index := part_idx, paragraphs := canon, part_id := part_id, sha256 := sha256, start_char := start_char, tail_newlines := tail_newlines, text_unit_count := n",
          "plain": "part_id := part_id, index := part_idx, file := part_id || '.txt', start_char := start_char, end_char := end_char, char_count := char_count, byte_count := byte_count, sha256 := sha256, chapter_label := chapter_label, first_heading := first_heading, text_unit_count := n, tail_newlines := tail_newlines, forced_cut := forced_cut, paragraphs := plain"}
_MANIFEST = _LABELS + f""",
mp AS (SELECT source, part_idx, count(*) AS n, {', '.join(f"list(struct_pack({x}) ORDER BY index) AS {k}" for k, x in _JPARA.items())} FROM (SELECT *, format('part_{{:03d}}:p{{:03d}}', part_idx, index) AS pid FROM pu) GROUP BY 1, 2),
mr AS (SELECT s.*, coalesce(n, 0) AS n, canon, plain, chapter_label, first_heading FROM slices s LEFT JOIN mp USING (source, part_idx) LEFT JOIN labels USING (source, part_idx)),
ms AS (SELECT source, count(*) AS part_count, sum(char_count)::BIGINT AS total_char_count, sum(byte_count)::BIGINT AS total_byte_count, {', '.join(f"list(struct_pack({x}) ORDER BY part_idx) AS {k}" for k, x in _JPART.items())} FROM mr GROUP BY 1),
md AS (SELECT ms.*, to_json(struct_pack(config := struct_pack(hard_max := 20000, min_part := 2000, target_max := 15000, target_min := 8000), part_count := part_count, parts := canon, schema := '{MF.SCHEMA_NAME}', schema_version := '{MF.SCHEMA_VERSION}', source := ms.source,
  source_info := struct_pack(byte_count := strlen(b.text), char_count := length(b.text), has_bom := starts_with(b.text, chr(65279)), line_ending := CASE WHEN contains(b.text, chr(13)) THEN '?' WHEN contains(b.text, chr(10)) THEN 'LF' ELSE 'NONE' END, sha256 := sha256(b.text)),
  total_byte_count := total_byte_count, total_char_count := total_char_count))::VARCHAR AS doc FROM ms JOIN book b USING (source))"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


SQL = {
    "source_profile": sql(BOOK, "SELECT source, length(text)::INT AS char_count, strlen(text)::INT AS byte_count, sha256(text) AS sha256, CASE WHEN contains(text, chr(13) || chr(10)) AND regexp_matches(text, '(^|[^\\r])\\n') THEN 'MIXED' WHEN contains(text, chr(13) || chr(10)) THEN 'CRLF' WHEN contains(text, chr(10)) THEN 'LF' ELSE 'NONE' END AS line_ending, starts_with(text, chr(65279)) AS has_bom, (length(text) - length(rtrim(text, chr(10))))::INT AS tail_newlines FROM book"),
    "units": sql(UNITS, "SELECT * EXCLUDE (text) FROM units"),
    "unit_stats": sql(UNITS, "SELECT source, count(*) AS n_units, sum(char_count)::BIGINT AS n_chars, max(char_count) AS longest, min(char_count) AS shortest, max(blank_before) AS most_blank, count(*) FILTER (WHERE sep_newlines > 1) AS n_spaced FROM units GROUP BY 1"),
    "unit_hashes": sql(units_of("documents", "doc_id"), "SELECT sha256, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM units GROUP BY 1"),
    "boundary_counts": sql(UNITS, "SELECT source, count(*) FILTER (WHERE blank_before >= 5 AND start_char > 0) AS n_strong, count(*) FILTER (WHERE blank_before >= 3 AND start_char > 0) AS n_mid, count(*) FILTER (WHERE blank_before >= 1 AND start_char > 0) AS n_para, count(*) FILTER (WHERE start_char > 0) AS n_line FROM units GROUP BY 1"),
    "headings": sql(UNITS, f"SELECT source, ln, {strip('text')} AS title FROM units WHERE {_HEAD}"),
    "plan_greedy": sql(PLAN, "SELECT * FROM plan"),
    "part_slices": sql(SLICES, "SELECT * EXCLUDE (t) FROM slices"),
    "part_units": sql(PUNITS, "SELECT source, part_idx, format('part_{:03d}', part_idx) AS part_id, format('part_{:03d}:p{:03d}', part_idx, index) AS paragraph_id, index, start_char - part_start AS rel_start, start_char - part_start + char_count AS rel_end, start_char AS abs_start_char, end_char AS abs_end_char, char_count, sep_newlines, blank_before FROM pu"),
    "part_totals": sql(SLICES, "SELECT b.source, length(b.text)::BIGINT AS chars, strlen(b.text)::BIGINT AS bytes, c AS sum_chars, y AS sum_bytes, n AS n_parts, c = length(b.text) AND y = strlen(b.text) AS ok FROM book b JOIN (SELECT source, sum(char_count)::BIGINT AS c, sum(byte_count)::BIGINT AS y, count(*) AS n FROM slices GROUP BY 1) s ON s.source = b.source"),
    "size_report": sql(SLICES, "SELECT source, count(*) AS n_parts, min(char_count) AS smallest, max(char_count) AS largest, sum(char_count)::BIGINT AS chars, count(*) FILTER (WHERE char_count BETWEEN 8000 AND 15000) AS in_band, count(*) FILTER (WHERE char_count > 20000) AS over_hard, count(*) FILTER (WHERE char_count > 15000 AND char_count <= 20000) AS over_target, count(*) FILTER (WHERE char_count < 2000) AS under_min FROM slices GROUP BY 1"),
    "continuity": sql(PLAN + "," + _V4, "SELECT * FROM v4"),
    "rebuild_check": sql(SLICES, f"SELECT b.source, coalesce(sha256(x) = sha256(b.text), false) AS ok, coalesce(length(x), 0)::INT AS built_chars FROM book b LEFT JOIN (SELECT source, string_agg(t, '' ORDER BY part_idx) AS x FROM slices WHERE NOT (part_idx = 2 AND {NUM} % 4 = 0) GROUP BY 1) s ON s.source = b.source"),
    "first_sep": sql(PUNITS, "SELECT p.source, p.part_idx, format('part_{:03d}:p001', p.part_idx) AS paragraph_id, sep_newlines, (length(t) - length(ltrim(t, chr(10))) + before)::INT AS newlines_before FROM pu p JOIN (SELECT *, coalesce(lag(tail_newlines) OVER (PARTITION BY source ORDER BY part_idx), 0) AS before FROM slices) s ON s.source = p.source AND s.part_idx = p.part_idx WHERE p.index = 1"),
    "chapter_labels": sql(_LABELS, "SELECT * FROM labels"),
    "v1_source": sql(BOOK, f"SELECT source, NULL::VARCHAR AS part_id, 2 AS level, 'V1' AS code, 'byte_count differs' AS msg FROM book WHERE {NUM} % 5 = 0 UNION ALL SELECT source, NULL, 2, 'V1', 'sha256 differs' FROM book WHERE {NUM} % 7 = 0"),
    "v2_manifest": sql(SLICES, f"""SELECT source, part_id, 2 AS level, 'V2' AS code, 'part ids are not consecutive' AS msg FROM slices WHERE source = 'src1' AND part_idx > 3
      UNION ALL SELECT source, NULL, 2, 'V2', 'part count differs' FROM (SELECT source, count(*) AS n FROM slices GROUP BY 1) WHERE {NUM} % 6 = 0 OR (source = 'src1' AND n >= 3)
      UNION ALL SELECT source, NULL, 2, 'V2', 'totals differ' FROM (SELECT source, count(*) AS n FROM slices GROUP BY 1) WHERE {NUM} % 4 = 0 OR (source = 'src1' AND n >= 3)"""),
    "v3_parts": sql(SLICES + "," + _V3, "SELECT * FROM v3"),
    "v7_sizes": sql(SLICES + "," + _V7, "SELECT * FROM v7"),
    "v8_units": sql(PUNITS + ", ps AS (SELECT source || ':' || part_idx AS k, t AS text FROM slices)," + units_of("ps", "k", "again") + ", old AS (SELECT source, part_idx, index, start_char - part_start AS a, start_char - part_start + char_count AS b, sha256, sep_newlines FROM pu), new AS (SELECT split_part(k, ':', 1) AS source, split_part(k, ':', 2)::INT AS part_idx, idx AS index, start_char AS a, end_char AS b, sha256, sep_newlines FROM again), j AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.part_idx, n.part_idx) AS part_idx, coalesce(o.index, n.index) AS index, o.sha256 AS x, n.sha256 AS y, o.a <> n.a OR o.b <> n.b OR o.sha256 <> n.sha256 AS d, o.sep_newlines <> n.sep_newlines AS e FROM old o FULL JOIN new n ON o.source = n.source AND o.part_idx = n.part_idx AND o.index = n.index), i AS (SELECT source, part_idx FROM j WHERE x IS NULL OR y IS NULL UNION ALL SELECT source, part_idx FROM j WHERE d UNION ALL SELECT source, part_idx FROM j WHERE index > 1 AND e)", "SELECT source, format('part_{:03d}', part_idx) AS part_id, count(*) AS n, 2 AS level FROM i GROUP BY 1, 2"),
    "out_lines": sql(LINES, f"SELECT source, part_idx, oi, {strip('line')} AS line FROM lines"),
    "clean_output": sql(values("t", samples.RAW, "id, raw"), f"SELECT id, coalesce(array_to_string(list_transform(list_filter(string_split(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '{_FENCE}') AND NOT regexp_matches(x, '{_CHAT}') AND {strip('x')} <> ''), lambda x: {strip('x')}), chr(10)), '') AS clean FROM t"),
    "aligned_pairs": sql(PAIRS, "SELECT source, part_idx, si, si AS oi, length(s)::INT AS s_len, length(t)::INT AS t_len, s = t AS same FROM pairs"),
    "qa_parts": sql(PAIRS + "," + _BLOCKS + "," + _ADJ + f""",
      lc AS (SELECT source, part_idx, sum(length(line)) AS out_chars, bool_or({_ANY}) AS marked FROM lines GROUP BY 1, 2),
      sc AS (SELECT source, part_idx, sum(length({strip('text')})) AS src_chars FROM pu GROUP BY 1, 2),
      pp AS (SELECT source, part_idx, bool_or(short) AS short, max({_LEVEL}) AS lv, median(r) AS md FROM pc GROUP BY 1, 2),
      o AS (SELECT z.source, z.part_idx, z.n_src, z.n_out, 0 AS v9, 0 AS v10a, 0 AS v10b, CASE WHEN short THEN 2 ELSE 0 END AS v10c, lv AS v10d, CASE WHEN n_adjacent > 0 OR n_repeated / greatest(n_blocks, 1)::DOUBLE > 0.15 THEN 2 ELSE 0 END AS v10e, CASE WHEN marked THEN 2 ELSE 0 END AS v11, 0 AS v12,
        out_chars / src_chars::DOUBLE AS ratio, md AS ratio_median FROM sizes z JOIN lc USING (source, part_idx) JOIN sc USING (source, part_idx) JOIN pp USING (source, part_idx) JOIN ad USING (source, part_idx) JOIN sr USING (source, part_idx) WHERE n_src = n_out),
      w AS (SELECT *, CASE WHEN ratio < 0.6 OR ratio > 2.5 THEN 1 ELSE 0 END AS part_ratio_level FROM o)""", "SELECT *, greatest(v10c, v10d, v10e, v11, part_ratio_level) AS level FROM w"),
    "count_check": sql(LINES, "SELECT *, CASE WHEN n_src = n_out THEN 0 WHEN abs(n_out - n_src) / greatest(n_src, 1)::DOUBLE > 0.1 THEN 2 ELSE 1 END AS v10a FROM sizes"),
    "part_ratio": sql(LINES, f"SELECT a.source, a.part_idx, src_chars, coalesce(out_chars, 0) AS out_chars, CASE WHEN src_chars > 0 THEN coalesce(out_chars, 0) / src_chars::DOUBLE ELSE 0.0 END AS ratio FROM (SELECT source, part_idx, sum(length({strip('text')}))::BIGINT AS src_chars FROM pu GROUP BY 1, 2) a LEFT JOIN (SELECT source, part_idx, sum(length(line))::BIGINT AS out_chars FROM lines GROUP BY 1, 2) b USING (source, part_idx)"),
    "unit_ratio_median": sql(PAIRS, "SELECT source, part_idx, median(r) AS median, count(r) AS n FROM pc GROUP BY 1, 2"),
    "order_jumps": sql(PAIRS, "SELECT source, part_idx, count(*) FILTER (WHERE oi < was) AS jumps FROM (SELECT *, lag(oi) OVER (PARTITION BY source, part_idx ORDER BY si) AS was FROM (SELECT source, part_idx, si, CASE WHEN si % 10 = 3 THEN si + 1 WHEN si % 10 = 4 THEN si - 1 ELSE si END AS oi FROM pairs)) GROUP BY 1, 2"),
    "dup_adjacent": sql(LINES + "," + _ADJ, "SELECT * FROM ad"),
    "dup_shingles": sql(LINES + "," + _BLOCKS, "SELECT * FROM sr"),
    "forbidden": sql(LINES, f"SELECT source, part_idx, {_NFLAGS} FROM lines GROUP BY 1, 2"),
    "forbidden_samples": sql(values("t", samples.MARKED, "id, line"), f"SELECT id, {_FLAGS} FROM t"),
    "residue": sql(values("t", samples.KANA, "id, t"), f"SELECT id, {_KR} AS ratio, {_KR} > 0.15 AS ja, false AS fr FROM t"),
    "v9_outputs": sql(OUTS, "SELECT p.source, p.part_idx, CASE WHEN o.text IS NULL OR p.part_idx % 9 = 0 THEN 1 WHEN p.part_idx % 6 = 0 THEN 2 ELSE 0 END AS v9 FROM plan p LEFT JOIN outs o USING (source, part_idx)"),
    "verdicts": sql(SLICES + "," + _V4 + "," + _V3 + "," + _V7, "SELECT source, ['PASS', 'WARN', 'FAIL'][max(level) + 1] AS verdict, count(*) FILTER (WHERE level = 2) AS n_fail, count(*) FILTER (WHERE level = 1) AS n_warn FROM (SELECT * FROM v3 UNION ALL SELECT * FROM v4 UNION ALL SELECT * FROM v7) GROUP BY 1"),
    "calibration": sql(PAIRS + ", k AS (SELECT source, list_sort(list(r)) AS rs, count(r) AS n, median(r) AS median FROM pc WHERE r IS NOT NULL GROUP BY 1), g AS (SELECT source, n, median, rs[round_even((n - 1) * 0.01, 0)::INT + 1] AS p1, rs[round_even((n - 1) * 0.99, 0)::INT + 1] AS p99 FROM k)", "SELECT source, n, median, p1, p99, CASE WHEN n >= 30 THEN round(least(p1, 0.45), 3) ELSE 0.45 END::DOUBLE AS warn_low, CASE WHEN n >= 30 THEN round(greatest(p99, 1.8), 3) ELSE 1.8 END::DOUBLE AS warn_high, CASE WHEN n >= 30 THEN round(least(p1 * 0.8, 0.3), 3) ELSE 0.3 END::DOUBLE AS fail_low, CASE WHEN n >= 30 THEN round(greatest(p99 * 1.3, 2.5), 3) ELSE 2.5 END::DOUBLE AS fail_high FROM g"),
    "missing_outputs": sql(OUTS, "SELECT source, part_idx, format('part_{:03d}', part_idx) AS part_id FROM plan p WHERE NOT EXISTS (SELECT 1 FROM outs o WHERE o.source = p.source AND o.part_idx = p.part_idx AND o.part_idx % 4 <> 0)"),
    "md_sections": sql(_MD, "SELECT * FROM s"),
    "md_terms": sql(_MD + f", m AS (SELECT ord, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS line FROM (SELECT ord, string_split(body, chr(10)) AS ls FROM s WHERE file = 'terms.md')), n AS (SELECT ord, ln, list_transform(string_split(trim(line, '|'), '|'), lambda x: {strip('x')}) AS c FROM m WHERE starts_with(line, '|'))", f"SELECT ord, ln::INT AS ln, c[1] AS src_term, c[2] AS tgt_term FROM n WHERE len(c) >= 2 AND c[1] <> '' AND lower(c[1]) NOT IN ({', '.join(map(lit, C.HEADER_WORDS))}) AND len(list_filter(c, lambda x: x NOT IN ({', '.join(map(lit, C.RULES))}))) > 0"),
    "context_hits": sql(_HITS, "SELECT doc_id, file, ord, prio FROM hits"),
    "gloss_hits": "SELECT d.doc_id, left(b.text, 12) AS src_term, b.item_id::VARCHAR AS tgt_term FROM documents d JOIN benchmark b ON left(b.text, 12) <> '' AND contains(d.text, left(b.text, 12))",
    "gloss_samples": sql(values("p", samples.GLOSS_TEXTS, "source, part_idx, text") + "," + values("t", samples.TERMS, "src_term, tgt_term"), f"SELECT source, part_idx, src_term, tgt_term FROM p JOIN t ON contains(text, src_term) OR ({_HAN('src_term')} <> '' AND contains({_HAN('text')}, {_HAN('src_term')}))"),
    "context_budget": sql(_HITS + """,
      hr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prio, ord) AS rn FROM hits),
      b AS (WITH RECURSIVE x AS (SELECT doc_id, 1::BIGINT AS rn, length(body)::BIGINT AS used, [heading] AS chosen FROM hr WHERE rn = 1
        UNION ALL SELECT x.doc_id, h.rn, CASE WHEN used + length(h.body) <= 500 THEN used + length(h.body) ELSE used END, CASE WHEN used + length(h.body) <= 500 THEN list_append(chosen, h.heading) ELSE chosen END FROM x JOIN hr h ON h.doc_id = x.doc_id AND h.rn = x.rn + 1) SELECT * FROM x)""", "SELECT doc_id, 1 AS part_idx, rn AS n_hits, used::INT AS used, len(chosen)::INT AS n_chosen, array_to_string(chosen, '|') AS headings FROM b WHERE rn = (SELECT max(rn) FROM hr WHERE hr.doc_id = b.doc_id)"),
    "prev_tails": sql(OUTS + ", pt AS (SELECT s.source, s.part_idx, lag(right(s.t, 600)) OVER w AS r, lag(right(o.text, 1200)) OVER w AS q FROM slices s LEFT JOIN outs o USING (source, part_idx) WINDOW w AS (PARTITION BY s.source ORDER BY s.part_idx))", "SELECT source, part_idx, length(r)::INT AS raw_len, sha256(r) AS raw_sha, length(q)::INT AS out_len, sha256(q) AS out_sha FROM pt"),
    "progress": sql(_STATE, "SELECT source, count(*) AS n_parts, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (WHERE status = 'DONE') AS done, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE review) AS review FROM ps GROUP BY 1"),
    "next_part": sql(_STATE, "SELECT source, min(part_idx) FILTER (WHERE status <> 'DONE') AS next_idx, coalesce(min(part_idx) FILTER (WHERE status = 'FAILED') = min(part_idx) FILTER (WHERE status <> 'DONE'), false) AS blocked FROM ps GROUP BY 1"),
    "state_fold": sql(_EVENTS, "SELECT key, status, attempts, review AS needs_human_review, seq AS n_events FROM f WHERE seq = (SELECT max(seq) FROM ev WHERE ev.key = f.key)"),
    "state_history": sql(_EVENTS, "SELECT key, seq, action, was AS from_status, status AS to_status FROM f"),
    "latest_event": sql(_EVENTS, "SELECT key, max(seq) AS seq, arg_max(action, seq) AS action FROM ev GROUP BY 1"),
    "binding_errors": sql(BOOK, f"SELECT source, 'part_count' AS field FROM book WHERE {NUM} % 3 = 0 UNION ALL SELECT source, 'source_sha256' FROM book WHERE {NUM} % 4 = 0"),
    "merge_text": sql(_MERGED, "SELECT source, sha256(text) AS sha256, length(text)::INT AS chars FROM merged"),
    "merge_stats": sql(_MERGED, "SELECT source, length(text)::INT AS chars, n::INT AS source_chars, CASE WHEN n > 0 THEN length(text) / n::DOUBLE ELSE 0.0 END AS ratio, sha256(text) AS sha256 FROM merged"),
    "merge_check": sql(BOOK, "SELECT source, CASE source WHEN 'src2' THEN 'MISSING' WHEN 'src3' THEN 'DIFFERENT' ELSE 'IDENTICAL' END AS result FROM book"),
    "merge_precheck": sql(LINES + f""", ps AS (SELECT p.source, p.part_idx, coalesce(n_src, 0) AS n_src, coalesce(n_out, 0) AS n_out, CASE WHEN p.part_idx <= {NUM.replace('source', 'p.source')} THEN 'DONE' WHEN p.part_idx = {NUM.replace('source', 'p.source')} + 1 THEN 'OPEN' ELSE '' END AS s FROM plan p LEFT JOIN sizes z USING (source, part_idx))""", "SELECT source, part_idx, 'not done' AS reason FROM ps WHERE s <> 'DONE' UNION ALL SELECT source, part_idx, 'no output' FROM ps WHERE n_out = 0 AND n_src > 0 UNION ALL SELECT source, part_idx, 'line count' FROM ps WHERE n_out > 0 AND n_out <> n_src UNION ALL SELECT source, part_idx, 'review' FROM ps WHERE s <> '' AND part_idx % 4 = 0"),
    "quote_fix": sql(values("t", samples.QUOTES, "id, src, cur") + "," + _QUOTE, "SELECT * FROM fixed"),
    "quote_stats": sql(values("t", samples.QUOTES, "id, src, cur") + "," + _QUOTE, "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM fixed) WHERE tag <> '' GROUP BY 1"),
    "norm_lang": sql(values("t", samples.LANGS, "id, code") + f", u AS (SELECT id, {_NORM} AS c, lower({strip('''coalesce(code, '')''')}) AS k FROM t)", f"SELECT id, CASE WHEN c IN ({', '.join(map(lit, L.ZH_HANS))}) THEN 'zh-hans' WHEN c IN ({', '.join(map(lit, L.ZH_HANT))}) THEN 'zh-hant' ELSE split_part(c, '-', 1) END AS lang, {_NAME} AS name FROM u"),
    "sanitize_title": sql(values("t", samples.TITLES, "id, raw") + "," + _TITLE_STEPS, "SELECT id, title FROM z"),
    "out_name": sql(values("t", samples.TITLES, "id, raw") + "," + _TITLE_STEPS, "SELECT id, CASE WHEN title IS NOT NULL AND title <> 'x' THEN title || '.txt' ELSE 'x_translated.txt' END AS file FROM z"),
    "prompts": sql(_LABELS + ", nl AS (SELECT source, part_idx, count(*) AS n FROM pu GROUP BY 1, 2)", "SELECT s.source, s.part_idx, sha256('part: ' || part_id || chr(10) || 'chapter: ' || chapter_label || chr(10) || 'lines: ' || n || chr(10) || chr(10) || t) AS user_sha, least(greatest(floor(char_count * 1.6), 4096), 32000)::INT AS max_tokens FROM slices s JOIN labels USING (source, part_idx) JOIN nl USING (source, part_idx)"),
    "prompt_blocks": sql(values("t", samples.LANGS, "id, code"), "SELECT id, 'head' || CASE WHEN starts_with(lower(trim(coalesce(code, ''))), 'ja') THEN ',ruby' ELSE '' END || CASE WHEN starts_with(lower(trim(coalesce(code, ''))), 'ja') OR starts_with(lower(trim(coalesce(code, ''))), 'ko') THEN ',keigo' ELSE '' END || CASE WHEN id % 2 = 0 THEN ',genre' ELSE '' END AS blocks FROM t"),
    "conversation_pairs": f"WITH a AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT conv_id, turn, {strip('text')} AS s, {strip('t2')} AS t FROM a WHERE role = 'user' AND r2 = 'assistant'), c AS (SELECT *, CASE WHEN length(s) >= 8 AND t IS NOT NULL THEN length(t) / length(s)::DOUBLE END AS r FROM b) SELECT conv_id, turn, r AS unit_ratio, coalesce(length(s) >= 15 AND (length(t) <= 2 OR length(t) < greatest(2, floor(length(s) * 0.15))), false) OR (s IS NOT NULL AND t IS NULL) AS short, {_LEVEL} AS ratio_level, s IS NOT NULL AND t IS NULL AND (length(s) <= 3 OR regexp_matches(s, '^[^\\p{{L}}\\p{{N}}]+$')) AS special_missing FROM c",
    "plan_parts": sql(_PLANNED, "SELECT source, i::INT AS part_idx, x.s AS start_char, x.e AS end_char, x.f AS forced_cut, x.l AS cut_level FROM (SELECT source, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM absorbed)"),
    "manifest": sql(_MANIFEST, "SELECT source, part_count, total_char_count, total_byte_count, sha256(doc) AS manifest_sha256, to_json(plain)::VARCHAR AS parts FROM md"),
    "audit": sql(_AUDIT, "SELECT source, code, level, count(*) AS n FROM found GROUP BY 1, 2, 3"),
    "self_check": sql(SLICES + "," + _V4 + f", lost AS (SELECT DISTINCT source FROM slices WHERE part_idx = 2 AND {NUM} % 4 = 0)", f"SELECT * FROM v4 UNION ALL SELECT source, NULL, 2, 'V5', 'sums of parts differ' FROM lost UNION ALL SELECT source, NULL, 2, 'V6', 'parts do not give the text again' FROM lost UNION ALL SELECT source, part_id, 2, 'V7', char_count || ' characters' FROM slices WHERE char_count > 20000 AND NOT (part_idx = 2 AND {NUM} % 4 = 0)"),
    "status_report": sql(_STATE + f", pr AS (SELECT source, format('part_{{:03d}}', part_idx) AS pid, review, CASE WHEN part_idx = {NUM} + 2 AND {NUM} % 4 = 0 THEN 'NEEDS_REVIEW' ELSE status END AS s FROM ps)", "SELECT source, count(*) AS n_parts, " + ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {c}" for s, c in (("PENDING", "pending"), ("IN_PROGRESS", "in_progress"), ("NEEDS_REVIEW", "in_review"), ("DONE", "done"), ("FAILED", "failed"))) + ", min(pid) FILTER (WHERE s <> 'DONE') AS current, " + ", ".join(f"coalesce(string_agg(pid, ',' ORDER BY pid) FILTER (WHERE {w}), '') AS {c}" for w, c in (("s = 'IN_PROGRESS'", "hanging"), ("s = 'FAILED'", "failed_parts"), ("review", "review_parts"))) + " FROM pr GROUP BY 1"),
    "hanging_parts": sql(OUTS + _STATE[len(PLAN):], "SELECT p.source, p.part_idx, CASE WHEN o.text IS NOT NULL THEN 'output' WHEN p.part_idx % 3 = 0 THEN 'draft' ELSE 'nothing' END AS found, CASE WHEN o.text IS NOT NULL THEN 'read it, then settle' WHEN p.part_idx % 3 = 0 THEN 'keep or discard it, then run again' ELSE 'run again' END AS advice FROM ps p LEFT JOIN outs o ON o.source = p.source AND o.part_idx = p.part_idx AND o.part_idx % 2 = 0 WHERE status = 'IN_PROGRESS'"),
    "verify_writeback": sql(_QA_ALL + _STATE[len(PLAN):], "SELECT st.source, st.part_idx, status, ['PASS', 'WARN', 'FAIL'][level + 1] AS verify, CASE WHEN level IS NOT NULL THEN array_to_string(list_sort([" + ", ".join(f"'{code}=' || ['PASS', 'WARN', 'FAIL'][{c} + 1]" for c, code in _CODES.items() if c != "part_ratio_level") + "]), ',') END AS checks, coalesce(n_src, -1) AS n_src, coalesce(n_out - n_src, 0) AS delta, coalesce(ratio, -1.0) AS ratio, CASE WHEN level IS NOT NULL THEN level > 0 ELSE review END AS needs_human_review FROM st LEFT JOIN ql USING (source, part_idx)"),
    "settle_decisions": sql(_QA + _STATE[len(PLAN):] + "," + _SET, "SELECT source, part_idx, decision, decision = 'done' AND level > 0 AS needs_human_review FROM (SELECT r.source, r.part_idx, coalesce(level, 2) AS level, CASE WHEN s NOT IN ('IN_PROGRESS', 'NEEDS_REVIEW') THEN 'not open' WHEN coalesce(z.n_out, 0) = 0 OR r.part_idx % 7 = 0 THEN 'no output' WHEN r.part_idx % 5 = 0 THEN 'not confirmed' WHEN coalesce(level, 2) = 2 THEN 'fails its checks' ELSE 'done' END AS decision FROM rows r LEFT JOIN ql USING (source, part_idx) LEFT JOIN sizes z USING (source, part_idx))"),
    "banded_ratios": sql(_CAL, "SELECT source, CASE WHEN r < coalesce(fl, 0.3) OR r > coalesce(fh, 2.5) THEN 2 WHEN r < coalesce(wl, 0.45) OR r > coalesce(wh, 1.8) THEN 1 ELSE 0 END AS ratio_level, count(*) AS n FROM pc LEFT JOIN bands USING (source) GROUP BY 1, 2"),
    "marked_lines": sql(LINES, " UNION ALL ".join(f"SELECT source, part_idx, {i + 1} AS pattern, '{name}' AS name, count(*) AS n, arg_min(left(line, 40), oi) AS sample FROM lines WHERE regexp_matches(line, '{re2(p)}') GROUP BY 1, 2" for i, (name, p) in enumerate(qa.FORBIDDEN))),
    "context_blocks": sql(_BLOCK, "SELECT source, part_idx, length(context)::INT AS chars, sha256(context) AS sha256, array_to_string(hits, '|') AS hits FROM bx"),
    "punctuation_pass": sql(_PASS, "SELECT source, part_idx, sha256(string_agg(line, chr(10) ORDER BY oi)) AS sha256, bool_and(fits) AS fits, count(*) FILTER (WHERE cur <> line) AS changed, coalesce(sum(CASE WHEN tags <> '' THEN len(string_split(tags, ',')) ELSE 0 END), 0)::INT AS n_tags, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN tags <> '' THEN string_split(tags, ',') ELSE [] END)))), ',') AS tags FROM pl GROUP BY 1, 2"),
    "clean_documents": f"WITH t AS (SELECT 'd' AS kind, doc_id AS id, 0::BIGINT AS turn, text AS raw, text AS t FROM documents UNION ALL SELECT 'c', conv_id, turn, text, text FROM conversations), c AS (SELECT *, coalesce(array_to_string(list_transform(list_filter(string_split(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '{_FENCE}') AND NOT regexp_matches(x, '{_CHAT}') AND {strip('x')} <> ''), lambda x: {strip('x')}), chr(10)), '') AS clean FROM t) SELECT kind, id, turn, sha256(clean) AS sha256, length(clean)::INT AS chars, {_KR} AS kana, {_KR} > 0.15 AS residue FROM c",
    "document_titles": sql("t AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS raw FROM documents)," + _TITLE_STEPS, "SELECT id, title, CASE WHEN title IS NOT NULL AND title <> 'x' THEN title || '.txt' ELSE 'x_translated.txt' END AS file FROM z"),
    "document_langs": f"WITH u AS (SELECT doc_id AS id, lang, lang AS k FROM documents) SELECT id, lang, {_NAME} AS name, lang AS source_lang, 'zh-hant' AS target_lang FROM u",
}
