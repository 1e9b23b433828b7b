"""DuckDB SQL for the registered queries that SQL can express. Literals are cast: bare ones are decimals."""

from __future__ import annotations

SP = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
BASE = """
L as (select doc_id, i - 1 as idx, ls[i] as line from (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)),
B as (
  select doc_id as page_id, cast(idx as integer) as block_id, line as text, full_w,
    case when full_w then cast(50 as double) else cast(50 as double) + (idx % ncols) * (cast(495 as double) / ncols) + (len % 5) end as x0,
    cast(60 as double) + ((idx - idx % ncols) / ncols) * cast(24 as double) as y0,
    case when full_w then cast(545 as double)
         else cast(50 as double) + (idx % ncols) * (cast(495 as double) / ncols) + (cast(495 as double) / ncols) - cast(20 as double) - (idx % 7) end as x1,
    cast(60 as double) + ((idx - idx % ncols) / ncols) * cast(24 as double) + cast(8 as double) + (len % 12) as y1,
    cast(5 as double) + (len % 12) as max_size, idx % 5 = 0 as bold
  from (select doc_id, idx, line, length(line) as len, 1 + doc_id % 4 as ncols, idx % 11 = 10 as full_w from L where length(trim(line)) > 0) q),
Z as (
  select doc_id as page_id, k as seq, cast(50 as double) + doc_id % 5 * 20 + k * 240 as x0, cast(80 + 40 * k as double) as y0,
    cast(50 as double) + doc_id % 5 * 20 + k * 240 + 200 as x1, cast(160 as double) + doc_id % 7 * 60 + k * 40 as y1
  from documents, (select unnest([0, 1]) as k) ks),
T as (
  select doc_id as page_id, cast(50 as double) as x0, cast(300 as double) as y0, cast(case when doc_id % 3 = 0 then 545 else 210 end as double) as x1,
    cast(420 as double) as y1, case when doc_id % 3 = 1 then 1 else 3 - doc_id % 3 end as row_count, case when doc_id % 3 = 0 then 3 else 2 end as col_count
  from documents)"""
OVERLAP = "greatest(cast(0 as double), least(b.x1, z.x1) - greatest(b.x0, z.x0)) * greatest(cast(0 as double), least(b.y1, z.y1) - greatest(b.y0, z.y0))"
AREA = "((b.x1 - b.x0) * (b.y1 - b.y0))"
WIDE = "(b.x1 - b.x0) >= cast(0.6 as double) * 595"
BAND = "least(cast(0.07 as double) * 842, cast(70 as double))"
CLEAR = f"b.y1 > {BAND} and b.y0 < 842 - {BAND}"
INSIDE = "b.x0 >= t.x0 - 2 and b.x1 <= t.x1 + 2 and b.y0 >= t.y0 - 2 and b.y1 <= t.y1 + 2"
DATA_TABLE = "not (t.row_count <= 1 and t.col_count <= 2)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def column_md(b: str = "b") -> str:
    line = strip(f"case when {b}.bold then '**' || {b}.text || '**' else {b}.text end")
    return f"case when {b}.max_size >= 14 then '# ' when {b}.max_size >= 12 then '## ' when {b}.max_size >= cast(9.8 as double) and {b}.bold then '### ' else '' end || {line}"


def plain_md(b: str = "b") -> str:
    return strip(f"case when {b}.bold then '**' || {b}.text || '**' else {b}.text end")


def split_ctes(src: str, p: str) -> str:
    return f"""
{p}n as (select *, count(*) over (partition by page_id) as cnt from {src} where x1 - x0 < cast(0.6 as double) * 595),
{p}w as (select page_id, x0, x1, max(x1) over (partition by page_id order by x0, x1 rows between unbounded preceding and 1 preceding) as pm from {p}n where cnt >= 4),
{p}i as (select *, sum(case when pm is null or x0 > pm + 3 then 1 else 0 end) over (partition by page_id order by x0, x1 rows between unbounded preceding and current row) as isl from {p}w),
{p}m as (select page_id, min(x0) as a, max(x1) as b from {p}i group by page_id, isl),
{p}k as (select * from {p}m where not (b - a < 40 and (a < 30 or b > 595 - 30))),
{p}g as (select page_id, a, b, lead(a) over (partition by page_id order by a) as na from {p}k),
{p}x as (select *, na - b as gap, (b + na) / 2 as mid, max(na - b) over (partition by page_id) as widest from {p}g where na is not null),
{p}s as (select page_id, mid as split, cast(row_number() over (partition by page_id order by a) - 1 as integer) as seq from {p}x where gap >= 8 and gap >= cast(0.55 as double) * widest)"""


def q(body: str, *more: str) -> str:
    return "with recursive " + ", ".join([BASE, *more]) + body


C = f"C as (select b.* from B b where {CLEAR})"
BODY = f"""
D as (select t.* from T t where {DATA_TABLE}),
Y as (select b.* from B b where b.max_size >= cast(6.5 as double) and b.x1 - b.x0 >= 25 and not ({WIDE})
  and not exists (select 1 from D t where t.page_id = b.page_id and {INSIDE})),
YC as (select b.* from Y b where {CLEAR})"""
PROFILE = f"""
S as (select page_id, count(*) as n_splits from ps group by page_id),
A as (select b.*, (select count(*) from ps s where s.page_id = b.page_id and (b.x0 + b.x1) / 2 > s.split) as col from Y b),
E as (select page_id, min(col) as lo, max(col) as hi from A group by page_id),
O as (select distinct a.page_id from A a join E e on a.page_id = e.page_id and a.col = e.lo and e.lo < e.hi
  join A c on c.page_id = a.page_id and c.col = e.hi and a.y0 <= c.y1 and c.y0 <= a.y1),
N as (select page_id, count(*) as n, count(*) filter (max_size < cast(7.5 as double)) as small,
  count(*) filter (regexp_matches(text, '^[\\s\\p{{Z}}]*\\p{{Nd}}+\\.')) as numbered,
  count(*) filter (regexp_matches(text, ',[\\s\\p{{Z}}]*\\p{{Nd}}{{1,4}}([–\\-]\\p{{Nd}}{{1,4}})?[a-z]?([^\\p{{L}}\\p{{N}}_]|$)')) as entries from Y group by page_id),
F as (
  select d.doc_id as page_id, cast(coalesce(s.n_splits, 0) + 1 as integer) as columns, cast(coalesce(s.n_splits, 0) as integer) as n_splits,
    coalesce(s.n_splits, 0) > 0 and o.page_id is not null as columns_overlap, t.page_id is not null as has_tables,
    case when t.page_id is not null and t.x1 - t.x0 >= cast(0.6 as double) * 595 then 1 else 0 end as full_width_tables,
    coalesce(n.small, 0) > 0 as has_small_text,
    coalesce(s.n_splits, 0) >= 1 and coalesce(n.small, 0) > 0 and n.numbered >= cast(0.5 as double) * n.n as has_references,
    coalesce(s.n_splits, 0) >= 2 and coalesce(n.n, 0) > 0 and n.entries >= cast(0.5 as double) * n.n as has_index,
    cast(coalesce(n.n, 0) as integer) as body_blocks
  from documents d left join S s on s.page_id = d.doc_id left join O o on o.page_id = d.doc_id left join D t on t.page_id = d.doc_id left join N n on n.page_id = d.doc_id)"""
PROFILED = (BODY, split_ctes("YC", "p"), PROFILE)
GRID = f"""
G as (select page_id, y0, x0, x1, block_id, {collapse("text")} as t, row_number() over (partition by page_id order by y0, x0, block_id) as rn from K where {collapse("text")} <> ''),
R as (select page_id, rn, y0 as anchor, 0 as row from G where rn = 1
  union all
  select g.page_id, g.rn, case when abs(r.anchor - g.y0) < 5 then r.anchor else g.y0 end, case when abs(r.anchor - g.y0) < 5 then r.row else r.row + 1 end
  from R r join G g on g.page_id = r.page_id and g.rn = r.rn + 1)"""
KEPT = f"V as (select b.* from B b where b.max_size >= cast(6.5 as double)), VC as (select b.* from V b where {CLEAR})"
ORDER = f"""
W as (select b.page_id, b.y0, b.block_id, {plain_md()} as md from V b where {WIDE}),
M as (select *, row_number() over (partition by page_id order by y0, block_id) - 1 as k from W where md <> ''),
X as (
  select b.page_id, (select count(*) from M m where m.page_id = b.page_id and b.y0 >= m.y0) as band, 0 as sep,
    (select count(*) from rs s where s.page_id = b.page_id and (b.x0 + b.x1) / 2 > s.split) as col, b.y0, b.x0, b.block_id as i, {column_md()} as md
  from V b where not ({WIDE}) and b.x1 - b.x0 >= 25
  union all select page_id, k, 1, 0, y0, 0, k, md from M)"""
PARAS = """
U as (select doc_id, i - 1 as para, ps[i] as unit from (
  select doc_id, string_split(text, chr(10)) as ps, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"""
TOC = "Q as (select page_id, cast(block_id as bigint) as seq, cast(1 + length(text) % 3 as integer) as level, cast(block_id + length(text) % 5 as bigint) as page_idx from B)"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
TOKEN = "@@[A-Z]+[0-9]+@@"
DIRTY = "replace(text, 'er ', 'e-' || chr(10) || ' r') || ' **12**end _a_,_b_ In' || chr(173) || '-Hos—p|x'"

def overlap(a: str, z: str) -> str:
    return f"greatest(cast(0 as double), least({a}.x1, {z}.x1) - greatest({a}.x0, {z}.x0)) * greatest(cast(0 as double), least({a}.y1, {z}.y1) - greatest({a}.y0, {z}.y0))"


def covered(a: str, z: str) -> str:
    return f"{z}.page_id = {a}.page_id and {overlap(a, z)} / (({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0)) >= cast(0.5 as double)"


def within(b: str, r: str) -> str:
    return f"{r}.page_id = {b}.page_id and {b}.x0 >= {r}.x0 - 2 and {b}.x1 <= {r}.x1 + 2 and {b}.y0 >= {r}.y0 - 2 and {b}.y1 <= {r}.y1 + 2"


def visible(tables: str, exclude: str) -> str:
    """Zones that exclude, tables that count, blocks that are seen; the conditions are on T t and Z z."""
    return f"""
XZ as (select * from Z z where {exclude}),
D as (select t.* from T t where {tables} and not exists (select 1 from XZ z where {covered("t", "z")})),
VB as (select b.* from B b where not exists (select 1 from XZ z where {AREA} > 0 and {covered("b", "z")}))"""


def drawn(drawings: str) -> str:
    """Boxes of the zones z that are drawings: with text, outside tables and excluded zones; title and markdown."""
    return f"""
RB as (select z.* from Z z where {drawings} and not exists (select 1 from XZ x where {covered("z", "x")}) and not exists (select 1 from D t where {covered("z", "t")})),
RL as (select z.page_id, z.seq, z.x0, z.y0, z.x1, z.y1, list({collapse("b.text")} order by b.block_id) filter ({collapse("b.text")} <> '') as ls, {strip("string_agg(b.text, chr(10) order by b.block_id)")} as whole
  from RB z join B b on {within("b", "z")} group by all),
BX as (select r.page_id, r.seq, r.x0, r.y0, r.x1, r.y1,
    (select arg_min({collapse("b.text")}, b.block_id) from VB b where b.page_id = r.page_id and b.y1 <= r.y0 and b.y1 >= r.y0 - 30 and b.x0 >= r.x0 - 40 and b.x1 <= r.x1 + 40 and {collapse("b.text")} <> '') as title,
    '| ' || ls[1] || ' |' || chr(10) || '| --- |' || array_to_string(list_transform(ls[2:], lambda x: chr(10) || '| ' || x || ' |'), '') as md
  from RL r where whole <> '' and (len(ls) >= 2 or length(whole) >= 30))"""


TABLE_MD = """
P1 as (select r.page_id, r.row, list(g.t order by g.x0, g.block_id) as ts, min(g.x0) as a, max(g.x1) as b from R r join G g on g.page_id = r.page_id and g.rn = r.rn group by r.page_id, r.row),
P2 as (select page_id, max(len(ts)) as widest from P1 group by page_id),
P3 as (select p.page_id, array_to_string(p.ts, ' ') as cap from P1 p join P2 w on w.page_id = p.page_id join T t on t.page_id = p.page_id where p.row = 0 and (len(p.ts) = 1
  or (len(p.ts) < w.widest and p.b - p.a >= cast(0.9 as double) * (t.x1 - t.x0) and regexp_matches(array_to_string(p.ts, ' '), '(?i)^[\\s\\p{Z}]*(table|fig(ure)?|box|exhibit|chart)([^\\p{L}\\p{N}_]|$)')))),
P4 as (select p.*, row_number() over (partition by p.page_id order by p.row) as k, max(len(p.ts)) over (partition by p.page_id) as n from P1 p where not (p.row = 0 and p.page_id in (select page_id from P3))),
P5 as (select page_id, k, n, '| ' || array_to_string(list_transform(range(1, n + 1), lambda i: coalesce(ts[i], '')), ' | ') || ' |' as line from P4),
P6 as (select page_id, string_agg(case when k = 1 then line || chr(10) || '| ' || array_to_string(list_transform(range(0, n), lambda i: '---'), ' | ') || ' |' else line end, chr(10) order by k) as body from P5 group by page_id),
PT as (select d.doc_id as page_id, case when c.page_id is not null then '**' || c.cap || '**' || chr(10) || case when b.body is not null then chr(10) else '' end else '' end || coalesce(b.body, '') as md
  from documents d left join P3 c on c.page_id = d.doc_id left join P6 b on b.page_id = d.doc_id)"""
IN_TABLE = f"K as (select b.* from B b join T t on t.page_id = b.page_id and {INSIDE})"
#: The page in reading order, as RO (page_id, md), from VB, D, BX and PT.
READING = (
    f"""
VV as (select b.* from VB b where (b.max_size >= cast(6.5 as double) or exists (select 1 from D t where t.page_id = b.page_id and b.max_size >= 5
    and b.y0 >= t.y1 - 4 and b.y0 - t.y1 <= 45 and b.x0 >= t.x0 - 30 and b.x1 <= t.x1 + 30)) and not exists (select 1 from D t where {within("b", "t")})),
VQ as (select b.* from VV b where {CLEAR})""",
    split_ctes("VQ", "v"),
    f"""
OU as (select b.* from VV b where not exists (select 1 from BX r where {within("b", "r")}) and not exists (select 1 from BX r where r.page_id = b.page_id and r.title <> '' and r.title = {collapse("b.text")})),
TM as (select t.page_id, t.x0, t.y0, t.x1, p.md from D t join PT p on p.page_id = t.page_id where p.md <> ''),
XM as (select page_id, seq as i, x0, y0, x1, case when coalesce(title, '') <> '' then '**' || title || '**' || chr(10) || chr(10) || md else md end as md from BX),
SP as (
  select b.page_id, b.y0, 0 as kind, b.block_id as i, {plain_md()} as md from OU b where {WIDE}
  union all select b.page_id, b.y0, 1, 0, b.md from TM b where {WIDE} union all select b.page_id, b.y0, 2, b.i, b.md from XM b where {WIDE}),
SO as (select *, row_number() over (partition by page_id order by y0, kind, i) - 1 as k from SP where md <> ''),
IT as (
  select b.page_id, b.x0, b.x1, b.y0, 0 as kind, b.block_id as i, {column_md()} as md from OU b where not ({WIDE}) and b.x1 - b.x0 >= 25
  union all select b.page_id, b.x0, b.x1, b.y0, 1, 0, b.md from TM b where not ({WIDE}) union all select b.page_id, b.x0, b.x1, b.y0, 2, b.i, b.md from XM b where not ({WIDE})),
AL as (
  select b.page_id, (select count(*) from SO m where m.page_id = b.page_id and b.y0 >= m.y0) as band, 0 as sep,
    (select count(*) from vs s where s.page_id = b.page_id and (b.x0 + b.x1) / 2 > s.split) as col, b.y0, b.x0, b.kind, b.i, b.md from IT b
  union all select page_id, k, 1, 0, y0, 0, 0, k, md from SO),
RO as (select d.doc_id as page_id, coalesce(x.md, '') as md from documents d left join (
  select page_id, string_agg(md, chr(10) || chr(10) order by band, sep, col, y0, x0, kind, i) as md from AL where md <> '' group by page_id) x on x.page_id = d.doc_id)""",
)
#: Page profiles, as F, from VB and D instead of all blocks and tables.
SEEN = (
    f"""
Y as (select b.* from VB b where b.max_size >= cast(6.5 as double) and b.x1 - b.x0 >= 25 and not ({WIDE}) and not exists (select 1 from D t where {within("b", "t")})),
YC as (select b.* from Y b where {CLEAR})""",
    split_ctes("YC", "p"),
    PROFILE,
)


def line_md(text: str, bold: str, italic: str) -> str:
    mark = f"case when {bold} and {italic} then '***' when {bold} then '**' when {italic} then '*' else '' end"
    return strip(f"{mark} || {text} || {mark}")


SPACED = "regexp_replace(regexp_replace({0}, '\\*\\*(\\p{{Nd}}+)\\*\\*([^\\s\\p{{Z}}])', '**\\1** \\2', 'g'), '(_[^_]+_),', '\\1, ', 'g')"

#: READING with the titles of the first column (14 points and more) taken out of their columns and put first.
TITLED = f"""
FS as (select page_id, min(split) as first from vs group by page_id),
TI as (select b.* from OU b left join FS s on s.page_id = b.page_id where not ({WIDE}) and b.x1 - b.x0 >= 25 and b.max_size >= 14 and b.x0 < coalesce(s.first, cast(596 as double))),
TA as (select b.page_id, string_agg({column_md()}, chr(10) || chr(10) order by b.max_size, b.block_id) as md from TI b group by b.page_id),
TR as (select page_id, string_agg(md, chr(10) || chr(10) order by band, sep, col, y0, x0, kind, i) as md from AL a where md <> ''
  and not (kind = 0 and sep = 0 and exists (select 1 from TI t where t.page_id = a.page_id and t.block_id = a.i)) group by page_id)"""

ORACLES: dict[str, str] = {
    "layout_blocks": q(" select page_id, block_id, text, x0, y0, x1, y1, max_size from B"),
    "zone_overlap": q(f" select b.page_id, b.block_id, z.seq, {OVERLAP} as overlap from B b join Z z on z.page_id = b.page_id where {OVERLAP} > 0"),
    "zone_exclusion": q(f" select b.page_id, b.block_id from B b where not exists (select 1 from Z z where z.page_id = b.page_id and {AREA} > 0 and {OVERLAP} / {AREA} >= cast(0.5 as double))"),
    "zone_inclusion_first": q(f" select b.page_id, b.block_id, min(z.seq) as zone from B b join Z z on z.page_id = b.page_id where {AREA} > 0 and {OVERLAP} / {AREA} >= cast(0.5 as double) group by b.page_id, b.block_id"),
    "margin_strip": q(" select page_id, block_id from C", C),
    "width_class": q(f" select page_id, case when {WIDE} then 'full' when b.x1 - b.x0 >= 25 then 'body' else 'dropped' end as kind, count(*) as n from B b group by 1, 2"),
    "column_intervals": q(" select page_id, cast(row_number() over (partition by page_id order by a) - 1 as integer) as seq, a, b from rk", C, split_ctes("C", "r")),
    "column_splits": q(" select page_id, seq, split from rs", C, split_ctes("C", "r")),
    "column_widest": q(" select page_id, arg_min(mid, a) as split from rx where gap = widest and widest >= 8 group by page_id", C, split_ctes("C", "r")),
    "column_assign": q(" select b.page_id, b.block_id, cast((select count(*) from rs s where s.page_id = b.page_id and (b.x0 + b.x1) / 2 > s.split) as integer) as col from B b", C, split_ctes("C", "r")),
    "column_reorder": q(
        """, I as (select page_id, min(split) as s from rs group by page_id),
        J as (select i.page_id, i.s, count(*) filter (c.x1 <= i.s) as l, count(*) filter (c.x0 >= i.s) as r from I i join H c on c.page_id = i.page_id group by all),
        O as (select distinct j.page_id from J j join H a on a.page_id = j.page_id and a.x1 <= j.s join H c on c.page_id = j.page_id and c.x0 >= j.s
          where j.l >= 2 and j.r >= 2 and a.y0 <= c.y1 and c.y0 <= a.y1)
        select doc_id as page_id, o.page_id is not null as needs from documents d left join O o on o.page_id = d.doc_id""",
        f"H as (select b.* from B b where b.max_size >= cast(6.5 as double) and not ({WIDE}) and b.x1 - b.x0 >= 25 and {CLEAR})",
        split_ctes("H", "r"),
    ),
    "page_profile": q(" select page_id, columns, n_splits, columns_overlap, has_tables, full_width_tables, has_small_text, coalesce(has_references, false) as has_references, coalesce(has_index, false) as has_index, body_blocks from F", *PROFILED),
    "fix_plan": q(" select page_id, case when columns >= 2 and columns_overlap then 'reorder_columns,spacing' else 'spacing' end as text_plan, case when columns >= 2 then 'dehyphenate,split_glued,spacing' else 'dehyphenate,spacing' end as layout_plan from F", *PROFILED),
    "fix_plan_override": q(" select page_id, case when columns >= 4 then 'dehyphenate,spacing' when has_tables and columns = 1 then 'reorder_columns' when columns >= 2 and columns_overlap then 'reorder_columns' else '' end as plan from F", *PROFILED),
    "block_markdown": q(f" select page_id, block_id, {column_md()} as column_md, {plain_md()} as plain_md from B b"),
    "reading_order": q(" select d.doc_id as page_id, coalesce(x.md, '') as md from documents d left join (select page_id, string_agg(md, chr(10) || chr(10) order by band, sep, col, y0, x0, i) as md from X where md <> '' group by page_id) x on x.page_id = d.doc_id", KEPT, split_ctes("VC", "r"), ORDER),
    "table_grid": q(" select r.page_id, cast(r.row as integer) as row, cast(count(*) as integer) as n_cells, sha1(string_agg(g.t, '|' order by g.x0, g.block_id)) as row_key from R r join G g on g.page_id = r.page_id and g.rn = r.rn group by r.page_id, r.row", "K as (select * from B)", GRID),
    "table_markdown": q(" select page_id, md from PT", IN_TABLE, GRID, TABLE_MD),
    "box_pages": q(" select page_id, seq, coalesce(title, '') as title, md from BX", visible("true", "false"), drawn("true")),
    "page_reading": q(
        " select page_id, md from RO",
        IN_TABLE, GRID, TABLE_MD, visible(f"t.page_id % 8 <> 3 and {DATA_TABLE}", "z.page_id % 8 = 2 or (z.page_id % 8 = 5 and z.seq = 1)"), drawn("z.page_id % 2 = 1"), *READING,
    ),
    "title_reading": q(
        " select d.doc_id as page_id, coalesce(a.md, '') || case when a.md is not null and r.md is not null then chr(10) || chr(10) else '' end || coalesce(r.md, '') as md from documents d left join TA a on a.page_id = d.doc_id left join TR r on r.page_id = d.doc_id",
        IN_TABLE, GRID, TABLE_MD, visible(f"t.page_id % 8 <> 3 and {DATA_TABLE}", "z.page_id % 8 = 2 or (z.page_id % 8 = 5 and z.seq = 1)"), drawn("z.page_id % 2 = 1"), *READING, TITLED,
    ),
    "page_texts": q(
        f""", PL as (select f.page_id, f.page_id % 8 = 1 as inc, f.page_id % 8 = 2 as exc, case when f.page_id % 8 = 1 then '' when f.columns >= 2 and f.columns_overlap and f.page_id % 8 <> 2 then 'reorder_columns,spacing' else 'spacing' end as plan from F f),
        IB as (select b.page_id, b.block_id, b.y0, b.x0, min(z.seq) as zone, any_value({column_md()}) as md from B b join Z z on {covered("b", "z")} and {AREA} > 0 where b.page_id % 8 = 1 group by b.page_id, b.block_id, b.y0, b.x0),
        IC as (select page_id, string_agg(md, chr(10) || chr(10) order by zone, y0, x0, block_id) as md from IB where md <> '' group by page_id),
        NW as (select p.*, coalesce(d.text, '') as raw, r.md as reading, coalesce(c.md, '') as included from PL p join documents d on d.doc_id = p.page_id join RO r on r.page_id = p.page_id left join IC c on c.page_id = p.page_id),
        ST as (select *, case when (exc or plan like 'reorder%') and reading <> '' then reading else raw end as base from NW),
        FT as (select *, case when plan like '%spacing' then {SPACED.format("base")} else base end as fixed from ST),
        TX as (select *, case when inc and included <> '' then included when fixed <> '' then fixed else base end as text from FT)
        select page_id, case when inc or exc then 'manual' else 'auto' end as label, plan, sha1(text) as text_key, cast(length(text) as integer) as n_chars from TX""",
        IN_TABLE, GRID, TABLE_MD, visible(f"t.page_id % 8 >= 4 and {DATA_TABLE}", "z.page_id % 8 = 2"), drawn("false"), *READING, *SEEN,
    ),
    "block_lines_markdown": f"""with {BASE},
        H as (select page_id, block_id, max_size, bold or false as any_bold, {line_md("substr(text, 1, length(text) // 2)", "(block_id % 5 = 0)", "(block_id % 3 = 0)")} as a, {line_md("substr(text, length(text) // 2 + 1)", "false", "(block_id % 2 = 0)")} as b from B)
        select page_id, block_id, a || ' ' || b as plain_md, case when max_size >= 14 then '# ' || a || ' ' || b when max_size >= 12 then '## ' || a || case when b <> '' then chr(10) || chr(10) || b else '' end
          when max_size >= cast(9.8 as double) and any_bold then '### ' || a || case when b <> '' then chr(10) || chr(10) || b else '' end else a || ' ' || b end as column_md from H""",
    "glued_split": q(
        f""", W as (select page_id, arg_min(mid, a) as split from rx where gap = widest and widest >= 8 group by page_id),
        S as (select b.page_id, b.block_id, b.text, (b.x0 + b.x1) / 2 <= w.split as is_left from B b join W w on w.page_id = b.page_id),
        N as (select page_id, arg_min(text, block_id) filter (is_left) || ' ' || arg_min(text, block_id) filter (not is_left) as glued,
          trim(lower({collapse("string_agg(text, chr(10) order by block_id) filter (is_left)")})) as l, trim(lower({collapse("string_agg(text, chr(10) order by block_id) filter (not is_left)")})) as r from S group by page_id),
        O as (select page_id, coalesce(glued, '') as glued, coalesce(l, '') as l, coalesce(r, '') as r, string_split({collapse("coalesce(glued, '')")}, ' ') as ws from N),
        P as (select *, len(ws) as n, lower(array_to_string(ws, ' ')) as norm,
          coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda k: contains(l, lower(array_to_string(ws[1:k], ' '))))), 0) as k,
          list_min(list_filter(range(1, len(ws) + 1), lambda j: contains(r, lower(array_to_string(ws[j:], ' '))))) as j from O),
        Q2 as (select *, length(lower(array_to_string(ws[1:k], ' '))) as p, length(lower(array_to_string(ws[j:], ' '))) as s from P)
        select d.doc_id as page_id, coalesce(x.glued, '') as glued, coalesce(case when x.n >= 8 and x.k > 0 and x.j is not null and length(x.norm) - 1 <= x.p + x.s and x.p < length(x.norm) - x.s and x.k >= 3 and x.k <= x.n - 3
          then array_to_string(x.ws[1:x.k], ' ') || chr(10) || chr(10) || array_to_string(x.ws[x.k + 1:], ' ') else {strip("x.glued")} end, '') as cut from documents d left join Q2 x on x.page_id = d.doc_id""",
        C,
        split_ctes("C", "r"),
    ),
    "legend_blocks": q(" select b.page_id, b.block_id from B b join T t on t.page_id = b.page_id where b.max_size < cast(6.5 as double) and b.max_size >= 5 and b.y0 >= t.y1 - 4 and b.y0 - t.y1 <= 45 and b.x0 >= t.x0 - 30 and b.x1 <= t.x1 + 30"),
    "box_titles": q(f" select z.page_id, z.seq, arg_min({collapse('b.text')}, b.block_id) as title from Z z left join B b on b.page_id = z.page_id and b.y1 <= z.y0 and b.y1 >= z.y0 - 30 and b.x0 >= z.x0 - 40 and b.x1 <= z.x1 + 40 and {collapse('b.text')} <> '' group by z.page_id, z.seq"),
    "inclusion_reading": q(f""", I as (select b.page_id, b.block_id, b.y0, b.x0, min(z.seq) as zone, any_value({column_md()}) as md from B b join Z z on z.page_id = b.page_id where {AREA} > 0 and {OVERLAP} / {AREA} >= cast(0.5 as double) group by b.page_id, b.block_id, b.y0, b.x0)
        select d.doc_id as page_id, coalesce(x.md, '') as md from documents d left join (select page_id, string_agg(md, chr(10) || chr(10) order by zone, y0, x0, block_id) as md from I where md <> '' group by page_id) x on x.page_id = d.doc_id"""),
    "text_normal_forms": f"""with X as (select doc_id, {DIRTY} as t from documents)
        select doc_id as page_id, sha1(regexp_replace(t, '([\\p{{L}}\\p{{N}}_])-{SP}*\\n{SP}*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')) as dehyphenated,
          sha1(lower({collapse("regexp_replace(replace(t, chr(173), ''), '[|—-]', ' ', 'g')")})) as strip_key,
          sha1(trim(lower(regexp_replace(regexp_replace(t, '-{SP}*\\n{SP}*', '', 'g'), '{SP}+', ' ', 'g')))) as reading_key,
          sha1(regexp_replace(regexp_replace(t, '\\*\\*(\\p{{Nd}}+)\\*\\*([^\\s\\p{{Z}}])', '**\\1** \\2', 'g'), '(_[^_]+_),', '\\1, ', 'g')) as spaced from X""",
    "header_keys": "select doc_id as page_id, sha1(case when doc_id % 2 = 0 then ltrim(text, chr(10)) else text end) as key, cast(length(text) + case when doc_id % 2 = 0 then length('── 12.5 ms │ ' || length(text) || ' chars │ auto │ eng ──') + 2 else 0 end as integer) as n_shown from documents",
    "paragraph_units": f"with {PARAS} select doc_id as page_id, cast(para as integer) as para, sha1(unit) as unit_key, regexp_matches(regexp_replace(unit, '{TOKEN}', '', 'g'), '{LETTER}') as needed from U",
    "translate_units": f"with {PARAS} select doc_id as page_id, sha1(string_agg(case when regexp_matches(unit, '{LETTER}') then '[' || unit || ']' else unit end, chr(10) || chr(10) order by para)) as text_key from U group by doc_id union all select doc_id, null from documents where text is null",
    "toc_parent": q(" select a.page_id, a.seq, a.level, (select max(b.seq) from Q b where b.page_id = a.page_id and b.seq < a.seq and b.level < a.level) as parent_seq from Q a", TOC),
    "toc_asof": q(""", I as (select page_id, seq, max(page_idx) over (partition by page_id order by seq rows between unbounded preceding and current row) as top from Q)
        select d.doc_id as page_id, n.page_num, max(i.seq) as toc_seq from documents d cross join (select unnest([0, 3, 9, 27]) as page_num) n left join I i on i.page_id = d.doc_id and i.top <= n.page_num group by d.doc_id, n.page_num""", TOC),
    "edit_overlay": q(""", I as (select page_id, sha1(text) as key, 'edit ' || min(block_id) as edited from B where block_id % 3 = 0 group by page_id, sha1(text))
        select b.page_id, b.block_id, sha1(coalesce(i.edited, b.text)) as shown_key from B b left join I i on i.page_id = b.page_id and i.key = sha1(b.text)"""),
    "latest_generation": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) x where k = 1",
    "debounce_last": "select user_id, event_id from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) x where nxt is null or epoch_us(nxt) - epoch_us(ts) > 3600000000",
    "cache_missing": "select distinct user_id, props->>'$.k' as k from events e where not exists (select 1 from events c where c.event_type = 'click' and c.user_id = e.user_id and c.props->>'$.k' = e.props->>'$.k')",
    "box_dedup": q(
        """, O as (select *, (x1 - x0) * (y1 - y0) as area, row_number() over (partition by page_id order by (x1 - x0) * (y1 - y0) desc, block_id) as rn from
          (select page_id, block_id, x0, y0, x1 + max_size * 8 as x1, y1 + max_size * 4 as y1 from B) e where (x1 - x0) * (y1 - y0) > 0),
        R as (select page_id, rn, [{'id': block_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] as kept from O where rn = 1
          union all
          select o.page_id, o.rn, case when len(list_filter(r.kept, lambda k: greatest(cast(0 as double), least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(cast(0 as double), least(o.y1, k.y1) - greatest(o.y0, k.y0)) / o.area >= cast(0.6 as double))) > 0
            then r.kept else list_append(r.kept, {'id': o.block_id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) end
          from R r join O o on o.page_id = r.page_id and o.rn = r.rn + 1),
        M as (select page_id, arg_max(kept, rn) as kept from R group by page_id)
        select page_id, k.id as block_id from (select page_id, unnest(kept) as k from M) u"""
    ),
    "sentence_chunks": f"""with recursive X as (select doc_id, length(text) as n, case when length(text) <= 300 then [text] else string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)) end as ss from documents),
        S as (select doc_id, i, ss[i] as s from (select doc_id, ss, unnest(range(1, len(ss) + 1)) as i from X) u),
        R as (select doc_id, i, length(s) as n, 0 as seq from S where i = 1
          union all
          select s.doc_id, s.i, case when r.n + length(s.s) > 300 then length(s.s) else r.n + length(s.s) end, case when r.n + length(s.s) > 300 then r.seq + 1 else r.seq end
          from R r join S s on s.doc_id = r.doc_id and s.i = r.i + 1)
        select r.doc_id as page_id, r.seq, sha1(string_agg(s.s, ' ' order by s.i)) as chunk_key from R r join S s on s.doc_id = r.doc_id and s.i = r.i group by r.doc_id, r.seq""",
    "clean_spans": f"""with recursive X as (
          select doc_id, i, case when (i - 1) % 2 = 0 then ls[i] || '-' else lower(ls[i]) end as t from (
            select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents) u),
        S as (select doc_id, t, row_number() over (partition by doc_id order by i) as rn from X where regexp_matches(t, '[^\\s\\p{{Z}}]')),
        R as (select doc_id, rn, t, 1 as line from S where rn = 1
          union all
          select s.doc_id, s.rn, case when right(r.t, 1) = '-' and length(r.t) > 1 and regexp_matches(s.t, '^\\p{{Ll}}') then left(r.t, length(r.t) - 1) || s.t else s.t end,
            case when right(r.t, 1) = '-' and length(r.t) > 1 and regexp_matches(s.t, '^\\p{{Ll}}') then r.line else r.line + 1 end
          from R r join S s on s.doc_id = r.doc_id and s.rn = r.rn + 1),
        M as (select doc_id, line, arg_max(t, rn) as t from R group by doc_id, line)
        select m.doc_id as page_id, cast(z.size as double) as max_size, cast(count(*) as integer) as n_lines, sha1(string_agg(m.t, ' ' order by m.line)) as text_key
        from M m join (select doc_id, max(length(t)) as size from S group by doc_id) z on z.doc_id = m.doc_id group by m.doc_id, z.size""",
    "table_cells": f"""with L as (select doc_id as page_id, cast(i - 1 as integer) as idx, case when (i - 1) % 7 = 0 then '|:---|  ----: |---|' else ls[i] end as line, ls[i] as own from (
          select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
        X as (select page_id, idx, list_transform(string_split(regexp_replace({strip("line")}, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: {strip("c")}) as cs from L where contains(own, '|'))
        select page_id, idx, cast(len(cs) as integer) as n_cells, len(list_filter(cs, lambda c: not regexp_matches(c, '^:?-{{3,}}:?$'))) = 0 as is_rule, sha1(array_to_string(cs, '|')) as cells_key from X""",
    "language_codes": """with X as (select doc_id as page_id, case when doc_id % 5 = 0 then 'auto' when doc_id % 5 = 1 then 'zh' when doc_id % 5 = 2 then null else lang end as code from documents)
        select page_id, code, case when code is null or code in ('', 'auto') then 'eng+deu+fra+ita+spa+por+nld+pol+rus+tur+ara' when code = 'zh' then 'chi_sim' when code = 'en' then 'eng' when code = 'de' then 'deu'
          when code = 'fr' then 'fra' when code = 'es' then 'spa' when code = 'it' then 'ita' else 'eng' end as ocr, case when code = 'zh' then 'zh-Hans' else code end as service, 'x @@IMG' || page_id || '@@ y @@TBL7@@' as tidy from X""",
    "drawn_zones": """with X as (select doc_id as page_id, cast(doc_id * 3 % 50 as double) as a, cast(doc_id * 7 % 60 as double) as b, cast(doc_id * 5 % 50 as double) as c, cast(doc_id * 11 % 60 as double) as e,
          cast(case when doc_id % 9 = 0 then 1 else doc_id % 9 end as double) as f from documents),
        Y as (select page_id, greatest(a, c) - least(a, c) >= 4 and greatest(b, e) - least(b, e) >= 4 as drawn, least(a, c) * (1 / f) as x0, least(b, e) * (1 / f) as y0, greatest(a, c) * (1 / f) as x1, greatest(b, e) * (1 / f) as y1 from X)
        select page_id, x0, y0, x1, y1, least(greatest(x1, cast(2 as double)), cast(20 as double)) as shown from Y where drawn and x1 - x0 >= 1 and y1 - y0 >= 1""",
    "region_images": q(
        f""", X as (select z.page_id, z.seq, (z.page_id + z.seq) % 2 = 0 as captures,
          (select count(*) from B b where b.page_id = z.page_id and b.x0 >= z.x0 and b.y0 >= z.y0 and b.x1 <= z.x1 and b.y1 <= z.y1) as n, (select min(b.block_id) from B b where b.page_id = z.page_id and b.x0 >= z.x0 and b.y0 >= z.y0 and b.x1 <= z.x1 and b.y1 <= z.y1) as first,
          exists (select 1 from B b where {covered("b", "z")}) as hit from Z z)
        select page_id, seq, case when not captures then 'image' when hit then 'render' else 'none' end as action, cast(case when captures then 0 else n end as integer) as n_inside, case when captures then null else first end as first_image from X"""
    ),
    "image_numbers": """with E as (select user_id as doc_id, cast(event_id % 3 as integer) as page_num, event_id as seq, event_type from events),
        K as (select doc_id, page_num, count(*) as top from E where event_type = 'click' group by all),
        N as (select e.doc_id, e.page_num, e.seq, cast(coalesce(k.top, -1) + row_number() over (partition by e.doc_id, e.page_num order by e.seq) as integer) as idx from E e left join K k on k.doc_id = e.doc_id and k.page_num = e.page_num where e.event_type <> 'click')
        select doc_id, page_num, seq, idx, 'page_' || lpad(cast(page_num as varchar), 4, '0') || '_region_' || idx || '.png' as name from N""",
    "gallery_uris": """with E as (select user_id as doc_id, event_id as seq, 'u' || (event_id % 50) as uri, event_type from events),
        K as (select * from E e where event_type <> 'view' and not exists (select 1 from E r where r.event_type = 'view' and r.doc_id = e.doc_id and r.uri = e.uri))
        select doc_id, cast(count(*) as integer) as n, string_agg(uri, ',' order by seq) as uris from K group by doc_id""",
    "cache_invalidated": """with E as (select user_id as doc_id, event_id % 7 as page_num, event_type, event_id from events),
        C as (select doc_id, page_num, max(event_id) as result from E where event_type = 'view' group by all),
        N as (select doc_id, page_num, -max(event_id) as result from E where event_id % 11 = 0 group by all)
        select * from C c where not exists (select 1 from E s where s.event_type = 'click' and s.doc_id = c.doc_id and s.page_num = c.page_num) and not exists (select 1 from N n where n.doc_id = c.doc_id and n.page_num = c.page_num)
        union all select * from N""",
}
