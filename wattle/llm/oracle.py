"""DuckDB statements of the queries that plain SQL can state."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op8_benchmark_decontamination"] = r"""
with words as (
    select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
    from benchmark),
windows as (
    select item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2),
        lambda i: array_to_string(w[i:least(i + 9, len(w))], ' '))) as win, least(len(w), 10) as size
    from words where len(w) > 0),
dwords as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
    from documents),
sizes as (select distinct size from windows),
dwins as (
    select doc_id, size, unnest(range(1, len(w) - size + 2)) as i, w from dwords, sizes where len(w) >= size),
hits as (
    select distinct d.doc_id, d.i, d.size, x.item_id
    from dwins d join windows x on x.size = d.size and x.win = array_to_string(d.w[d.i:d.i + d.size - 1], ' ')),
covered as (select doc_id, count(distinct p) as n_hit from (
    select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items,
    string_agg(item_id, ',' order by item_id) as ids
    from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
    sha256(coalesce(i.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from dwords d left join covered c using (doc_id) left join items i using (doc_id)
"""

ORACLE["op10_substring_dedup"] = r"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents),
wins as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as win
    from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)),
least as (select win, min(doc_id) as d from wins group by win),
covered as (select distinct doc_id, unnest(range(i, i + 13)) as p
    from (select doc_id, i from wins join least using (win) where d < doc_id)),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n
    from each anti join covered using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from words left join kept using (doc_id)
"""

ORACLE["op9_suffix_array_dedup"] = r"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
each as (select doc_id, i, substr(h, 2 * i + 1, 100) as s
    from (select doc_id, h, unnest(range(0, n - 49)) as i from docs where n >= 50)),
least as (select s, min(doc_id) as d from each group by s having count(*) > 1),
starts as (select doc_id, i from each join least using (s) where d < doc_id),
steps as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh
    from starts),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from steps) group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as z from runs),
kept as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
    string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) as text
    from gaps join docs using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(text, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from docs left join kept using (doc_id)
"""

ORACLE["op3_ngram_jaccard_join"] = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes using (doc_id)
join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)
"""

# crc32 of a list of bytes, by a table of 256 entries made from its polynomial (a fixed value).
CRC_TABLE = """crc_table as (select list(list_reduce([cast(k as bigint)] || range(0, 8),
        lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) as t
    from range(0, 256) r(k))"""


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, in a query that joins ``crc_table``."""
    return (f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), "
            "lambda x: cast(ascii(x) as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLE["op13_merkle_manifest"] = rf"""
with recursive {CRC_TABLE},
leaves as (
    select doc_id, source, {_LEAF.format(text="text")} as leaf,
        case when {crc32_sql("cast(doc_id as varchar)")} % 5 = 0 then {_LEAF.format(
            text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed
    from documents, crc_table),
docs as (
    select *, row_number() over (order by tree, pos) as id from (
        select doc_id, leaf, changed, dense_rank() over (order by source nulls first) - 1 as tree,
            row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves)),
nodes as (
    select 0 as level, tree, pos, count(*) over (partition by tree) as n, leaf as h from docs
    union all
    select level + 1, tree, pos // 16, max((n + 15) // 16), sha256(string_agg(h, '' order by pos))
    from nodes where n > 1 group by level, tree, pos // 16),
tops as (
    select 0 as level, tree as pos, count(*) over () as n, h from nodes where n = 1
    union all
    select level + 1, pos // 16, max((n + 15) // 16), sha256(string_agg(h, '' order by pos))
    from tops where n > 1 group by level, pos // 16),
each as (select 0 as stage, * from nodes where n > 1 union all select 1, level, null, pos, n, h from tops where n > 1),
flanks as (
    select stage, level, tree, pos,
        coalesce(string_agg(h, '') over (partition by stage, level, tree, pos // 16 order by pos
            rows between unbounded preceding and 1 preceding), '') as l,
        coalesce(string_agg(h, '') over (partition by stage, level, tree, pos // 16 order by pos
            rows between 1 following and unbounded following), '') as r
    from each),
paths as (
    select d.id, row_number() over (partition by d.id order by f.stage, f.level) as k, f.l, f.r
    from docs d join flanks f on f.stage = 0 and f.tree = d.tree and f.pos = d.pos // cast(pow(16, f.level) as bigint)
        or f.stage = 1 and f.pos = d.tree // cast(pow(16, f.level) as bigint)),
fold as (
    select id, 0 as k, coalesce(changed, leaf) as h from docs
    union all
    select f.id, p.k, sha256(p.l || f.h || p.r) from fold f join paths p on p.id = f.id and p.k = f.k + 1),
proofs as (select id, sha256(string_agg(l || r, '' order by k)) as proof_sha256 from paths group by id)
select d.doc_id, d.leaf, s.h as subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256,
    f.h as folded_root, f.h = r.h as verified
from docs d join (select tree, h from nodes where n = 1) s on s.tree = d.tree
join (select id, arg_max(h, k) as h from fold group by id) f on f.id = d.id
left join proofs p on p.id = d.id
cross join (select h from tops where n = 1) r
"""

_TURN = "coalesce(cast({} as varchar), ' ')"
_BARE = r"rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
ORACLE["op11_conversation_repair"] = rf"""
with recursive {CRC_TABLE},
hashed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {crc32_sql(_TURN.format("conv_id") + " || ':' || " + _TURN.format("turn"))} % 20 as h
    from conversations, crc_table),
damaged as (
    select conv_id, turn, case when h = 4 then 'user' else role end as role,
        case h when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(range(0, case when h = 3 then 2 else 1 end)) as copy
    from hashed where h <> 0),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i,
        {_BARE} as bare from damaged),
judged as (
    select conv_id, turn, role, text, i, left(role, 1) as initial,
        case when bare = '' then 'blank'
            when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
            when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(left(role, 1)) over (partition by conv_id order by i) as before
    from placed),
numbers as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
    from judged group by conv_id),
inserts as (select * from (values (0, 0, '', ''), (0, 2, 'I', 'u'), (0, 3, 'II', 'ua'), (1, 1, '', ''), (1, 2, 'I', 'u'),
    (1, 3, 'II', 'ua'), (2, 2, '', ''), (2, 3, 'I', 'a'), (3, 3, '', ''), (3, 2, 'I', 'u')) x(a, b, ops, roles)),
steps as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) x(a, role, b)),
edits as (
    select conv_id, i, x.a, x.b, 3 as cost, 'D' as op, cast(null as varchar) as line
    from judged, (values (0, 0), (1, 1), (2, 2), (3, 3)) x(a, b)
    union all
    select conv_id, i, s.a, s.b, case when fault = 'truncated' then 1 else 0 end, 'K', j.role || ':' || text
    from judged j join steps s on s.role = initial where fault not in ('blank', 'duplicate')
    union all
    select conv_id, i, s.a, s.b, case when fault = 'truncated' then 3 else 2 end, 'R',
        case s.role when 'u' then 'user' else 'assistant' end || ':' || text
    from judged j join steps s on s.role in ('u', 'a') where fault not in ('blank', 'duplicate')),
ways as (
    select conv_id, 1 as i, 0 as state, 0 as cost, '' as audit, cast([] as varchar[]) as lines from numbers
    union all
    select w.conv_id, w.i + 1, e.b, min(w.cost + 2 * length(n.ops) + e.cost),
        arg_min(w.audit || n.ops || e.op, (w.cost + 2 * length(n.ops) + e.cost, w.audit || n.ops || e.op)),
        arg_min(w.lines || list_transform(string_split(n.roles, ''), lambda r: case r when 'u' then 'user:'
            when 'a' then 'assistant:' end) || [e.line],
            (w.cost + 2 * length(n.ops) + e.cost, w.audit || n.ops || e.op))
    from ways w join inserts n on n.a = w.state
    join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i and e.a = n.b
    group by w.conv_id, w.i, e.b),
ended as (
    select w.conv_id, w.cost + 2 * length(n.ops) as cost, w.audit || n.ops as audit,
        list_filter(w.lines || list_transform(string_split(n.roles, ''), lambda r: case r when 'u' then 'user:'
            when 'a' then 'assistant:' end), lambda l: l is not null) as lines
    from ways w join numbers x on x.conv_id is not distinct from w.conv_id and w.i = x.n + 1
    join inserts n on n.a = w.state and n.b in (0, 3)),
best as (
    select conv_id, min(cost) as cost, arg_min(audit, (cost, audit)) as audit,
        arg_min(array_to_string(lines, chr(10)), (cost, audit)) as repaired
    from ended group by conv_id),
known as (select distinct conv_id from conversations)
select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
    coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from known k left join numbers n on n.conv_id is not distinct from k.conv_id
left join best b on b.conv_id is not distinct from k.conv_id
"""
