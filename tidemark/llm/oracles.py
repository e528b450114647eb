"""DuckDB SQL of the queries that SQL can express."""
from __future__ import annotations

from . import secrets
from .chat import CONTROLS
from .neardup import SHINGLE, THRESHOLD
from .quality import BOILERPLATE, BOILERPLATE_WORDS, MOST_LOST, SHORT_LINE

_CONTROL = "|".join([r"\\", *(c.decode().replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)])

#: A turn's template adds 24 characters; escaping adds one for each backslash and control string.
OP5 = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(24 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))) as bigint) as formatted_chars
from c group by conv_id"""

_WORD = r"[^\x20\x09-\x0D]+"


def _count(line: str, what: str) -> str:
    return f"(length({line}) - length(replace({line}, '{what}', ''))) // {len(what)}"


OP9 = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '{_WORD}') as ws from d),
win as (select r, i, array_to_string(ws[i:i + 4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w)),
rep as (select r, count(distinct p) as n_repeat_words from (select r, i + unnest(range(0, 5)) as p from (select r, i, count(*) over (partition by r, g) as n from win) where n >= 2) group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
m as (select r, line, len(regexp_extract_all(line, '{_WORD}')) as words, strlen(line) - ({_count('line', ' ')}) as solid,
 {_count('line', '|')} + {_count('line', '›')} + {_count('line', '»')} + {_count('line', '•')} as bars, len(regexp_extract_all(line, '[#*$%&|<>]')) as marks,
 {_count('line', '!!')} + {_count('line', '??')} as shouts from l),
f as (select r, line, solid, case when words = 0 then '' when bars >= 2 and 4 * bars >= words then 'n' when 10 * marks >= solid or (shouts >= 2 and 2 * shouts >= words) then 'p'
 when words <= {BOILERPLATE_WORDS} and regexp_matches(line, '(?i){BOILERPLATE.pattern}') then 'b'
 when words < {SHORT_LINE} and not regexp_matches(line, '[.!?…:;。！？]["''”’»)\]}} \t\r\x0b\x0c]*$') then 'p' else '' end as fault from m),
v as (select r, count(*) filter (fault = 'p') as lines_punctuation, count(*) filter (fault = 'n') as lines_navigation, count(*) filter (fault = 'b') as lines_boilerplate,
 coalesce(coalesce(sum(solid) filter (fault <> ''), 0) / nullif(sum(solid), 0)::double, 0) as lost,
 count(*) filter (regexp_matches(line, '{_WORD}')) - count(distinct line) filter (regexp_matches(line, '{_WORD}')) as n_dup_lines from f group by r),
b as (select w.r, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_repeat_words, 0) as n_repeat_words from w left join rep using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost <= {MOST_LOST} as kept, lines_punctuation, lines_navigation, lines_boilerplate, lost from b join v using (r)"""

_quoted = lambda p: p.replace("'", "''").replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9+/_=-])", "").replace("(?<![A-Za-z0-9])", "")  # noqa: E731  greedy matches begin at their run's start anyway
_ASSIGN, _ACCESS, _HEX, _KEYS, _CANDIDATE, _SEGMENT = map(_quoted, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.KEYS, secrets.CANDIDATE, secrets.SEGMENT))


def _found(table: str, rank: int, kind: str, pattern: str, group: int = 0) -> str:
    return f"""select r, {rank} as rk, '{kind}' as kind, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {group}) as v,
 string_split_regex(text, '{pattern}') as g from {table} where regexp_matches(text, '{pattern}')"""


def _blanked(table: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """The table with spaces for matches whose ``keep``, of the match x and the value y, holds."""
    return f"""select r, array_to_string(list_transform(range(1, len(m) + 2), lambda i: coalesce(g[i], '') || coalesce(case when {keep.replace("{x}", "m[i]").replace("{y}", "v[i]")} then repeat(' ', length(m[i])) else m[i] end, '')), '') as text
 from (select r, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {group}) as v, string_split_regex(text, '{pattern}') as g from {table})"""


_SUSPECT = "not (" + " or ".join(f"regexp_matches({{x}}, '{_quoted(p)}')" for p in secrets.ALLOW) + ")"
_BITS = " ".join(f"when regexp_matches(m, '{p}') then {least}" for p, least in secrets.CLASSES)

OP4 = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
d1 as ({_blanked('d', _ASSIGN, f'length({{y}}) >= {secrets.ASSIGN_LEAST}', 2)}), d2 as ({_blanked('d1', _KEYS)}), d3 as ({_blanked('d2', _CANDIDATE, _SUSPECT)}),
mm as ({_found('d', 0, 'assign', _ASSIGN, 2)} union all {_found('d', 1, 'access', _ACCESS)} union all {_found('d', 2, 'hex', _HEX)} union all {_found('d2', 3, 'entropy', _CANDIDATE)} union all {_found('d3', 4, 'entropy', _SEGMENT)}),
e as (select r, rk, kind, unnest(m) as m, unnest(v) as v, unnest(g[1:len(m)]) as g, unnest(range(1, len(m) + 1)) as i from mm),
p as (select *, cast(sum(length(g) + length(m)) over (partition by r, rk order by i) as bigint) as en from e), s as (select r, rk, kind, en - length(m) as st, en, m, v from p),
base as (select * from s where rk < 3 and (rk > 0 or length(v) >= {secrets.ASSIGN_LEAST})),
cand as (select row_number() over () as c, r, st, en, m from s where rk >= 3 and {_SUSPECT.replace('{x}', 'm')}),
k as (select c, m, unnest(range(1, length(m) - {secrets.WINDOW - 2})) as k from cand), ch as (select c, k, substr(m, k + j, 1) as x from k cross join range(0, {secrets.WINDOW}) t(j)),
cn as (select c, k, x, count(*) as n from ch group by all), h as (select c, k, log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} as h from cn group by 1, 2),
hot as (select c, min(k) as a, max(k) + {secrets.WINDOW - 1} as b from h join cand using (c) where h >= case {_BITS} end group by c),
spans as (select r, rk, kind, st, en from base union all select r, 3, 'entropy', st + a - 1, st + b from hot join cand using (c)),
t as (select r, count(*) filter (rk = 0) as n_assign, count(*) filter (rk = 1) as n_access, count(*) filter (rk = 2) as n_hex, count(*) filter (rk = 3) as n_entropy,
 coalesce(string_agg(kind || ':' || st || ':' || en, ',' order by st, rk) filter (rk < 3), '') as base, string_agg(kind || ':' || st || ':' || en, ',' order by st, rk) as spans from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0) as n_entropy from d left join t using (r)"""

#: For tables whose doc_ids are neither null nor repeated. Equal sets are one class, called by its smallest document.
OP10 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) < {SHINGLE} then [array_to_string(ws, ' ')] else list_sort(list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))) end as sh from w),
d as (select doc_id, len(sh) as n, md5(array_to_string(sh, chr(10))) as h, sh from g), c as (select h, min(doc_id) as id, any_value(sh) as sh, any_value(n) as n from d where n > 0 group by h),
u as (select id, n, unnest(sh) as s from c),
pairs as (select a.id as a, b.id as b from u a join u b on a.s = b.s and a.id < b.id group by 1, 2 having 100 * count(*) >= {THRESHOLD} * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways as (select a, b from pairs union all select b, a from pairs),
reach(id, root) as (select id, id from c union select b.b, r.root from reach r join both_ways b on b.a = r.id),
roots as (select id, min(root) as root from reach group by 1)
select d.doc_id, d.n as n_shingles, coalesce(root, d.doc_id) as component_id, coalesce(root, d.doc_id) = d.doc_id as kept from d left join c on c.h = d.h and d.n > 0 left join roots using (id)"""

#: A round of the checksum stands for each bit: list items from 0 on are characters, -1 is a round.
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(conv_id::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
 lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, (crc & 1) * 3988292384) end))"""
OP11 = f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
o as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || text)) as p from t),
c as (select conv_id, conv_id - conv_id % 5 as base, {_CRC} % 9 as h from (select distinct conv_id from t)),
r as (select c.conv_id, p, role, text from c join o on o.conv_id = c.base where p <= h union all select conv_id, p, role, text from c join o using (conv_id) where p > h),
m as (select conv_id, row_number() over w as d, string_agg(sha256(length(role) || ':' || role || text), '') over w as k, strlen(text) as size from r window w as (partition by conv_id order by p)
 union all select conv_id, 0, '', 0 from c),
n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * min(size) as own,
 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = n), '')) as ends_sha256 from m join (select conv_id, max(d) as n from m group by conv_id) using (conv_id) group by k, d),
u as (select left(k, 64 * (d - 1)) as k, count(*) as n_children from n where d > 0 group by 1),
s as (select left(n.k, 64 * a) as k, sum(own) as saved_tokens, count(*) filter (u.k is null) as n_leaves from (select *, unnest(range(0, d + 1)) as a from n) n left join u on u.k = n.k group by 1)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from n join s using (k) left join u using (k) left join n p on n.d > 0 and p.k = left(n.k, 64 * (n.d - 1))"""

ORACLES = {"op10_near_duplicates": OP10, "op11_prefix_trie": OP11, "op4_secret_scan": OP4, "op5_chat_formatting": OP5, "op9_quality_rules": OP9}
