"""SQL for DuckDB that gives the rows of those queries that SQL can express, by plain counting."""

from __future__ import annotations

import string

from quire.llm.chat import INST

_WORDS = rf"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+')"
_SHINGLE = "array_to_string(l[i:i + k - 1], ' ')"

#: Every item against every document that shares a shingle with it.
DECONTAMINATION = f"""with w as (select doc_id, {_WORDS} as l from documents), v as (select item_id, {_WORDS} as l from benchmark), b as (select item_id, l, least(5, len(l)) as k from v where len(l) > 0),
 q as (select distinct item_id, k, unnest([{_SHINGLE} for i in range(1, len(l) - k + 2)]) as s from b), n as (select item_id, count(*) as n from q group by 1),
 d as (select distinct doc_id, k, unnest([{_SHINGLE} for i in range(1, len(l) - k + 2)]) as s from w, (select distinct k from b) where len(l) >= k),
 h as (select doc_id, item_id, count(*) / any_value(n.n) as c from d join q using (k, s) join n using (item_id) group by 1, 2), x as (select * from h where c >= 0.8)
 select doc_id, count(item_id) as n_items, coalesce(string_agg(item_id::varchar, ',' order by item_id), '') as item_ids, max(c) as containment, count(item_id) > 0 as contaminated from documents left join x using (doc_id) group by 1"""

#: All pairs that share a shingle, and what can be reached by the links.
NEAR_DUPLICATES = f"""with recursive w as (select doc_id, {_WORDS} as l from documents), v as (select doc_id, l, least(5, len(l)) as k from w where len(l) > 0),
 s as (select distinct doc_id, unnest([{_SHINGLE} for i in range(1, len(l) - k + 2)]) as s, k from v), n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
 r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b), m as (select a as doc_id, min(b) as least from r group by 1)
 select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id, doc_id = least(doc_id, coalesce(least, doc_id)) as kept from documents left join n using (doc_id) left join m using (doc_id)"""


def _escaped(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in INST.controls:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


_ORDER = "order by turn, role, text"
_MARKS = " ".join(f"when '{name}' then {len(r.prefix) + len(r.suffix)}" for name, r in INST.roles.items())
CHAT = f"""with c as (select conv_id, turn, role, text from conversations union all select -1, turn, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) t(turn, role)),
 t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c where conv_id is not null)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' {_ORDER}) filter (role = 'assistant'), '')) as loss_sha256,
 sum(length({_escaped('text')}) + case role {_MARKS} else {sum(map(len, INST.other))} + length({_escaped('role')}) end)::bigint as formatted_chars,
 regexp_matches(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, '' {_ORDER}), '^s?(ua)+$') as valid from t group by 1"""

#: Every anchor against every row.
HARD_NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
 s as (select a.vec_id as a, a.label as al, r.vec_id as r, r.label as rl, list_inner_product(a.e, r.e)::bigint as s from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
 p as (select a, r as p, s as ps from s where al = rl qualify row_number() over (partition by a order by s desc, r) <= 5),
 n as (select a, p, ps, r, s, row_number() over (partition by a, p order by s desc, r) as rank from p join s using (a) where al <> rl and 80 * ps <= 100 * s and 100 * s <= 100 * ps)
 select a as anchor_id, p as positive_id, rank::integer as rank, r as negative_id, ps as positive_score, s as negative_score from n where rank <= 5"""

ORACLE_SQL = {"op12_hard_negatives": HARD_NEGATIVES, "op1_decontamination": DECONTAMINATION, "op2_chat_format": CHAT, "op9_near_duplicates": NEAR_DUPLICATES}
