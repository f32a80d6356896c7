"""DuckDB oracles of the document queries."""

from __future__ import annotations

from marlquarry.plans.inputs import LEAKY, PLACES, QUESTIONS, SPOKEN, TOLD
from marlquarry.plans.rank_queries import A, B, BASE

SPACE = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def stripped(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


LINES = "lines as (select doc_id, source, i - 1 as line, l as text from (select doc_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(l) <> '')"
BLOCKS = f"""{LINES}, nl as (select doc_id, source, line, {norm('text')} as text from lines),
blocks as (select 'block-' || doc_id || '-' || lpad(line::varchar, 5, '0') as block_id, doc_id, line, case when length(text) < 30 then 'heading1' when contains(text, '|') then 'table' else 'paragraph' end as element_type,
  text, sha256(text) as text_hash, length(text) as text_length from nl)"""

GRAINS = "grains as (select doc_id, source || ':' || lang as parent_id, source as root_id, length(text) as text_length from documents)"
EVIDENCE = f"""{BASE}, {GRAINS},
eq as (select query_id, expected, case when query_id % 3 = 0 then 'voice_followup' else 'place_fact' end as query_type from jq),
cand as (select query_id, query_type, doc_id, parent_id, root_id, score, rank, text_length from bm join grains using (doc_id) join eq using (query_id) where rank <= 20 and expected <> 'abstain'),
ecorp as (select *, row_number() over (partition by parent_id order by doc_id) as place from grains),
tgt as (select query_id, doc_id, parent_id, root_id from rel join grains using (doc_id))"""


def greedy(source: str, budget: str = "4200", most: str = "5") -> str:
    """Recursive greedy pack of source (query_id, query_type, ord, doc_id, ..): one step per offered item."""
    return f"""off as (select *, row_number() over (partition by query_id order by ord, place) as n from ({source})),
walk as (select query_id, query_type, 0::bigint as n, 0::bigint as used, 0::bigint as taken, false as took from (select distinct query_id, query_type from off)
  union all select w.query_id, w.query_type, o.n, w.used + case when f then o.text_length else 0 end, w.taken + case when f then 1 else 0 end, f
  from (select w.*, o.text_length as tl, (w.taken < {most} and (w.taken = 0 or w.used + o.text_length <= {budget})) as f from walk w join off o on o.query_id = w.query_id and o.n = w.n + 1) w
  join off o on o.query_id = w.query_id and o.n = w.n + 1),
packed as (select o.query_id, w.taken as pack_rank, o.doc_id, o.parent_id, o.root_id, o.rank, o.text_length, (w.taken = 1 and o.text_length > {budget}) as clipped from walk w join off o using (query_id, n) where w.took)"""


def packed(source: str, budget: str = "4200", most: str = "5") -> str:
    return f"with recursive {EVIDENCE}, {greedy(source, budget, most)} select query_id, pack_rank::int as pack_rank, doc_id, parent_id, rank::bigint as rank, text_length::bigint as text_length, clipped from packed"


P0 = "select *, rank as ord, 0 as place from cand"
ONCE = "select * from (select *, row_number() over (partition by query_id, doc_id order by ord, place) as k from ({})) where k = 1"
SIBS = "select h.query_id, h.query_type, h.parent_id, h.root_id, h.rank, h.score, h.ord, n.doc_id, n.text_length, n.place from ({}) h join ecorp c on c.doc_id = h.doc_id join ecorp n on n.parent_id = c.parent_id and n.place between c.place - 1 and c.place + 1"
P1 = ONCE.format(SIBS.format("select *, rank as ord from cand"))
P2 = ONCE.format(
    SIBS.format("select * exclude (best), row_number() over (partition by query_id order by best desc, rank) as ord from (select *, max(score) over (partition by query_id, parent_id) as best, min(rank) over (partition by query_id, parent_id) as first from cand) where rank = first")
)
P4 = "select *, rank as ord, 0 as place from (select *, row_number() over (partition by query_id, parent_id order by rank) as k from cand) where query_type <> 'voice_followup' or k = 1"
VOICE = ("case when o.query_type = 'voice_followup' then 2600 else 4200 end", "case when w.query_type = 'voice_followup' then 3 else 5 end")
#: Diversity: one candidate a step, by scaled score less .25 for a parent and .10 for a document taken before.
MMR = """cs as (select *, (score - lo) / greatest(hi - lo, 1e-9) as scaled from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from cand)),
mm as (select query_id, 0::bigint as k, 0::bigint as doc_id, []::bigint[] as docs, []::varchar[] as parents, []::varchar[] as roots from (select distinct query_id from cs)
  union all select query_id, k + 1, doc_id, list_append(docs, doc_id), list_append(parents, parent_id), list_append(roots, root_id) from (select m.query_id, k, docs, parents, roots, c.doc_id, c.parent_id, c.root_id,
    row_number() over (partition by m.query_id order by scaled - 0.25::double * list_contains(parents, c.parent_id)::int - 0.10::double * list_contains(roots, c.root_id)::int desc, rank) as place
    from mm m join cs c on c.query_id = m.query_id and not list_contains(docs, c.doc_id)) where place = 1)"""
P3 = "select c.*, k as ord, 0 as place from cand c join (select query_id, doc_id, k from mm where k > 0) using (query_id, doc_id)"
PACK0 = f"with recursive {EVIDENCE}, {greedy(P0)}"

PM = """pm as (select query_id, count(*) as n_items, sum(text_length) as chars, bool_or(hc) as child_covered, bool_or(hp) as parent_covered, bool_or(hd) as doc_covered, min(case when hc or hp or hd then pack_rank end) as first,
  round(1 - count(distinct parent_id) / count(*)::double, 6) as dp, round(1 - count(distinct root_id) / count(*)::double, 6) as dd
  from (select *, exists (select 1 from tgt t where t.query_id = p.query_id and t.doc_id = p.doc_id) as hc, exists (select 1 from tgt t where t.query_id = p.query_id and t.parent_id = p.parent_id) as hp,
    exists (select 1 from tgt t where t.query_id = p.query_id and t.root_id = p.root_id) as hd from packed p) group by query_id)"""



def _literal(value: object) -> str:
    return "null" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(_literal, row)) + ')' for row in rows)}) as v({names})"


TURNS = f"""turns as (select conv_id * 1000 + turn as query_id, text as query_text, turn % 3 as n_places, turn > 0 as has_context, user_context
from (select *, lag(text) over (partition by conv_id order by turn) as user_context from conversations) where role = 'user'
union all select query_id, query_text, n_places, user_context is not null, user_context from {_values(QUESTIONS, 'query_id, query_text, n_places, user_context')})"""

TYPES = ("no_answer", "voice_followup", "route_context", "relationship", "place_story", "overview", "place_fact")
FALLBACKS = ("no_answer", "voice_followup", "route_context", "overview", "place_story", "place_fact")
#: Weight of a phrase of each type, and the phrases.
PHRASES = {
    "no_answer": (2.5, "오늘|지금|현재|실시간|예약|입장권|몇 장 남았|대기 시간|빈자리|시간표|결제|교통 통제|혼잡도|live crowd|current air quality|right now"),
    "route_context": (1.8, "동선|걸으며|걸을 때|이동하며|방향으로|지나|가는 길|이어갈|이어지는 궁궐|도심 동선"),
    "relationship": (1.6, "관계|연결|갈등|어떻게 연결|어떻게 이어|이어지는 흐름|영향|비교|복권"),
    "place_story": (1.7, "이야기|흥미|현장감|들려|풀어|관광객|짧게 설명|앞에서|걸으며"),
    "overview": (1.6, "개괄|요약|큰 흐름|공간 흐름|도심 공간|시대마다|전체|일대|권역"),
    "place_fact": (1.5, "배경|의미|이름|정통성|세워진|뒷받침|자료|순서|요지"),
}
STRONG = "관계|갈등|어떻게 연결|어떻게 이어|이어지는 흐름|이어지는지|이어졌|영향|비교|복권|배치|선택|움직임|행진|연결해서|연결할 근거"


def phrase(p: str) -> str:
    return f"regexp_matches(q, '(^|[^0-9a-z]){p}([^0-9a-z]|$)')::int" if p.isascii() else f"contains(q, '{p}')::int"


def _score(t: str) -> str:
    parts = [f"{PHRASES[t][0]}::double * ({' + '.join(map(phrase, PHRASES[t][1].split('|')))})"] if t in PHRASES else []
    extra = {
        "place_fact": "case when n_places > 0 then 0.5 else 0 end",
        "relationship": "case when n_places >= 2 then 0.35 else 0 end",
        "voice_followup": "case when v then 5.0 else 0 end",
        "route_context": "case when regexp_matches(q, '.+에서.+(로|으로).+(가|걸|이동|지나|이어)') then 3.0 else 0 end",
    }
    return " + ".join([*parts, extra.get(t, "0.0")])


_ANY = lambda terms: f"regexp_matches(q, '{terms}')"
CLASSIFIED = f"""{TURNS}, nt as (select *, {norm("lower(coalesce(query_text, ''))")} as q from turns),
nv as (select *, has_context and length(replace(q, ' ', '')) <= 28 and {_ANY('그|거기|그곳|아까|방금|이거|저거')} and {_ANY('왜|누가|뭐|무엇|어떻게|나와|했어|거야')} as v from nt),
sc as (select *, {', '.join(f'round(({_score(t)})::double, 6) as s_{t}' for t in TYPES)} from nv),
tops as (select *, list_sort([{', '.join(f"{{'neg': -s_{t}, 'k': {k}, 't': '{t}'}}" for k, t in enumerate(TYPES))}]) as o from sc),
cls as (select *, case when -o[1].neg <= 0 then 'place_fact' else o[1].t end as predicted, -o[1].neg <= 0 as fallback_used,
  case when -o[1].neg <= 0 then 0.35 else round(least(0.99::double, 0.5::double - o[1].neg / 12 + greatest(o[2].neg - o[1].neg, 0) / 8), 6) end as confidence from tops)"""
GUARDED = f"""{CLASSIFIED}, gd as (select *, predicted = 'relationship' as is_rel, {_ANY(STRONG)} as strong,
  {_ANY(PHRASES['overview'][1])} and s_overview > 0 and s_relationship - s_overview <= 0.35 as tie, {_ANY('이유|왜|배경')} as reason0,
  list_sort([{', '.join(f"{{'neg': -s_{t}, 'k': {k}, 't': '{t}'}}" for k, t in enumerate(FALLBACKS))}])[1].t as best from cls),
gx as (select *, is_rel and (tie or (not strong and reason0) or not strong) as guard_applied from gd),
gy as (select *, case when guard_applied then best else predicted end as guarded from gx)"""

GSTOP = "('그리고', '그러나', '그래서', '대한', '대해', '무엇', '어떤', '어떻게', '왜', '있어', '있는', '했다', '한다', '관련', '관계', '설명', '알려', '말해', '차이', '영향', '이유', '사이', 'history', 'docent')"
TSTOP = "('그리고', '그러나', '그래서', '대한', '대해', '무엇', '어떤', '어떻게', '왜', '있어', '있는', '했다', '한다', '관련', '설명', '알려', '말해', '이야기', '근거', '짧게', '서울', '한양', '관광', '도슨트', 'history', 'docent')"


def _post(stop: str, most: int) -> str:
    """Postings of documents and the most frequent tokens of queries."""
    words = lambda x: f"regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9가-힣]{{2,}}')"
    keep = f"not regexp_matches(token, '^[0-9]+$') and token not in {stop}"
    return f"""post as (select distinct doc_id, token from (select doc_id, lower(unnest({words('text')})) as token from documents) where {keep}),
gn as (select query_id, token, count(*) as n, min(spot) as spot from (select item_id as query_id, lower(unnest({words('text')})) as token, generate_subscripts({words('text')}, 1) as spot from benchmark) where {keep} group by query_id, token),
gq as (select query_id, token from (select query_id, token, row_number() over (partition by query_id order by n desc, spot) as place from gn) where place <= {most})"""


POST = f"""{_post(GSTOP, 14)},
cp as (select * from (select *, row_number() over (partition by token order by doc_id) as place from post) where place <= 350),
met as (select query_id, doc_id, count(*) as m from gq join cp using (token) group by all),
nb as (select query_id, token, sum(m)::bigint as n from met join post using (doc_id) where (query_id, token) not in (select query_id, token from gq) group by all),
ex as (select query_id, token, n from (select *, row_number() over (partition by query_id order by n desc, token) as place from nb) where place <= 24)"""


def tree(roots: bool) -> str:
    b, d, w, h = ("0.38", "0.30", "0.22", "0.07") if roots else ("0.48", "0.32", "0.16", "0.04")
    more = " union all select 1, 'doc::' || source, doc_id from documents" if roots else ""
    return f"""with {BASE}, {_post(TSTOP, 18)}, mb as (select 0 as kind, source || ':' || lang as g, doc_id from documents{more}),
gt as (select distinct kind, g, token from mb join post using (doc_id)), sz as (select kind, g, count(*) as size from mb group by all),
nb as (select query_id, o.token, count(*) as n from gq join gt c on c.token = gq.token join gt o on o.kind = c.kind and o.g = c.g where (query_id, o.token) not in (select query_id, token from gq) group by all),
ev as (select query_id, token, 3 as w from gq union all select query_id, token, 1 from (select *, row_number() over (partition by query_id order by n desc, token) as place from nb) where place <= 32),
bl as (select query_id, doc_id, greatest(case when hi - lo < 1e-9 then 1.0 / rank else (score - lo) / nullif(hi - lo, 0) end, 1.0 / (rank + 1)) as base
  from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from bm where rank <= 20)),
gb as (select query_id, kind, g, max(base) as base from bl join mb using (doc_id) group by all),
pool as (select query_id, kind, g from gb union select query_id, kind, g from ev join gt using (token)),
ns as (select query_id, count(*) filter (w = 3) as nq, count(*) as ne from ev group by 1),
gs as (select query_id, kind, g, count(*) filter (w = 3) as direct, count(*) as wide from pool join ev using (query_id) join gt using (kind, g, token) group by all),
gh as (select kind, g, count(*) as hints from gt where token in {HINTS} group by all),
sg as (select query_id, kind, g, round({b}::double * coalesce(base, 0) + {d}::double * coalesce(direct, 0) / nq + {w}::double * coalesce(wide, 0) / ne + {h}::double * least(coalesce(hints, 0) / 7.0, 1.0)
  + kind * 0.03::double - least(ln(size::double) / ln(20.0::double) * 0.02::double, 0.10::double), 9) as score from pool join ns using (query_id) join sz using (kind, g) left join gs using (query_id, kind, g) left join gb using (query_id, kind, g) left join gh using (kind, g)),
rg as (select *, row_number() over (partition by query_id order by score desc, g desc) as gr from sg), tk as (select query_id, doc_id, gr, score from rg join mb using (kind, g) where gr <= 12),
ds as (select query_id, doc_id, count(*) filter (w = 3) as direct, count(*) as wide from (select distinct query_id, doc_id from tk) join ev using (query_id) join post using (doc_id, token) group by all),
dh as (select doc_id, count(*) as hints from post where token in {HINTS} group by 1),
cs as (select tk.*, round(0.50::double * coalesce(base, 0) + 0.32::double * coalesce(direct, 0) / nq + 0.13::double * coalesce(wide, 0) / ne + 0.05::double * least(coalesce(hints, 0) / 5.0, 1.0), 9) as own
  from tk join ns using (query_id) left join ds using (query_id, doc_id) left join bl using (query_id, doc_id) left join dh using (doc_id)),
pk as (select query_id, doc_id, score + 0.25::double * own as score, gr * 10 + c as place from (select *, row_number() over (partition by query_id, gr order by own desc, doc_id desc) as c from cs) where c <= {1 + roots}),
fp as (select query_id, doc_id, score, place from (select *, row_number() over (partition by query_id, doc_id order by place) as k from pk) where k = 1),
al as (select * from fp union all select query_id, doc_id, score, rank + 1000 from bm where rank <= 20 and (query_id, doc_id) not in (select query_id, doc_id from fp))
select query_id, doc_id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by query_id order by place) as int) as rank from al) where rank <= 5"""


HINTS = "('the', 'and', 'of', 'tion')"


def graph(score: str) -> str:
    return f"""with {BASE}, {POST}, bl as (select query_id, doc_id, greatest(case when hi - lo < 1e-9 then 1.0 / rank else (score - lo) / nullif(hi - lo, 0) end, 1.0 / (rank + 1)) as base
  from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from bm where rank <= 20)),
ev as (select query_id, token, 3 as w from gq union all select query_id, token, 1 from ex),
fs as (select query_id, doc_id, sum(w) as s from ev join cp using (token) group by all),
pool as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by s desc, doc_id) as place from fs) where place <= 120 union select query_id, doc_id from bm where rank <= 20),
dc as (select query_id, doc_id, count(*) as direct from gq join post using (token) group by all), xc as (select query_id, doc_id, count(*) as wide from ev join post using (token) group by all),
rc as (select doc_id, count(*) as related from post where token in {HINTS} group by all), nq as (select query_id, count(*) as nq from gq group by all), ne as (select query_id, count(*) as ne from ev group by all),
g as (select query_id, doc_id, coalesce(base, 0) as base, coalesce(direct, 0)::double / nq as dr, coalesce(wide, 0)::double / ne as wr, coalesce(direct, 0) * (coalesce(direct, 0) - 1) / 2.0 / greatest(nq * (nq - 1) / 2.0, 1) as pr, least(coalesce(related, 0) / 4.0, 1.0) as rr
  from pool left join bl using (query_id, doc_id) left join dc using (query_id, doc_id) left join xc using (query_id, doc_id) left join rc using (doc_id) join nq using (query_id) join ne using (query_id)),
sg as (select query_id, doc_id, round({score}, 9) as score from g)
select query_id, doc_id, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id desc) as int) as rank from sg) where rank <= 5"""


#: Runs of three lines of prose or more.
PROSE = f"""{LINES}, pl as (select doc_id, line, trim(regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g'), '",') as t from lines), pk as (select doc_id, line - row_number() over (partition by doc_id order by line) as island from pl
where length(t) >= 40 and not regexp_matches(t, 'Path\\(| = |    |\\{{|\\}}|```|\\||report_|result_|metric|contains_|assert |from |import ') and length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / length(t)::double >= 0.3),
pb as (select doc_id, count(*) as n_blocks from (select doc_id, island, count(*) as n from pk group by all) where n >= 3 group by doc_id)"""

#: Child chunks, block by block: parts of parents up to 6000, then groups from 250 to 1100 about 700 that share one block.
_K = "doc_id, parent_no, part_no"
CHILDREN = f"""{BLOCKS}, sg as (select *, sum((element_type = 'heading1')::int) over (partition by doc_id order by line rows unbounded preceding) as seg, (element_type <> 'heading1' and text_length > 0) as keep from blocks),
pr as (select doc_id, dense_rank() over (partition by doc_id order by seg) - 1 as parent_no, row_number() over (partition by doc_id, seg order by line) as i, * exclude (doc_id) from sg),
pw as (select doc_id, parent_no, 0::bigint as i, 0 as part_no, 0::bigint as used, false as has from (select distinct doc_id, parent_no from pr)
  union all select w.doc_id, w.parent_no, r.i, w.part_no + f::int, case when f then r.text_length else w.used + r.text_length end, case when f then r.keep else w.has or r.keep end
  from (select w.*, w.i > 0 and w.used + r.text_length > 6000 and w.has as f from pw w join pr r on r.doc_id = w.doc_id and r.parent_no = w.parent_no and r.i = w.i + 1) w join pr r on r.doc_id = w.doc_id and r.parent_no = w.parent_no and r.i = w.i + 1),
pb as (select r.*, w.part_no from pr r join pw w using (doc_id, parent_no, i)),
gl as (select {_K}, list(text_length order by line) filter (keep) as l, (count(*) filter (keep))::int as n, list(block_id order by line) filter (keep) as ids, coalesce(sum(text_length) filter (element_type = 'heading1'), 0) as extra from pb group by all),
gw as (select {_K}, 0 as k, 0 as lo, null::int as a, null::int as b, null::int as c, null::int as d from gl where n > 0
  union all select {_K}, k + 1, case when c2 then greatest(lo1, k) else lo1 end, case when c1 then lo end, case when c1 then k end, case when c2 then lo1 end, case when c2 then k + 1 end
  from (select *, list_sum(l[lo1 + 1:k + 1]) >= 700 and k + 1 < n as c2 from (select *, case when c1 then greatest(lo, k - 1) else lo end as lo1
    from (select w.*, l, n, k > lo and list_sum(l[lo + 1:k + 1]) > 1100 and list_sum(l[lo + 1:k]) >= 250 as c1 from gw w join gl using ({_K}) where k < n)))),
em as (select {_K}, k * 2 as o, a as lo, b as hi from gw where a is not null union all select {_K}, k * 2 + 1, c, d from gw where c is not null),
ed as (select * from (select *, lag(lo) over (partition by {_K} order by o) as pl, lag(hi) over (partition by {_K} order by o) as ph from em) where pl is distinct from lo or ph is distinct from hi),
la as (select {_K}, max(o) as o, arg_max(lo, o) as llo, arg_max(hi, o) as lhi from ed group by all),
tl as (select w.doc_id, w.parent_no, w.part_no, w.lo, g.n, la.o, llo, lhi, coalesce(list_sum(l[w.lo + 1:n]) < 250 and list_sum(l[llo + 1:n]) <= 1100, false) as joins
  from gw w join gl g using ({_K}) left join la using ({_K}) where k = g.n),
gr as (select {_K}, o, lo, hi from ed where ({_K}, o) not in (select {_K}, o from tl where joins) union all select {_K}, o, llo, n from tl where joins
  union all select {_K}, 1000000000, lo, n from tl where not joins and (llo is distinct from lo or lhi is distinct from n)),
ch as (select {_K}, row_number() over (partition by {_K} order by o) - 1 as child_no, hi - lo as n_blocks, (list_sum(l[lo + 1:hi]) + extra)::bigint as text_length, ids[lo + 1:hi] as ids from gr join gl using ({_K})),
po as (select doc_id, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from (select doc_id, max(parent_no) + 1 as n from pr group by 1)),
ci as (select *, printf('parent-%d-%06d-%02d', doc_id, (before + parent_no)::bigint, part_no) as parent_id from ch join po using (doc_id)),
cc as (select *, printf('%s-child-%04d', parent_id, child_no) as child_id from ci)"""


#: Least, target and most length of a chunk, overlapping blocks, most useful length of a parent that is merged; no headings.
CUTS = {
    "C0": (250, 700, 1100, 1, 0, False), "C1": (180, 450, 800, 1, 0, False), "C2": (350, 900, 1400, 1, 0, False), "C3": (250, 700, 1100, 1, 250, False),
    "C4": (250, 700, 1100, 0, 0, False), "C5": (250, 700, 1100, 2, 0, False), "C6": (250, 700, 1100, 0, 0, True),
}


def chunks_sql(t: str, low: int, target: int, high: int, overlap: int, merge: int, fixed: bool) -> str:
    """CTEs of one policy's chunks, block by block, over blocks; the last is ch_t with the texts' blocks."""
    head = "false" if fixed else "(element_type = 'heading1')"
    merged = f"""mp_{t} as (select doc_id, parent_no, n, u, sum(n) over (partition by doc_id order by parent_no) - n as t0, sum(n) over (partition by doc_id order by parent_no) as t1
  from (select doc_id, parent_no, sum(text_length) as n, coalesce(sum(text_length) filter (keep), 0) as u from pq_{t} group by all)),
mr_{t} as (select doc_id, -1::bigint as k, null::bigint as w, null::hugeint as tw, null::bigint as ls, null::hugeint as tls, null::bigint as a, null::bigint as b from (select distinct doc_id from mp_{t})
  union all select doc_id, k, case when small and not joins then k end, case when small and not joins then t0 end,
    case when joins then w when not small then k else ls1 end, case when joins then tw when not small then t0 else tls1 end,
    case when w is not null then case when joins then w else ls1 end end, case when joins then w when not small then k end
  from (select *, case when w is not null and not joins and not extends then w else ls end as ls1, case when w is not null and not joins and not extends then tw else tls end as tls1
    from (select r.doc_id, p.parent_no as k, r.w, r.tw, r.ls, r.tls, p.t0, p.u > 0 and p.u < {merge} as small, coalesce(p.t1 - r.tw <= 6000, false) as joins, coalesce(p.t0 - r.tls <= 6000, false) as extends
      from mr_{t} r join mp_{t} p on p.doc_id = r.doc_id and p.parent_no = r.k + 1))),
me_{t} as (select m.doc_id, m.w as k, case when z.t1 - m.tls <= 6000 then m.ls else m.w end as st from mr_{t} m join mp_{t} z on z.doc_id = m.doc_id and z.parent_no = m.k
    where m.w is not null and m.k = (select max(parent_no) from mp_{t} x where x.doc_id = m.doc_id)
  union all select doc_id, k - 1, a from mr_{t} where a is not null union all select doc_id, k, b from mr_{t} where b is not null),
pm_{t} as (select q.* exclude (parent_no), dense_rank() over (partition by q.doc_id order by st) - 1 as parent_no from pq_{t} q join me_{t} e on e.doc_id = q.doc_id and e.k = q.parent_no),"""
    k = "doc_id, parent_no, part_no"
    return f"""sg_{t} as (select *, sum({head}::int) over (partition by doc_id order by line rows unbounded preceding) as seg, (not {head} and text_length > 0) as keep, {head} as ctx from blocks),
pq_{t} as (select *, dense_rank() over (partition by doc_id order by seg) - 1 as parent_no from sg_{t}),
{merged if merge else ''}
pr_{t} as (select *, row_number() over (partition by doc_id, parent_no order by line) as i from {'pm' if merge else 'pq'}_{t}),
pw_{t} as (select doc_id, parent_no, 0::bigint as i, 0 as part_no, 0::bigint as used, false as has from (select distinct doc_id, parent_no from pr_{t})
  union all select w.doc_id, w.parent_no, r.i, w.part_no + f::int, case when f then r.text_length else w.used + r.text_length end, case when f then r.keep else w.has or r.keep end
  from (select w.*, w.i > 0 and w.used + r.text_length > 6000 and w.has as f from pw_{t} w join pr_{t} r on r.doc_id = w.doc_id and r.parent_no = w.parent_no and r.i = w.i + 1) w join pr_{t} r on r.doc_id = w.doc_id and r.parent_no = w.parent_no and r.i = w.i + 1),
pb_{t} as (select r.*, w.part_no from pr_{t} r join pw_{t} w using (doc_id, parent_no, i)),
gl_{t} as (select {k}, list(text_length order by line) filter (keep) as l, (count(*) filter (keep))::int as n, list(block_id order by line) filter (keep) as ids, list(text order by line) filter (keep) as texts,
  coalesce(sum(text_length) filter (ctx), 0) as extra, coalesce(string_agg(text, chr(10) order by line) filter (ctx) || chr(10), '') as lead from pb_{t} group by all),
gw_{t} as (select {k}, 0 as k, 0 as lo, null::int as a, null::int as b, null::int as c, null::int as d from gl_{t} where n > 0
  union all select {k}, k + 1, case when c2 then greatest(lo1, k + 1 - {overlap}) else lo1 end, case when c1 then lo end, case when c1 then k end, case when c2 then lo1 end, case when c2 then k + 1 end
  from (select *, list_sum(l[lo1 + 1:k + 1]) >= {target} and k + 1 < n as c2 from (select *, case when c1 then greatest(lo, k - {overlap}) else lo end as lo1
    from (select w.*, l, n, k > lo and list_sum(l[lo + 1:k + 1]) > {high} and list_sum(l[lo + 1:k]) >= {low} as c1 from gw_{t} w join gl_{t} using ({k}) where k < n)))),
em_{t} as (select {k}, k * 2 as o, a as lo, b as hi from gw_{t} where a is not null union all select {k}, k * 2 + 1, c, d from gw_{t} where c is not null),
ed_{t} as (select * from (select *, lag(lo) over (partition by {k} order by o) as pl, lag(hi) over (partition by {k} order by o) as ph from em_{t}) where pl is distinct from lo or ph is distinct from hi),
la_{t} as (select {k}, max(o) as o, arg_max(lo, o) as llo, arg_max(hi, o) as lhi from ed_{t} group by all),
tl_{t} as (select w.doc_id, w.parent_no, w.part_no, w.lo, g.n, la.o, llo, lhi, coalesce(list_sum(l[w.lo + 1:n]) < {low} and list_sum(l[llo + 1:n]) <= {high}, false) as joins
  from gw_{t} w join gl_{t} g using ({k}) left join la_{t} la using ({k}) where k = g.n),
gr_{t} as (select {k}, o, lo, hi from ed_{t} where ({k}, o) not in (select {k}, o from tl_{t} where joins) union all select {k}, o, llo, n from tl_{t} where joins
  union all select {k}, 1000000000, lo, n from tl_{t} where not joins and (llo is distinct from lo or lhi is distinct from n)),
ch_{t} as (select '{t}' as variant, {k}, row_number() over (partition by {k} order by o) - 1 as child_no, hi - lo as n_blocks, (list_sum(l[lo + 1:hi]) + extra)::bigint as text_length, ids[lo + 1:hi] as ids,
  lead || array_to_string(texts[lo + 1:hi], chr(10)) as text from gr_{t} join gl_{t} using ({k}))"""


def _taken(rank: int) -> str:
    """The state after a rank: the best target that its candidate contains, and that none before took, is used."""
    return f"""s{rank} as (select z.variant, z.query_id, case when z.i is null then used else list_append(used, z.i) end as used, dcg + coalesce(grade, 0) / log2({rank + 1}.0::double) as dcg
from (select s.variant, s.query_id, any_value(used) as used, any_value(dcg) as dcg, min(i) filter (i is not null and not list_contains(used, i)) as i from s{rank - 1} s left join (select * from mt where rank = {rank}) m using (variant, query_id) group by all) z
left join gi on gi.query_id = z.query_id and gi.i = z.i)"""


def _limit(place: int) -> str:
    return "case variant " + " ".join(f"when '{t}' then {c[place]}" for t, c in CUTS.items()) + " end"


ABLATION = f"""with recursive {BLOCKS}, {BASE}, {', '.join(chunks_sql(t, *c) for t, c in CUTS.items())},
vc as ({' union all '.join(f'select * from ch_{t}' for t in CUTS)}),
vk as (select *, printf('%019d-%06d-%02d-%04d', doc_id, parent_no::bigint, part_no, child_no) as key from vc),
kept as ({' union all '.join(f"select '{t}' as variant, count(*) filter (keep) as retrievable from sg_{t}" for t in CUTS)}),
sb as (select *, count(*) over (partition by variant, doc_id, parent_no, part_no) as siblings from vc),
sz as (select variant, count(*) as child_count, round(avg(n_blocks), 6) as mean_blocks, list_sort(list(text_length)) as v, count(*) filter (n_blocks = 0 or text_length <= 0) as empty,
  count(*) filter (text_length < {_limit(0)} and n_blocks = 1 and siblings > 1) as short from sb group by all),
cv as (select variant, count(distinct block_id) as covered from (select variant, unnest(ids) as block_id from vc) group by all),
gt as (select variant, child_count, mean_blocks, v[cast(round_even((child_count - 1) * 0.5, 0) as int) + 1] as p50, v[cast(round_even((child_count - 1) * 0.95, 0) as int) + 1] as p95,
  round(covered / retrievable::double, 6) as coverage, empty, short from sz join cv using (variant) join kept using (variant)),
gf as (select * exclude (empty, short), array_to_string(list_filter([case when empty > 0 then 'empty_child_count' end, case when coverage < 1 then 'retrievable_block_coverage_below_threshold' end,
  case when p95 > {_limit(2)} then 'child_length_p95_above_max' end, case when short > 0 then 'short_standalone_child' end], lambda x: x is not null), ',') as failures from gt),
vtok as (select variant, key, doc_id, ids, list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)) as t from vk),
vcorp as (select variant, count(*) as n, avg(len(t)) as avgdl from vtok group by all),
vdf as (select variant, tok, count(*) as df from (select variant, unnest(list_distinct(t)) as tok from vtok) group by all),
vraw as (select variant, tok, ln(n - df + 0.5) - ln(df + 0.5) as raw from vdf join vcorp using (variant)),
vmean as (select variant, avg(raw) as mean from vraw group by all),
vidf as (select variant, tok, case when raw < 0 then 0.25 * mean else raw end as idf from vraw join vmean using (variant)),
vtf as (select variant, key, dl, tok, count(*) as tf from (select variant, key, len(t) as dl, unnest(t) as tok from vtok) where tok in (select tok from qt) group by all),
vs as (select variant, query_id, key, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join vtf using (tok) join vidf using (variant, tok) join vcorp using (variant) group by all),
vr as (select variant, query_id, key, row_number() over (partition by variant, query_id order by round(score, 8) desc, key desc) as rank from vs qualify rank <= 5),
vh as (select variant, query_id, rank, doc_id, list_append(ids, 'doc:' || doc_id) as held from vr join vtok using (variant, key)),
gc as (select rel.query_id, rel.doc_id, parent_no, part_no, child_no, grade, ids as blocks from rel join benchmark b on item_id = rel.query_id join vc on variant = 'C0' and vc.doc_id = rel.doc_id and contains(vc.text, {norm('b.text')})),
gd as (select * from gc union all select query_id, doc_id, -1, -1, -1, grade, ['doc:' || doc_id] from rel where (query_id, doc_id) not in (select query_id, doc_id from gc)),
gi as (select *, row_number() over (partition by query_id order by grade desc, doc_id, parent_no, part_no, child_no) as i from gd),
mt as (select variant, query_id, rank, i from vh join gi using (query_id, doc_id) where list_has_all(held, blocks)),
s0 as (select variant, query_id, []::bigint[] as used, 0.0::double as dcg from (select distinct variant from vc), jq), {', '.join(_taken(r) for r in range(1, 6))},
fr as (select variant, query_id, min(rank) as first from mt group by all), hc as (select variant, query_id, count(*) as n_hits from vh group by all),
idl as (select query_id, sum(grade / log2(i + 1.0::double)) as ideal from gi where i <= 5 group by all),
pq as (select s5.variant, query_id, expected, coalesce((first <= 1)::double, 0) as hit_1, coalesce((first <= 3)::double, 0) as hit_3, coalesce((first <= 5)::double, 0) as hit_5, coalesce(round(1.0 / first, 6), 0) as rr,
  coalesce(least(1.0, round(dcg / ideal, 6)), 0) as ndcg, coalesce(n_hits, 0) as n_hits from s5 join jq using (query_id) left join fr using (variant, query_id) left join hc using (variant, query_id) left join idl using (query_id)),
ms as (select variant, count(*) filter (expected = 'retrieve') as n_queries, {', '.join(f"round(coalesce(avg({c}) filter (expected = 'retrieve'), 0), 6) as {n}" for n, c in (('recall_1', 'hit_1'), ('recall_3', 'hit_3'), ('recall_5', 'hit_5'), ('mrr', 'rr'), ('ndcg_5', 'ndcg')))},
  count(*) filter (expected = 'abstain' and n_hits > 0) as abstain_with_candidates from pq group by all),
al as (select * from gf join ms using (variant)), el as (select variant from al a, (select recall_5 as br, mrr as bm, abstain_with_candidates as ba from al where variant = 'C0')
  where failures = '' and abstain_with_candidates <= ba and (recall_5 > br or mrr > bm) order by recall_5 desc, mrr desc, ndcg_5 desc, variant limit 1)
select *, variant = coalesce((select variant from el), 'C0') as selected from al"""


HEARD = f"""heard as (select pair_id, reference, heard from (select conv_id * 1000 + turn as pair_id, text as reference, lead(text) over (partition by conv_id order by turn) as heard from conversations) where heard is not null
  union all select * from {_values(SPOKEN, 'pair_id, reference, heard')})"""
_CH = lambda c: f"regexp_replace(lower({c}), '[^0-9a-z가-힣]', '', 'g')"
FLAG = lambda **w: "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in w.items()) + "], lambda x: x is not null), ',')"



#: The context of evidence, item by item within 4200 characters.
CONTEXT = """it as (select query_id, row_number() over (partition by query_id order by pack_rank) as i, '[evidence:' || pack_rank || '] child_id=' || doc_id || ' doc_id=' || root_id || chr(10) || trim(text) as part
  from packed join documents using (doc_id) where trim(text) <> ''),
cx as (select query_id, 0::bigint as i, 4200::bigint as room, []::varchar[] as parts, 0::bigint as chars, 0 as cut from (select distinct query_id from it)
  union all select query_id, i, case when room > 0 then room - length(own) - 2 else room end, case when room > 0 then list_append(parts, own) else parts end, case when room > 0 and cut = 0 then chars + least(length(part), room) else chars end, greatest(cut, (room > 0 and cut = 0 and length(part) > room)::int)
  from (select x.query_id, it.i, room, parts, chars, cut, part, case when length(part) > room then rtrim(substr(part, 1, greatest(room - 3, 0))) || '...' else part end as own from cx x join it on it.query_id = x.query_id and it.i = x.i + 1)),
ce as (select query_id, arg_max(parts, i) as parts, arg_max(chars, i) as chars, arg_max(cut, i) as cut, max(i) as n from cx group by 1)"""


def _summary(policy: str, ctes: str) -> str:
    return f"""select '{policy}' as policy, * from (with recursive {EVIDENCE}, {ctes}, {PM} select query_type, coalesce(child_covered, false)::int as c, coalesce(parent_covered, false)::int as p, coalesce(doc_covered, false)::int as d, round(coalesce(1.0 / first, 0), 6) as o, coalesce(chars, 0) as chars from eq left join pm using (query_id))"""


def _state(source: str, n: str, *limits: str) -> str:
    return f"""(with recursive {EVIDENCE}, {greedy(source, *limits)}, {PM} select query_id, case when child_covered or parent_covered then 'direct' when doc_covered then 'doc_only' else 'miss' end as {n}, first as {n}_first from eq left join pm using (query_id))"""


def _side(source: str, n: str) -> str:
    """Measures of one policy's evidence, its columns prefixed."""
    return f"""(with recursive {EVIDENCE}, {greedy(source)}, {PM} select query_id, coalesce(child_covered or parent_covered, false) as {n}_direct, coalesce(doc_covered, false) as {n}_doc, coalesce(child_covered, false) as {n}_correct,
 round(1 - coalesce(dd, 0), 6) as {n}_recall, round(coalesce(1.0 / first, 0), 6) as {n}_order, coalesce(dp, 0) as {n}_dup, coalesce(n_items, 0) as {n}_n, coalesce(chars, 0) > 4200 as {n}_over from eq left join pm using (query_id))"""


TWO = f"two as (select *, b_recall > a_recall as gain, b_n > 0 as b_buildable, query_id % 11 - 9 as b_truncated from {_side(P0, 'a')} join {_side(P2, 'b')} using (query_id))"

ORACLES: dict[str, str] = {
    "normalize_pages": f"""select page_id, sha256(t) as text_hash, length(t) as text_length, coalesce(try_cast(k as int), nullif(regexp_extract(k, '[0-9]+'), '')::int, 0)::bigint as page_number
from (select page_id, nullif({norm(stripped('html'))}, '') as t, regexp_extract(url, '[^/]*$') as k from pages)""",
    "page_elements": f"""select page_id, i - 1 as ord, regexp_extract(e, '^<(h1|p|li)>', 1) as tag, length({norm(stripped('e'))}) as text_length
from (select page_id, unnest(l) as e, generate_subscripts(l, 1) as i from (select page_id, regexp_extract_all(html, '(?s)<h1>.*?</h1>|<p>.*?</p>|<li>.*?</li>') as l from pages))""",
    "page_offsets": f"with {LINES}, c as (select doc_id, count(*) as n from lines group by 1) select doc_id, (coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as page_offset from c",
    "block_quality": f"""with {BLOCKS} select count(*) as block_count, count(*) - count(distinct block_id) as duplicate_block_id_count, 0::bigint as negative_page_global_count, 0::bigint as missing_text_hash_count,
count(*) filter (text_length <= 0) as empty_text_count, {FLAG(duplicate_block_id_count='count(*) - count(distinct block_id) > 0', empty_text_count='count(*) filter (text_length <= 0) > 0', no_blocks='count(*) = 0')} as failures from blocks""",
    "parser_quality": f"""with {BLOCKS}, e as (select doc_id, len(string_split(text, chr(10)))::int as expected_pages from documents),
b as (select doc_id, count(*) as block_count, count(distinct line) as covered_pages, min(text_length) as min_length, list_sort(list(text_length))[cast(round_even((count(*) - 1) * 0.5, 0) as int) + 1] as p50_length,
 list_sort(list(text_length))[cast(round_even((count(*) - 1) * 0.95, 0) as int) + 1] as p95_length, max(text_length) as max_length, count(*) - count(distinct text_hash) as duplicate_hash_count from blocks group by 1)
select doc_id, expected_pages, coalesce(block_count, 0) as block_count, coalesce(covered_pages, 0) as covered_pages, min_length, p50_length, p95_length, max_length, coalesce(duplicate_hash_count, 0) as duplicate_hash_count,
 greatest(expected_pages - coalesce(covered_pages, 0), 0) as missing_pages from e left join b using (doc_id)""",
    "leak_scan": f"""select doc_id, regexp_matches(replace(t, '/', '\\'), '([A-Za-z]:[\\\\/]|\\\\\\\\[^\\\\/]+[\\\\/][^\\\\/]+)') or regexp_matches(t, '(?i)(^|{SPACE[:-1]})/(home|users|mnt|var|tmp|private|runner|workspace|root)/') as private_path,
regexp_matches(lower(t), 'sk-|api_key=|apikey=|ghp_|github_pat_|hf_|xoxb-|bearer |password=|token=|secret=') as secret_like, contains(s, chr(10)) or contains(s, chr(13)) or length(s) > 600 as source_like
from (select doc_id, t, regexp_replace(t, '^{SPACE}|{SPACE}$', '', 'g') as s from (select doc_id, coalesce(text, '') as t from documents union all select doc_id, coalesce(text, '') from {_values(LEAKY, 'doc_id, text')}))""",
    "consecutive_blocks": f"with {PROSE} select doc_id, n_blocks from pb",
    "stratified_sample": "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as r from documents) where r <= 3",
    "parent_segments": f"""with {BLOCKS}, s as (select *, sum((element_type = 'heading1')::int) over (partition by doc_id order by line rows unbounded preceding)::int as segment from blocks)
select doc_id, segment, coalesce(min(case when element_type = 'heading1' then text end), 'front_matter') as title, min(case when element_type = 'heading1' then block_id end) as heading_block_id, count(*) as n_blocks, sum(text_length)::bigint as text_length,
sum(case when element_type <> 'heading1' then text_length else 0 end)::bigint as retrievable_length from s group by all""",
    "chunk_ablation": ABLATION,
    "child_groups": f"with recursive {CHILDREN} select child_id, parent_id, doc_id, n_blocks, text_length from cc",
    "child_chunks": f"""with recursive {CHILDREN}, x as (select child_id, parent_id, doc_id, unnest(ids) as block_id, generate_subscripts(ids, 1) as place from cc),
j as (select child_id, parent_id, x.doc_id, string_agg(text, chr(10) order by place) as text, sha256(string_agg(text_hash || ':' || text_length, '|' order by place)) as text_hash, bool_or(contains(text, '�')) as broken, bool_or(element_type = 'table') as tabled from x join blocks using (block_id) group by all)
select child_id, parent_id, doc_id, 1 as page_start, 1 as page_end, list_filter([case when broken then 'replacement_character' end, case when tabled then 'has_table' end], lambda y: y is not null) as quality_flags, text, text_hash from j""",
    "evidence_pack_p0": packed(P0),
    "evidence_pack_p1": packed(P1, most="7"),
    "evidence_pack_p2": packed(P2),
    "evidence_pack_p3": f"with recursive {EVIDENCE}, {MMR}, {greedy(P3)} select query_id, pack_rank::int as pack_rank, doc_id, parent_id, rank::bigint as rank, text_length::bigint as text_length, clipped from packed",
    "evidence_context": f"{PACK0}, {CONTEXT} select query_id, length(array_to_string(parts, chr(10) || chr(10))) as n_chars, sha256(array_to_string(parts, chr(10) || chr(10))) as digest from ce",
    "evidence_stats": f"{PACK0}, {CONTEXT} select query_id, n as n_text, chars as context_chars, cut as truncated from ce",
    "pack_summary": f"""with m as ({' union all '.join(_summary(p, c) for p, c in (("P0_rank_order", greedy(P0)), ("P1_parent_expansion", greedy(P1, most="7")), ("P2_best_first_with_parent", greedy(P2)), ("P3_mmr_diversity", f"{MMR}, {greedy(P3)}"), ("P4_voice_compact", greedy(P4, *VOICE))))})
select policy, coalesce(query_type, 'all') as query_type, count(*) as n_queries, round(avg(c), 6) as child_covered, round(avg(p), 6) as parent_covered, round(avg(d), 6) as doc_covered, round(avg(o), 6) as order_proxy, sum(chars)::bigint as chars from m group by grouping sets ((policy), (policy, query_type))""",
    "evidence_movement": f"""select count(*) filter (b_first < a_first) as improved, count(*) filter (b_first > a_first) as regressed, count(*) filter (a = 'doc_only' and b = 'direct') as doc_only_to_direct, count(*) filter (a = 'direct' and b = 'doc_only') as direct_to_doc_only, count(*) filter (a = 'direct' and b = 'miss') as direct_to_miss
from {_state(P0, 'a')} join {_state(P4, 'b', *VOICE)} using (query_id)""",
    "evidence_pack_p4": packed(P4, *VOICE),
    "pack_metrics": f"""{PACK0}, {PM} select query_id, coalesce(n_items, 0) as n_items, coalesce(chars, 0)::bigint as chars, coalesce(child_covered, false) as child_covered, coalesce(parent_covered, false) as parent_covered, coalesce(doc_covered, false) as doc_covered,
coalesce(dp, 0) as duplicate_parent_rate, coalesce(dd, 0) as duplicate_doc_rate, round(coalesce(1.0 / first, 0), 6) as order_proxy from eq left join pm using (query_id)""",
    "citation_eval": f"""{PACK0}, c as (select p.*, exists (select 1 from tgt t where t.query_id = p.query_id and (t.doc_id = p.doc_id or t.parent_id = p.parent_id or t.root_id = p.root_id)) as good from packed p where p.query_id % 2 = 1 or p.pack_rank in (1, 2)),
tr as (select distinct query_id, unnest(['c' || doc_id, 'p' || parent_id, 'd' || root_id]) as ref from tgt), cr as (select distinct query_id, unnest(['c' || doc_id, 'p' || parent_id, 'd' || root_id]) as ref from c),
n as (select query_id, expected, (select count(*) from c where c.query_id = eq.query_id) as n, (select count(*) from c where c.query_id = eq.query_id and good) as g, (select count(*) from tr where tr.query_id = eq.query_id) as t,
  (select count(*) from tr join cr using (query_id, ref) where tr.query_id = eq.query_id) as h, not exists (select 1 from packed p where p.query_id = eq.query_id) as ab from eq),
m as (select *, case when ab then case when n = 0 then 1.0 else 0.0 end when n = 0 then 0.0 when t = 0 then 1.0 else g / n::double end as pr, case when t = 0 then case when ab then 1.0 else 0.0 end else h / t::double end as rc from n)
select query_id, expected, n::int as n_citations, round(pr, 6) as citation_precision, round(rc, 6) as citation_recall, ab = (expected = 'abstain') as abstention_correct, (not ab and expected = 'retrieve' and pr = 0) as unsupported_claim from m""",
    "classify_turns": f"with {CLASSIFIED} select query_id, predicted, confidence, fallback_used from cls",
    "guard_turns": f"""with {GUARDED} select query_id, predicted, guarded, guard_applied, case when not is_rel then 'not_relationship_prediction' when guard_applied then {FLAG(block_overview_tie_risk='tie', block_fact_reason_risk='not strong and reason0', block_weak_relationship_intent='not strong')}
else 'allow_strong_relationship_intent' end as guard_reasons from gy""",
    "route_turns": f"with {GUARDED} select guarded, case when guarded = 'no_answer' then 'abstain' when guarded = 'relationship' then 'hybrid_weighted' else 'dense' end as execution_mode, count(*) as n from gy group by all",
    "confusion_matrix": "select quality::varchar as expected, case when length(text) > 1000 then '1' else '0' end as predicted, count(*) as n from labels join documents using (doc_id) group by all",
    "class_prf": """with p as (select quality::varchar as e, case when length(text) > 1000 then '1' else '0' end as p from labels join documents using (doc_id)), c as (select unnest(['0', '1', '2']) as label),
n as (select label, count(*) filter (e = label and p = label) as tp, count(*) filter (p = label) as pn, count(*) filter (e = label) as support from c, p group by label),
m as (select *, coalesce(tp / nullif(pn, 0)::double, 0) as a, coalesce(tp / nullif(support, 0)::double, 0) as b from n)
select label, support, round(a, 6) as precision, round(b, 6) as recall, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) as f1 from m""",
    "tradeoff_tags": f"""with {BASE}, p as (select query_id, query_id % 5 = 0 as none, b.hit_1 - a.hit_1 as pr, b.hit_5 - a.hit_5 as re, b.hit_3 - a.hit_3 as co, query_id % 7 - 4 as ci, query_id % 6 = 0 as un, query_id % 3 - 1 as ms from {A} a join {B} b using (query_id)),
t as (select *, {FLAG(no_answer_regression='none and (un or ci <> 0)', correctness_regression='co < 0', unsupported_claim_regression='un', precision_gain='pr > 0', precision_regression='pr < 0', recall_regression='re < 0', citation_count_reduction='ci < 0', evidence_over_pruning_risk='ci <= -3 and (re < 0 or co < 0)', latency_improvement='ms < 0', latency_regression='ms > 0')} as tags from p)
select query_id, case when tags = '' then 'no_metric_change' else tags end as tags, case when co < 0 or un then 'generation_contract_candidate' when pr < 0 or re < 0 then 'citation_selection' when ms > 0 then 'latency_cost' else 'no_regression' end as surface from t""",
    "guardrail_routes": f"""with {TWO}, t as (select *, {FLAG(candidate_direct_missing='not b_direct', no_candidate_gain='a_direct and not gain', doc_coverage_loss='not b_doc', context_unstable='not b_buildable or b_truncated > 0 or b_over', correctness_regression='a_correct and not b_correct', precision_regression_without_recall_gain='a_correct and not b_correct and not gain', low_evidence_order='b_order < 0.4', evidence_order_drop='b_order - a_order < -0.5', duplicate_parent_over_limit='b_dup - a_dup > 0.2')} as bad,
{FLAG(direct_ready_gain='b_direct and not a_direct', citation_recall_gain='gain')} as good from two)
select query_id, case when bad = '' then 'candidate_passed_guardrail' when good = '' then bad else bad || ',' || good end as block_reasons, bad <> '' as blocked,
case when bad = '' then 'use_candidate_direct_gain' when bad like '%correctness_regression%' then 'use_baseline_correctness_guardrail' when bad like '%doc_coverage_loss%' then 'use_baseline_doc_guardrail'
when regexp_matches(bad, 'precision_regression|low_evidence|order_drop|duplicate_parent') then case when good <> '' then 'manual_review_required' else 'use_baseline_precision_guardrail' end else 'use_baseline_no_candidate_gain' end as route from t""",
    "regression_tags": f"""with {TWO}, t as (select *, {FLAG(direct_ready_gain='b_direct and not a_direct', direct_ready_loss='a_direct and not b_direct', citation_precision_regression='a_correct and not b_correct', citation_recall_gain='gain', citation_recall_regression='b_recall < a_recall', correctness_gain='b_correct and not a_correct', correctness_regression='a_correct and not b_correct', evidence_order_regression='b_order < a_order', latency_improved='b_n < a_n', mixed_tradeoff='((b_direct and not a_direct) or gain) and a_correct and not b_correct', guardrail_required='(a_correct and not b_correct) or (a_direct and not b_direct)')} as tags from two)
select query_id, case when tags = '' then 'no_material_change' else tags end as tags from t""",
    "postings_expand": f"with {POST} select query_id, token, n from ex",
    "graph_score": graph("0.52::double * base + 0.24::double * dr + 0.18::double * pr + 0.06::double * rr"),
    "graph_community": graph("0.46::double * base + 0.18::double * dr + 0.26::double * wr + 0.10::double * rr"),
    "tree_parent": tree(False),
    "tree_summary": tree(True),
    # The distance counts bytes here, so each of a pair's characters becomes one byte.
    "cer": f"""with {HEARD}, c as (select pair_id, list_filter(string_split({_CH('reference')}, ''), lambda x: x <> '') as a, list_filter(string_split({_CH('heard')}, ''), lambda x: x <> '') as b from heard),
e as (select pair_id, len(a) as n, array_to_string(list_transform(a, lambda x: chr(list_position(k, x)::int)), '') as a, array_to_string(list_transform(b, lambda x: chr(list_position(k, x)::int)), '') as b from (select *, list_distinct(list_concat(a, b)) as k from c))
select pair_id, round(levenshtein(a, b) / greatest(n, 1)::double, 6) as cer from e""",
    "char_f1": f"""with {HEARD}, r as (select pair_id, ch, count(*) as r from (select pair_id, unnest(string_split({_CH('reference')}, '')) as ch from heard) where ch <> '' group by all),
h as (select pair_id, ch, count(*) as h from (select pair_id, unnest(string_split({_CH('heard')}, '')) as ch from heard) where ch <> '' group by all),
s as (select pair_id, sum(least(coalesce(r, 0), coalesce(h, 0))) as same, sum(coalesce(r, 0)) as r, sum(coalesce(h, 0)) as h from r full join h using (pair_id, ch) group by 1),
m as (select heard.pair_id, coalesce(same / nullif(s.h, 0)::double, 0) as p, coalesce(same / nullif(s.r, 0)::double, 0) as q from heard left join s on s.pair_id = heard.pair_id)
select pair_id, round(p, 6) as char_precision, round(q, 6) as char_recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) as char_f1 from m""",
    "score_aggregates": """select source, count(quality) as n, round(avg(quality), 6) as mean, min(quality) as least, max(quality) as largest, list_sort(list(quality))[cast(round_even((count(*) - 1) * 0.5, 0) as int) + 1] as p50,
case when count(quality) > 1 then round(stddev_pop(quality), 6) end as stddev from labels join documents using (doc_id) group by source""",
    "dataset_profile": "select case when grouping(source) = 1 then 'all' when grouping(lang) = 1 then source else source || '/' || lang end as cell, count(*) as n from documents group by rollup (source, lang)",
    "dataset_shortfall": "select source, lang, coalesce(n, 0) as n, greatest(12 - coalesce(n, 0), 0) as shortfall from (select * from (select distinct source from documents), (select distinct lang from documents)) left join (select source, lang, count(*) as n from documents group by all) using (source, lang)",
    "resolvability": "select count(*) as ref_count, count(*) filter (d.doc_id is not null) as resolved_count, count(*) filter (d.doc_id is null) as missing_count from (select distinct doc_id from labels) l left join (select distinct doc_id from documents) d on l.doc_id = d.doc_id",
    "table_manifest": "select count(*) as row_count, count(o_orderkey) - count(distinct o_orderkey) as duplicate_key_count, sum((o_orderkey is null)::int + (o_custkey is null)::int + (o_orderstatus is null)::int + (o_totalprice is null)::int + (o_orderdate is null)::int + (o_orderpriority is null)::int)::bigint as null_count from orders",
    "catalog_quality": """with e as (select n_nationkey as a, n_regionkey * 7 as b from nation) select 0::bigint as duplicate_place_count, (select sum(c - 1)::bigint from (select count(*) as c from nation group by substr(n_name, 1, 2))) as duplicate_alias_count,
(select count(*) from e where b not in (select n_nationkey from nation)) as unknown_target_count, (select count(*) from e where a = b) as self_relation_count, (select count(*) from nation where n_nationkey not in (select a from e union select b from e)) as isolated_place_count""",
    "event_tumbling": "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "event_sliding": "select w as window_start, count(*) as n, count(distinct user_id) as users from (select user_id, unnest([time_bucket(interval '6 hours', ts) - k * interval '6 hours' for k in range(4)]) as w from events) group by 1",
    "event_session": """select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n from (select *, sum(s) over (partition by user_id order by ts, event_id) as g from
(select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as s from events)) group by user_id, g""",
    "event_as_of": """select l.event_id, r.v as last_value from (select * from events where event_type <> 'purchase') l asof left join (select user_id, ts, max(value) as v from events where event_type = 'purchase' group by all) r on l.user_id = r.user_id and l.ts >= r.ts""",
}

_TOLD_PLACES = ", ".join(f"('{i}', {100 + k}, '{name}', {aliases}::varchar[], {related}::varchar[])" for k, (i, name, aliases, related) in enumerate(PLACES))
PLACE_INDEX = f"""pl as (select 'n' || n_nationkey as place_id, n_nationkey::bigint as ord, n_name as name, [lower(n_name)[1:3], lower(n_name)] as aliases, ['n' || (n_nationkey + 1) % 25, 'n' || n_regionkey] as related from nation
  union all select * from (values {_TOLD_PLACES}) as v),
pw as (select *, list_filter(w, lambda x, i: list_position(w, x) = i)[1:4] as names from (select *, list_prepend(name, aliases) as w from pl)),
te as (select place_id, ord, unnest(list_prepend(name, aliases)) as term, generate_subscripts(list_prepend(name, aliases), 1) as k from pl),
nx as (select {norm("lower(term)")} as name, place_id, min((ord * 1000 + k)) as own from te group by 1, 2 having {norm("lower(term)")} <> ''),
ix as (select *, min(own) over (partition by name) as first from nx)"""


def _stands(text: str) -> str:
    return f"case when regexp_matches(name, '[0-9a-z]') then regexp_matches({text}, '(^|[^0-9a-z])' || regexp_escape(name) || '([^0-9a-z]|$)') else contains({text}, name) end"


ORACLES["name_mentions"] = f"""with nm as (select item_id, list_sort(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda x: {{'n': length(x), 'x': lower(x)}}))[-1].x as name from benchmark),
d as (select doc_id, {norm("lower(coalesce(text, ''))")} as t from documents)
select doc_id, item_id, name from d, nm where name <> '' and {_stands('t')}"""
ORACLES["rewrite_followups"] = f"""with {CLASSIFIED}, {PLACE_INDEX},
aq as (select query_id, predicted as query_type, query_text, user_context, query_id % 17 = 0 as abstain, case when n_places > 0 then ['n' || ((query_id % 30) + 30) % 30, 'bukchon'] else []::varchar[] end as given,
  {norm("lower(concat_ws(' ', nullif(query_text, ''), nullif(user_context, '')))")} as t from cls),
wt as (select * from aq where not abstain and query_type in ('place_fact', 'place_story', 'route_context', 'voice_followup')),
pm as (select query_id, place_id, min(o) as o from (select query_id, ix.place_id, 1000000000 + first * 1000 + own // 1000 as o from wt, ix where {_stands('t')}
  union all select query_id, unnest(given), generate_subscripts(given, 1) from wt) where place_id in (select place_id from pl) group by all),
pn as (select query_id, list(place_id order by o) as ids, flatten(list(names order by o)) as l, flatten(list(related order by o)) as r from pm join pw using (place_id) group by all),
ol as (select query_id, array_to_string(list(x order by i), ' ') as names from (select query_id, x, min(i) as i from (select query_id, unnest(l) as x, generate_subscripts(l, 1) as i from pn) group by all) group by all),
rl as (select query_id, x, min(i) as i from (select query_id, unnest(r) as x, generate_subscripts(r, 1) as i from pn) group by all),
rn as (select query_id, string_agg(name, ' ' order by i) as names from (select *, row_number() over (partition by query_id order by i) as place from rl) join pl on place_id = x where place <= 3 group by all),
sg as (select aq.query_id, aq.query_type, abstain or aq.query_type = 'no_answer' as guarded, regexp_replace(coalesce(query_text, ''), '^{SPACE}|{SPACE}$', '', 'g') as q,
  case when user_context <> '' then rtrim('이전 맥락: ' || rtrim({norm('user_context')}[1:240])) end as c, case when ol.names <> '' then '장소 단서: ' || ol.names end as p, case when aq.query_type = 'route_context' then '관련 장소: ' || rn.names end as r,
  case aq.query_type when 'place_fact' then '검색 의도: 한양 조선 역사 장소' when 'place_story' then '검색 의도: 한양 조선 역사 이야기 관광 설명' when 'route_context' then '검색 의도: 한양 서울 동선 연결' when 'voice_followup' then '검색 의도: 한양 조선 이전 맥락 장소' end as i,
  array_to_string(pn.ids, ',') as places from aq left join ol using (query_id) left join rn using (query_id) left join pn using (query_id)),
st as (select *, case when guarded then 'no_answer_guard' when i is null then 'query_type_passthrough' end as stop from sg)
select query_id, case when stop is not null then q else array_to_string(list_filter([nullif({norm('q')}, ''), case when lower(c) is distinct from lower({norm('q')}) then c end, p, r, i], lambda x: x is not null), ' ') end as rewritten, rewritten <> q as changed, coalesce(places, '') as places,
coalesce(stop, {FLAG(place_alias_expansion='places is not null', voice_context_expansion="query_type = 'voice_followup' and c is not null", route_related_place_expansion='r is not null', query_type_intent_terms='i is not null')}) as rules from st"""
ORACLES["rewrite_summary"] = f"""select count(*) as n, count(*) filter (rewritten <> '') as success_count, count(*) filter (changed) as changed_count, count(*) filter (rewritten = '') as invalid_count,
round(coalesce(count(*) filter (rewritten = '') / nullif(count(*), 0)::double, 0), 6) as invalid_rate, count(*) filter (rules = 'no_answer_guard') as no_answer_guard_count from ({ORACLES["rewrite_followups"]})"""
ORACLES["label_summary"] = f"""select (select sum(n) from ({ORACLES["confusion_matrix"]}))::bigint as n, (select round(sum(case when expected = predicted then n else 0 end) / sum(n)::double, 6) from ({ORACLES["confusion_matrix"]})) as accuracy,
round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1 from ({ORACLES["class_prf"]})"""
ORACLES["public_pack_rows"] = f"""{PACK0}, {PM} select 'first' as comparison_id, 'P0_rank_order' as policy_id, eq.query_id, eq.query_type, p.pack_rank, p.rank as source_rank, p.doc_id as child_id, p.parent_id, p.root_id as doc_id,
coalesce(p.text_length, 0) as estimated_chars, true as citation_recoverable, coalesce(pm.child_covered, false) as target_child_covered, coalesce(pm.parent_covered, false) as target_parent_covered, coalesce(pm.doc_covered, false) as target_doc_covered
from eq left join packed p on p.query_id = eq.query_id left join pm on pm.query_id = eq.query_id"""
ORACLES["order_subset"] = "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')"
ORACLES["input_faults"] = """with q as (select c_custkey as id, case when c_acctbal > 0 then 'F' else 'O' end as t, count(*) over (partition by c_custkey) as n from customer),
f as (select coalesce(q.id, o.o_custkey) as id, bool_or(q.id is null or o.o_custkey is null) as alone, bool_or(q.t <> o.o_orderstatus) as other, max(q.n) > 1 or count(o.o_custkey) > 1 as many from q full join orders o on q.id = o.o_custkey group by 1),
c as (select count(*) filter (alone) as unmatched_ids, count(*) filter (other) as type_mismatches, count(*) filter (many) as repeated_ids from f) select *, unmatched_ids + type_mismatches + repeated_ids = 0 as passed from c"""
ORACLES["benchmark_rubric"] = """with c as (select count(*) as n, count(*) filter (o_orderstatus = 'F') as t, count(*) filter (o_orderstatus <> 'F') as d from orders)
select n as n_items, concat_ws(',', case when n <> 105 then 'private_benchmark_query_count_mismatch' end, case when d <> 70 then 'private_benchmark_dev_query_count_mismatch' end, case when t <> 35 then 'private_benchmark_test_query_count_mismatch' end,
case when d > 0 then 'private_benchmark_dev_status_not_reviewed' end, 'private_benchmark_dev_query_type_count_mismatch', 'private_benchmark_test_query_type_count_mismatch', 'private_benchmark_answerability_distribution_mismatch') as failures, false as passed from c"""
ORACLES["line_leaks"] = f"""with d as (select doc_id, text from documents union all select * from {_values(LEAKY + TOLD, 'doc_id, text')}),
l as (select doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) as line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) as n from d),
c as (select *, trim(trim(regexp_extract(line, '(?i)(?:api[_-]?key|apikey|password|token|secret)[ \\t]*[:=](.*)$', 1), ' ' || chr(9)), chr(34) || chr(39)) as v from l)
select doc_id, n::int as line_number from c where regexp_matches(line, '[A-Za-z]:\\\\') or regexp_matches(line, 'sk-[A-Za-z0-9]') or v <> ''"""


_BARE = f"regexp_replace(v, '^{SPACE}|{SPACE}$', '', 'g')"
ORACLES["artifact_quality"] = f"""with {PROSE},
art as (select 'doc:' || doc_id as artifact_id, repeat('{{"in":[', (doc_id % 41)::int) || json_object('rank', 1, 'source', source, 'meta', json_object('lang', lang, 'n_chars', n_chars), 'lines', string_split(text, chr(10)))::varchar || repeat(']}}', (doc_id % 41)::int) as payload,
  coalesce(n_blocks, 0) as n_blocks from documents left join pb using (doc_id)
  union all select 'turn:' || conv_id || ':' || turn, json_object('results', [json_object('query_id', conv_id * 1000 + turn, 'role', role, case when turn % 2 = 0 then 'answer' else 'note' end, text)], 'raw_text', [role])::varchar, 0 from conversations
  union all select 'told:' || doc_id, json_object('value', text)::varchar, 0 from {_values(LEAKY, 'doc_id, text')} union all select 'cut', '{{"a": ["b"', 0),
ok as (select artifact_id, payload from art where artifact_id <> 'cut'), nodes as (select artifact_id, t.key, t.type, t.fullkey, t.atom->>'$' as v from ok, json_tree(ok.payload) t),
strs as (select artifact_id, 'value' as kind, fullkey, v from nodes where type = 'VARCHAR' union all select artifact_id, 'key', fullkey, key from nodes where key is not null and not ends_with(fullkey, ']')),
cnt as (select artifact_id, count(v) as n_strings, max(length(regexp_replace(fullkey, '[^.\\[]', '', 'g'))) as depth,
  count(*) filter (kind = 'key' and v in ('answer', 'answer_text', 'context_text', 'content', 'html', 'markdown', 'raw_text', 'search_text', 'source_text', 'text')) as forbidden,
  count(*) filter (kind = 'key' and v in ('answer', 'answer_text', 'context_text', 'content', 'html', 'markdown', 'raw_text', 'search_text', 'source_text', 'text') and regexp_matches(fullkey, '^\\$\\.results\\[[0-9]+\\]\\.[^.\\[]*$')) as rf,
  count(*) filter (contains({_BARE}, chr(10)) or contains({_BARE}, chr(13)) or length({_BARE}) > 600) as source_like,
  count(*) filter (regexp_matches(replace(v, '/', '\\'), '([A-Za-z]:[\\\\/]|\\\\\\\\[^\\\\/]+[\\\\/][^\\\\/]+)') or regexp_matches(v, '(?i)(^|{SPACE[:-1]})/(home|users|mnt|var|tmp|private|runner|workspace|root)/')) as pp,
  count(*) filter (regexp_matches(lower(v), 'sk-|api_key=|apikey=|ghp_|github_pat_|hf_|xoxb-|bearer |password=|token=|secret=')) as sl from strs group by all)
select artifact_id, coalesce(n_strings, 0) as n_strings, coalesce(depth, 0)::int as depth, coalesce(forbidden + source_like, 0) + n_blocks as public_raw_text_leakage_count, coalesce(pp, 0) as private_path_leakage_count, coalesce(sl, 0) as secret_like_leakage_count,
  coalesce(rf, 0) as forbidden_result_field_count, {FLAG(public_raw_text_leakage='coalesce(forbidden + source_like, 0) + n_blocks > 0', private_path_leakage='pp > 0', secret_like_leakage='sl > 0', forbidden_result_fields='rf > 0', unreadable_payload="artifact_id = 'cut'")} as failures
from art left join cnt using (artifact_id)"""


def _report(blocks: str, rows: str, leaks: int) -> str:
    zero = "duplicate_parent_id_count duplicate_child_id_count orphan_child_count parent_without_child_count empty_child_count missing_source_block_ref_count unknown_element_ref_count invalid_page_range_count cross_document_parent_count cross_document_child_count header_footer_retrieval_child_count table_provenance_loss_count private_path_leakage_count public_sample_raw_text_count public_sample_private_path_count public_candidate_path_secret_leakage_count".split()
    gates = {c: f"{c} > 0" for c in zero} | {"citation_recoverability_below_threshold": "citation_recoverability < 0.99", "retrievable_block_coverage_below_threshold": "retrievable_block_coverage < 1", "child_length_p95_above_max": "child_length_p95 > 1100", "short_standalone_child": "short_standalone_child_count > 0"}
    nth = lambda kind, p: f"(select v[cast(round_even((len(v) - 1) * {p}, 0) as int) + 1] from (select list_sort(list(text_length)) as v from k where kind = '{kind}'))"
    return f"""with recursive {CHILDREN},
gp as (select doc_id, parent_no, part_no, list(block_id order by line) as ids, sum(text_length)::bigint as text_length, list(block_id order by line) filter (element_type = 'heading1') as heads from pb group by all),
pa as (select printf('parent-%d-%06d-%02d', gp.doc_id, (before + parent_no)::bigint, part_no) as parent_id, gp.*, (select count(*) from ch c where c.doc_id = gp.doc_id and c.parent_no = gp.parent_no and c.part_no = gp.part_no) as n from gp join po using (doc_id)),
fb as ({blocks}),
rw as (select 'parent' as kind, parent_id, null::varchar as child_id, doc_id, text_length, n, ids, []::varchar[] as heads, -1 as child_no from pa
  union all select 'child', cc.parent_id, child_id, cc.doc_id, cc.text_length, n_blocks, cc.ids, coalesce(pa.heads, []), child_no from cc join pa using (parent_id)),
rx as ({rows}),
k as (select *, row_number() over () as rid, count(*) over (partition by kind, parent_id) as siblings from rx where kind = 'child' or n > 0),
rf as (select rid, unnest(ids) as block_id, generate_subscripts(ids, 1) as pos from k),
rj as (select rf.*, fb.block_id is null as gone, fb.doc_id as block_doc, element_type, no_refs, no_file, broken, 1 < page_start or 1 > page_end as outside, fb.text_hash, fb.text_length as bl from rf join k using (rid) left join fb on fb.block_id = rf.block_id),
ag as (select rid, count(*) filter (gone) as missing, count(distinct block_doc) as docs, count(*) filter (no_refs) as unknown, count(*) filter (not gone and (no_refs or no_file or outside)) as lost, count(*) filter (not gone and outside) as outside, count(*) filter (broken) as broken,
  string_agg(case when gone then '' else text_hash || ':' || bl end, '|' order by pos) as h from rj group by all),
hd as (select rid, string_agg(text_hash || ':' || text_length, '|' order by line) as h from (select rid, unnest(heads) as block_id from k) join fb using (block_id) group by all),
z as (select k.*, missing, docs, unknown, lost, outside, broken, concat_ws('|', hd.h, ag.h) as h from k join ag using (rid) left join hd using (rid)),
us as (select distinct unnest(ids) as block_id from k where kind = 'child'),
c as (select count(*) filter (kind = 'parent') as parent_chunk_count, count(*) filter (kind = 'child') as child_chunk_count, count(*) filter (kind = 'parent') - count(distinct parent_id) filter (kind = 'parent') as duplicate_parent_id_count,
  count(*) filter (kind = 'child') - count(distinct child_id) filter (kind = 'child') as duplicate_child_id_count, 0::bigint as parent_without_child_count, count(*) filter (kind = 'child' and (n = 0 or text_length <= 0)) as empty_child_count,
  coalesce(sum(missing) filter (kind = 'child'), 0)::bigint as missing_source_block_ref_count, coalesce(sum(unknown) filter (kind = 'child'), 0)::bigint as unknown_element_ref_count, count(*) filter (page_end < page_start or outside > 0) as invalid_page_range_count,
  count(*) filter (kind = 'parent' and docs > 1) as cross_document_parent_count, count(*) filter (kind = 'child' and docs > 1) as cross_document_child_count, 0::bigint as header_footer_retrieval_child_count,
  count(*) filter (kind = 'parent' and text_length < 250) as micro_parent_count, count(*) filter (kind = 'child' and text_length < 250 and n = 1 and siblings > 1) as short_standalone_child_count,
  count(*) filter (kind = 'child') - count(distinct h) filter (kind = 'child') as duplicate_child_text_hash_count,
  round(count(*) filter (kind = 'child' and missing = 0 and lost = 0) / count(*) filter (kind = 'child')::double, 6) as citation_recoverability, round(count(*) filter (kind = 'child' and broken > 0) / count(*) filter (kind = 'child')::double, 6) as replacement_char_child_rate from z),
m as (select c.*, (select count(*) from k where kind = 'child' and parent_id not in (select parent_id from k where kind = 'parent')) as orphan_child_count, (select count(*) from rx where kind = 'parent' and n = 0) as filtered_parent_count,
  (select count(*) from fb) as source_block_count, (select count(*) from sg where keep) as retrievable_block_count, (select count(*) from sg where keep and block_id in (select block_id from us)) as covered_retrievable_block_count,
  (select count(*) from fb where element_type = 'table' and block_id not in (select block_id from us)) as table_provenance_loss_count, {nth('child', 0.5)} as child_length_p50, {nth('child', 0.95)} as child_length_p95, {nth('parent', 0.5)} as parent_length_p50, {nth('parent', 0.95)} as parent_length_p95,
  {leaks}::bigint as private_path_leakage_count, 0::bigint as public_sample_raw_text_count, 0::bigint as public_sample_private_path_count, 0::bigint as public_candidate_path_secret_leakage_count from c),
y as (select *, round(covered_retrievable_block_count / retrievable_block_count::double, 6) as retrievable_block_coverage from m)
select *, {FLAG(**gates)} as failures from y"""


_SPOILT = """select * replace (case when child_no = 0 and doc_id % 73 = 4 then list_append(ids, 'lost') when child_no = 0 and doc_id % 71 = 5 then list_append(ids, 'block-' || (doc_id + 1) || '-00000') else ids end as ids), 1 as page_start, case when doc_id % 89 = 3 then 0 else 1 end as page_end
  from (select * from rw where not (kind = 'parent' and doc_id % 83 = 1) union all select * from rw where child_no = 0 and doc_id % 79 = 2)"""
_FULL = "select blocks.*, contains(text, '�') as broken, {} as no_refs, {} as no_file from blocks"
ORACLES["chunk_quality"] = _report(_FULL.format("false", "false"), "select *, 1 as page_start, 1 as page_end from rw", 0)
ORACLES["chunk_report"] = _report(_FULL.format("doc_id % 97 = 5", "doc_id % 101 = 7"), _SPOILT, 2)
ORACLES["event_session_stream"] = ORACLES["event_session"]

_ANSWERED = """ct as (select query_id, string_agg(doc_id, ',' order by case when query_id % 2 = 0 then -pack_rank else pack_rank end) as cited, arg_min(root_id, case when query_id % 2 = 0 then -pack_rank else pack_rank end) as place from packed where query_id % 2 = 1 or pack_rank in (1, 2) group by all),
wp as (select query_id, list_distinct([min(root_id), max(root_id)]) as w from tgt group by all),
ga as (select ce.*, eq.query_type, b.text as q, not exists (select 1 from packed p where p.query_id = ce.query_id) as ab, ce.query_id % 7 = 0 as high, coalesce(cited, '') as cited, place, case when ce.query_id % 5 <> 0 then w end as w
  from ce join eq using (query_id) join benchmark b on b.item_id = ce.query_id left join ct using (query_id) left join wp using (query_id)),
gb as (select *, case when ab then '' else q end as answer, split_part(q, '.', 1) || '.' as spoken, expected = 'retrieve' as re from ga),
gc as (select *, re and not ab and n_citations > 0 and citation_precision > 0 and citation_recall > 0 and not high as correct_with_evidence, case when w is null then 1.0 when ab then 0.0 else round(list_contains(w, place)::int / len(w)::double, 6) end as place_relevance,
  case when not regexp_matches(trim(spoken), '[\\n\\r\\[\\]]') and not contains(spoken, 'http://') and not contains(spoken, 'https://') and length(trim(spoken)) between case when ab then 10 else 15 end and case when ab then 160 else 260 end then 1.0 else 0.0 end as spoken_naturalness,
  not ab and (high or (re and citation_precision = 0)) as claim from gb)"""
_CITED = ORACLES["citation_eval"][len(PACK0) + 2 :]
_HEAD, _LAST = _CITED.rsplit("\nselect ", 1)
GENERATED = f"{PACK0}, {_HEAD}, ce as (select {_LAST}), {_ANSWERED}"
_RECORD = """select query_id, query_type, expected, ab as abstained, n_citations, citation_precision, citation_recall, abstention_correct, correct_with_evidence, place_relevance, spoken_naturalness,
(case when not re then abstention_correct and not claim else correct_with_evidence and place_relevance > 0 and spoken_naturalness > 0 and not claim and length(trim(answer)) between 20 and 1200 end)::int::double as usefulness, claim as unsupported_claim, high as high_risk,
length(answer) as answer_chars, length(spoken) as spoken_chars, sha256(answer || chr(31) || spoken || chr(31) || cited)[1:16] as answer_fingerprint from gc"""
ORACLES["generation_record"] = f"{GENERATED} {_RECORD}"
_GM = lambda c, n, when="true": f"round(coalesce(avg({c}::double) filter ({when}), 0), 6) as {n}"
ORACLES["generation_summary"] = f"""{GENERATED}, gr as ({_RECORD}) select coalesce(query_type, 'all') as query_type, count(*) as eval_count, count(*) filter (expected = 'retrieve') as answerable_count, count(*) filter (expected = 'abstain') as no_answer_count,
count(*) filter (not abstained) as answered_count, count(*) filter (abstained) as abstained_count, {_GM('correct_with_evidence::int', 'correct_with_evidence_rate', "expected = 'retrieve'")}, {_GM('citation_precision', 'citation_precision', "expected = 'retrieve'")}, {_GM('citation_recall', 'citation_recall', "expected = 'retrieve'")},
{_GM('place_relevance', 'place_relevance')}, {_GM('usefulness', 'usefulness')}, {_GM('spoken_naturalness', 'spoken_naturalness')}, {_GM('unsupported_claim::int', 'unsupported_claim_rate')}, {_GM('abstention_correct::int', 'abstention_accuracy')},
count(*) filter (expected = 'retrieve' and not abstained and n_citations = 0) as missing_citation_count, count(*) filter (high_risk) as unsupported_high_count from gr group by grouping sets ((query_type), ())"""

ORACLES["pack_deltas"] = f"""with s as (select * from ({ORACLES["pack_summary"]}) where query_type = 'all')
select s.policy, {', '.join(f'round(s.{c} - b.{c}, 6) as delta_{c}' for c in ('child_covered', 'parent_covered', 'doc_covered', 'order_proxy'))}, s.chars - b.chars as delta_chars from s, (select * from s where policy = 'P0_rank_order') b"""
