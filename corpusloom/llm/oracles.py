"""DuckDB SQL for the queries that SQL can express over whole tables.

The others have a learned model or a dynamic program in their result; tests compare them with
plain versions on small fixtures.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_REPEATS = rf"""with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as ws from documents),
win as (
  select r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) as k
  from (select r, ws, unnest(range(1, len(ws) - 33)) as i from d)),
twice as (select k from win group by k having count(*) > 1),
gone as (select distinct r, i + o as p from win semi join twice using (k), (select unnest(range(35)) as o)),
word as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
kept as (
  select r, string_agg(w, ' ' order by p) as text from word anti join gone using (r, p) group by r),
lost as (select r, count(*) as n from gone group by r)
select doc_id, len(ws) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r) left join lost using (r)"""

_OVERLAPS = rf"""with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from documents),
b as (
  select item_id, ws, least(13, len(ws)) as n
  from (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from benchmark) where len(ws) > 0),
bw as (
  select distinct item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') as k
  from (select *, unnest(range(1, len(ws) - n + 2)) as i from b)),
dw as (
  select r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') as k
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from b))),
hit as (select r, dw.n as n, i, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
words as (select r, count(distinct i + o) as n_hit from hit, (select unnest(range(13)) as o) where o < n group by r),
items as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from hit) group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join words using (r) left join items using (r)"""

_NEAR = rf"""with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as ws from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as k
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (k) where a.doc_id < b.doc_id group by all),
link as (
  select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (
  select doc_id as id, doc_id as seen from documents
  union select reach.id, edge.b from reach join edge on edge.a = reach.seen),
least_of as (select id, min(seen) as component_id from reach group by id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents left join n using (doc_id) join least_of on id = doc_id"""

# The checksum's table by its rule (polynomial 0xEDB88320), then a byte at a time.
_CRC = """tab as (
  select list(list_reduce(list_concat([n], range(8)), lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as t
  from range(256) r(n)),
"""
_CRC_OF = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(spot, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""
_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _inserted(costs: list[str]) -> str:
    """Four states' cheapest (cost, audit, repaired) when rows may be put in first."""
    def one(state: str, role: str) -> str:
        return f"{{'c': {state}.c + 5, 'a': 'I' || {state}.a, 'r': '{role}:' || chr(10) || {state}.r}}"

    zero, first, two, three = costs
    best2, best3 = f"least({two}, {one(three, 'assistant')})", f"least({three}, {one(two, 'user')})"
    return f"[least({zero}, {one(best2, 'user')}), least({first}, {one(best2, 'user')}), {best2}, {best3}]"


def _row_before(state: int) -> str:
    """The cheapest way over a row from a state, from the states after it (v, from 1)."""
    turned = {0: {"s": 2, "u": 3}, 1: {"u": 3}, 2: {"a": 4}, 3: {"u": 3}}[state]
    role, target = [("user", 3), ("user", 3), ("assistant", 4), ("user", 3)][state]
    keep = " ".join(f"when i = '{i}' then v[{t}]" for i, t in turned.items())
    keep_as = f"(case {keep} end)"
    out = [f"{{'c': v[{state + 1}].c + 2, 'a': 'D' || v[{state + 1}].a, 'r': v[{state + 1}].r}}"]
    far = "case when gone then 1000000000000 else 0 end"
    out.append(f"{{'c': v[{target}].c + 1 + extra + {far}, 'a': 'R' || v[{target}].a, 'r': '{role}:' || txt || chr(10) || v[{target}].r}}")
    initials = ", ".join(f"'{i}'" for i in turned)
    out.append(
        f"{{'c': case when i in ({initials}) and not gone then {keep_as}.c + extra else 2000000000000 end, "
        f"'a': 'K' || coalesce({keep_as}.a, ''), 'r': role || ':' || txt || chr(10) || coalesce({keep_as}.r, '')}}"
    )
    return f"least({', '.join(out)})"


_FAR = "{'c': 1000000000000::bigint, 'a': '', 'r': ''}"
_DONE = "{'c': 0::bigint, 'a': '', 'r': ''}"
_REPAIR = f"""with recursive {_CRC}
hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as txt,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as spot from conversations),
marked as (select *, ({_CRC_OF}) % 20 as fault from hit, tab),
broken as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then translate(txt, '.!?', '') else txt end as txt,
    unnest(range(case when fault = 3 then 2 else 1 end)) as copy
  from marked where fault <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, txt, copy) as p,
    rtrim(txt, {_BLANKS}) as body from broken),
judged as (
  select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, txt order by p) > 1 then 'd'
    when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(role[1]) over (partition by conv_id order by p) || role[1] as pair
  from placed),
rows_of as (
  select dense_rank() over (order by conv_id nulls first) as c, p, role, role[1] as i, txt, fault in ('b', 'd') as gone, case when fault = 't' then 5 else 0 end as extra
  from judged),
costs as (
  select c, max(p) as p, [{_DONE}, {_FAR}, {_FAR}, {_DONE}] as raw from rows_of group by c
  union all
  select c, p - 1, [{', '.join(_row_before(s) for s in range(4))}]
  from (select c, p, role, i, txt, gone, extra, {_inserted(['raw[1]', 'raw[2]', 'raw[3]', 'raw[4]'])} as v from costs join rows_of using (c, p))),
solved as (select c, ({_inserted(['raw[1]', 'raw[2]', 'raw[3]', 'raw[4]'])})[1] as best from costs where p = 0),
counted as (
  select dense_rank() over (order by conv_id nulls first) as c, conv_id,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 'b')::int) as blank, sum((fault = 'd')::int) as duplicate,
    sum((fault = 't')::int) as truncated, sum((pair is not null and pair not in ('su', 'ua', 'au'))::int) as illegal
  from judged group by conv_id)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(left(best.r, greatest(length(best.r) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) ids left join counted using (conv_id) left join solved using (c)"""


def _clusters(rounds: int = 3, k: int = 16, dims: int = 64) -> str:
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::bigint"
    steps = [
        f"""kept as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
c0 as (
  select row_number() over (order by h, v) - 1 as cluster, v as w
  from (select v, sha256('1:' || cast(vec_id as varchar)) as h from kept) order by h, v limit {k})"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} as (
  select r, vec_id, v, cluster, distance
  from (select r, vec_id, v, cluster, {distance} as distance from kept, c{t}) qualify row_number() over (partition by r order by distance, cluster) = 1)"""
        )
        if t < rounds:
            steps.append(
                f"""m{t} as (
  select cluster, list((s - (s % n + n) % n) // n order by i) as mean
  from (select cluster, i, sum(v[i])::bigint as s, count(*) as n from a{t}, range(1, {dims + 1}) d(i) group by cluster, i) group by cluster),
c{t + 1} as (select cluster, coalesce(mean, w) as w from c{t} left join m{t} using (cluster))"""
            )
    return f"""with {", ".join(steps)}
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""


LLM_ORACLES: dict[str, str] = {
    "op3_substring_dedup": _REPEATS,
    "op8_decontamination": _OVERLAPS,
    "op9_near_duplicates": _NEAR,
    "op12_conversation_repair": _REPAIR,
    "op13_centroids": _clusters(),
}
