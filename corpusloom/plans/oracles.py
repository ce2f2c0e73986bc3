"""Equivalent SQL over the same tables, for every query SQL can express."""

from __future__ import annotations

DOCS = """docs as (
  select concat('docs/', cast(doc_id as varchar)) as id, concat('docs/', cast(doc_id as varchar), '.md') as path,
         doc_id, lang as type, substring(split_part(text, chr(10), 1), 1, 80) as title, source as category,
         concat(source, ' ', lang) as tags, text as body
  from documents)"""

LINKED_SQL = """select concat('docs/', cast(d.doc_id as varchar)) as id, d.doc_id,
    concat(d.text, chr(10), chr(10), '[a](/docs/', cast((d.doc_id*7+3) % m.m as varchar), '.md) [b](',
      cast((d.doc_id*11+1) % m.m as varchar), '.md#s) [[docs/', cast((d.doc_id*13+5) % m.m as varchar), '|w]]',
      case when d.doc_id % 10 = 0 then ' [x](../../out.md) [e](https://example.com/y.md)' else '' end) as body
  from documents d cross join (select cast(floor(count(*)*1.1) as bigint) as m from documents) m"""
LINKED = f"linked as ({LINKED_SQL})"

# Links of `linked`: inline links by pattern, wikilinks by pattern, targets resolved for the shapes that occur.
LINKS = LINKED + r""",
found as (
  select id as src, 'markdown' as syntax, unnest(regexp_extract_all(body, '\[[^\]\[]*\]\(([^()\s]+)\)', 1)) as target from linked
  union all
  select id, 'wikilink', unnest(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) from linked),
cut as (
  select src, syntax, target, case when syntax = 'markdown' then regexp_extract(target, '^[^?#]*') else trim(target) end as clean from found),
links as (
  select src, syntax, target,
    case when syntax = 'wikilink' then 'concept'
         when regexp_matches(clean, '^[A-Za-z][A-Za-z0-9+.-]*:') then 'external'
         when clean like '../../%' then 'escape'
         when clean like '%.md' then 'concept' else 'empty' end as kind,
    clean from cut),
resolved as (
  select src, syntax, target, kind,
    case when kind <> 'concept' then null
         when syntax = 'wikilink' then clean
         when clean like '/%' then regexp_replace(substring(clean, 2), '\.md$', '')
         else concat('docs/', regexp_replace(clean, '\.md$', '')) end as dst from links),
known as (select *, dst in (select id from linked) as known from resolved),
edges as (select distinct src, dst from known where kind = 'concept' and known),
unres as (select src, syntax, dst from known where kind = 'concept' and not known),
inbound as (select l.id, count(e.src) as n from linked l left join edges e on e.dst = l.id group by l.id)"""

_TOPIC = """concat(body, ' ', case doc_id % 3 when 0 then '[[concepts/topic-' when 1 then '[[topic-' else '[[Topic ' end,
  cast(doc_id % 40 as varchar), ']]')"""
TOPIC_LINKS = LINKS.replace(LINKED_SQL, f"select id, doc_id, {_TOPIC} as body from ({LINKED_SQL})")
_MARK = "concat(body, case when doc_id % 13 = 0 then concat(chr(10), '⚠️ **Contradiction**: x') else '' end)"
MARKED_LINKS = LINKS.replace(LINKED_SQL, f"select id, doc_id, {_MARK} as body from ({LINKED_SQL})")

_STUBS = """sized as (
  select dst as topic, count(distinct src) as mentions from unres group by dst),
stubs as (
  select topic, concat('concepts/', name) as id, replace(name, '-', ' ') as title, mentions
  from (select *, regexp_replace(topic, '^concepts/', '') as name from sized
        where mentions >= 2 and regexp_matches(topic, '^(concepts/)?[^/]+$'))
  where regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$') and length(name) <= 80
    and concat('concepts/', name) not in (select id from linked))"""

NORM = r"trim(regexp_replace(lower({0}), '[\p{{P}}\p{{S}}\s]+', ' ', 'g'))"


def norm(column: str) -> str:
    return NORM.format(column)


def compact(column: str) -> str:
    return rf"regexp_replace(lower({column}), '[\p{{P}}\p{{S}}\s]+', '', 'g')"


def term_rows(source: str, key: str, text: str, prefix: str = "") -> str:
    """CTEs ending in {prefix}terms(k, pos, term): distinct terms in generation order."""
    p = prefix
    return rf"""{p}nq as (select {key} as k, {norm(text)} as n from {source}),
{p}raw_terms as (
  select k, list_concat(
    case when n <> '' then [n] else [] end,
    case when replace(n, ' ', '') <> '' and replace(n, ' ', '') <> n then [replace(n, ' ', '')] else [] end,
    list_filter(string_split(n, ' '), lambda w: length(w) >= 2),
    regexp_extract_all(n, '[a-z0-9]{{2,}}')) as ts from {p}nq),
{p}pos_terms as (select k, unnest(ts) as term, generate_subscripts(ts, 1) as p from {p}raw_terms),
{p}first_terms as (select k, term, min(p) as p from {p}pos_terms group by k, term),
{p}terms as (
  select k, term, row_number() over (partition by k order by p) - 1 as pos from {p}first_terms)"""


def slug(column: str) -> str:
    """Slug of text without full-width letters or reserved names."""
    return rf"""(select case when s = '' then 'untitled' else s end from (select
  trim(substring(trim(regexp_replace(trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}\s-]', '', 'g')), '[\s-]+', '-', 'g'), '-'), 1, 80), '-') as s))"""


ORACLES: dict[str, str] = {}

ORACLES["registry_build"] = f"""with {DOCS}
select id, type, coalesce(nullif(trim(title), ''), split_part(id, '/', 2)) as title, category, tags,
  cast(null as varchar) as created, cast(null as varchar) as updated,
  concat('{{"owner":"', category, '","size":', cast(length(body) as varchar), '}}') as extensions, 'page' as origin from docs
union all
select concat('sources/', pid), 'source', case when page_id % 3 = 0 then url else pid end, null, null,
  case when page_id % 2 = 0 then '2024-05-01' end, case when page_id % 2 = 0 then '2024-05-01' end, null, 'packet'
from (select page_id, url, case when page_id % 5 = 0 then concat('P', cast(page_id as varchar))
  else concat('DIR-', cast(page_id as varchar)) end as pid from pages)"""

_HAY = "concat(lower(id), chr(10), lower(title), chr(10), lower(type), chr(10), lower(category), chr(10), lower(tags))"
ORACLES["registry_search"] = f"""with {DOCS},
reg as (select id, coalesce(nullif(trim(title), ''), split_part(id, '/', 2)) as title, type, category, tags from docs)
select id, title, type, 'SRC1' as search from reg where contains({_HAY}, 'src1')
union all
select id, title, type, 'er:EN' from reg where contains({_HAY}, 'er') and lower(type) = 'en'"""

ORACLES["pages_by_type"] = "select lang as type, count(*) as pages from documents group by lang"

ORACLES["status"] = f"""with {LINKS}
select total_pages, types, orphans, gaps, case when total_pages = 0 then 'Empty' when orphans > 5 then 'Warning' else 'Good' end as health
from (select (select count(*) from documents) as total_pages, (select count(distinct lang) from documents) as types,
  (select count(*) from inbound where n = 0) as orphans, (select count(distinct dst) from unres) as gaps)"""

ORACLES["index_by_type"] = f"""with {DOCS}
select type, 1 as section, id, concat('- [[', id, ']] — ', coalesce(nullif(trim(title), ''), split_part(id, '/', 2)),
  ' *(created: unknown)*') as line from docs
union all
select distinct type, 0, '', concat('## ', upper(substring(type, 1, 1)), substring(type, 2), 's') from docs"""

ORACLES["index_locale_order"] = f"""with {DOCS},
titled as (select type, id, coalesce(nullif(trim(title), ''), split_part(id, '/', 2)) as title from docs)
select coalesce(nullif(type, ''), 'unknown') as type, id, title,
  row_number() over (partition by coalesce(nullif(type, ''), 'unknown') order by title collate en, id) as position from titled"""

_ESC = r"regexp_replace({0}, '([\\\[\]])', '\\\1', 'g')"
ORACLES["directory_index"] = f"""with {DOCS},
pg as (select category as d1, concat('lang ', type) as d2, cast(doc_id as varchar) as name,
  case when length(title) > 20 then title end as title, case when type = 'en' then concat('a b ', category) end as description from docs)
select '' as dir, 0 as section, '' as name, '# My \\[Wiki\\]' as line
union all select distinct d1, 0, '', concat('# ', d1) from pg
union all select distinct concat(d1, '/', d2), 0, '', concat('# ', d2) from pg
union all select distinct '', 1, d1, concat('- [', d1, '/](', d1, '/)') from pg
union all select distinct d1, 1, d2, concat('- [', d2, '/](', replace(d2, ' ', '%20'), '/)') from pg
union all select concat(d1, '/', d2), 2, name, concat('- [', {_ESC.format("coalesce(nullif(trim(title), ''), name)")}, '](', name, '.md)',
  case when description is not null then concat(' — ', description) else '' end) from pg"""

ORACLES["identity_collisions"] = f"""with {DOCS},
paths as (select path from docs union all select concat('Docs/', cast(doc_id as varchar), '.md') from labels
  union all select concat('DOCS/', cast(vec_id as varchar), '.md') from embeddings),
firsts as (select lower(path) as k, min(path) as f from paths group by 1)
select 'error' as severity, 'concept_identity_collision' as code, p.path, concat('Identity collision between ', f, ' and ', p.path) as message
from paths p join firsts on lower(p.path) = k where p.path <> f"""

ORACLES["link_extract"] = f"with {LINKS} select src, syntax, target, kind, dst from resolved"
ORACLES["backlinks"] = f"with {LINKS} select l.id, e.src from linked l left join edges e on e.dst = l.id"
ORACLES["inbound_counts"] = f"with {LINKS} select id, n from inbound"
# Broken edits leave the earlier page in place, so all pages are there in the end.
ORACLES["refresh_result"] = ORACLES["inbound_counts"]
ORACLES["maintained_projections"] = f"""with {LINKS}
select 'inbound' as projection, id as key, '' as detail, n from inbound
union all select 'backlink', l.id, coalesce(e.src, ''), 1 from linked l left join edges e on e.dst = l.id
union all select distinct 'gap', dst, src, 1 from unres
union all select 'gap size', dst, '', count(*) from unres group by dst
union all select 'directory', ':', '# Wiki', 0 union all select 'directory', 'docs:', '# docs', 0
union all select 'directory', ':docs', '- [docs/](docs/)', 1
union all select 'directory', concat('docs:', substring(id, 6)), concat('- [', substring(id, 6), '](', substring(id, 6), '.md)'), 2 from linked
union all select 'status', case when (select count(*) from inbound where n = 0) > 5 then 'Warning' else 'Good' end, '', count(*) from linked
union all select 'status', 'orphans', '', count(*) from inbound where n = 0
union all select 'status', 'gaps', '', count(distinct dst) from unres
union all select 'quarantine', concat(id, '.md'), 'frontmatter_missing', 1 from linked where cast(substring(id, 6) as bigint) % 20 = 0"""
ORACLES["unresolved_links"] = f"with {LINKS} select src, syntax, dst from unres"
ORACLES["link_diagnostics"] = f"""with {LINKS}
select 'warning' as severity, case when kind = 'escape' then 'link_path_escape' else 'link_unresolved' end as code,
  concat(src, '.md') as path, case when kind = 'escape' then concat('Link escapes bundle root: ', target)
  when syntax = 'wikilink' then concat('Unresolved wikilink: ', dst) else concat('Unresolved link: ', dst) end as message
from known where kind = 'escape' or (kind = 'concept' and not known)"""
ORACLES["gaps"] = f"with {LINKS} select distinct dst as topic, src as mentioned_by from unres"
ORACLES["gap_counts"] = f"with {LINKS} select dst as topic, count(distinct src) as mentions, count(*) as links from unres group by dst"
ORACLES["stub_candidates"] = f"with {TOPIC_LINKS}, {_STUBS} select topic, id, title, mentions from stubs"
ORACLES["stub_mentions"] = f"""with {TOPIC_LINKS}, {_STUBS}
select c.id, u.src as mentioned_by, concat('[', u.src, '](/', u.src, '.md)') as link
from (select id, min(topic) as topic from stubs group by id) c join (select distinct dst, src from unres) u on u.dst = c.topic"""
ORACLES["orphans"] = f"with {LINKS} select id from inbound where n = 0"
ORACLES["lint_findings"] = f"""with {MARKED_LINKS}
select 'missing' as kind, src as id, concat('Missing page: ', dst, ' (in ', src, ')') as finding from unres
union all select 'orphan', id, concat('Orphan: ', id, ' has no inbound links') from inbound where n = 0
union all select 'contradiction', id, concat('Contradiction flagged in ', id) from linked where contains(body, '⚠️ **Contradiction')"""
ORACLES["lint_summary"] = f"""with {MARKED_LINKS}
select (select count(*) from linked) as pages, (select count(*) from inbound where n = 0) as orphans,
  (select count(*) from unres) as missing_links, (select count(*) from linked where contains(body, '⚠️ **Contradiction')) as contradictions"""

HEADED = """headed as (
  select concat('docs/', cast(doc_id as varchar)) as id, doc_id, lang as type,
    substring(split_part(text, chr(10), 1), 1, 80) as title, source as category, concat(source, ' ', lang) as tags,
    substring(replace(concat(chr(10), text), concat(chr(10), 'T'), concat(chr(10), '## T')), 2) as body
  from documents)"""
# Sections of `headed`: cut before each '## T' line; the trailing newline stays with the part before.
CHUNKS = HEADED + r""",
parts as (select id, string_split(concat(chr(10), body), concat(chr(10), '## T')) as ps from headed where trim(body, e' \t\n\r') <> ''),
part_rows as (select id, unnest(ps) as part, generate_subscripts(ps, 1) as p from parts),
split_rows as (
  select id, p, case when p = 1 then '' else concat('T', split_part(part, chr(10), 1)) end as heading,
    case when p = 1 then part when strpos(part, chr(10)) = 0 then '' else substring(part, strpos(part, chr(10)) + 1) end as content
  from part_rows where p > 1 or length(part) > 0),
chunks as (
  select id, row_number() over (partition by id order by p) - 1 as chunk_no, case when p = 1 then 0 else 2 end as level,
    trim(heading, e' \t\n\r') as heading, trim(content, e' \t\n\r') as content from split_rows)"""
ORACLES["chunk_sections"] = f"with {CHUNKS} select id, chunk_no, level, heading, content from chunks"
ORACLES["normalize_terms"] = f"with {DOCS} select id, {norm('body')} as normalized from docs"
ORACLES["query_term_rows"] = f"with {DOCS}, {term_rows('docs', 'id', 'title')} select k as id, pos, term from terms"
ORACLES["slugs"] = f"""with {DOCS},
src as (select id, body as text from docs union all select concat('title/', id), title from docs
  union all select concat('part/', cast(p_partkey as varchar)), p_name from part)
select id, {slug('text')} as slug from src"""

BENCH = "bq as (select item_id as query_id, text as query from benchmark)"


def recall_ctes(cosine: bool = False, layered: bool = False) -> str:
    """CTEs ending in scored(k, vault, id, lex, cos, rank1) and detail(k, vault, id, score, rank, ...).

    Page keys are vault|id, so that two vaults may hold the same id.
    """
    keyed = HEADED.replace("headed as (", "plain as (") + (
        f"""), headed as (
  select concat('project|', id) as id, 'project' as vault, {KINDS.format('type')} as type, title, category, tags, body from plain
  union all select concat('personal|docs/', cast(item_id as varchar)), 'personal', {KINDS.format("'note'").replace('doc_id', 'item_id')},
    'Item', 'bench', 'bench note', text from benchmark)"""
        if layered
        else "), headed as (select concat('main|', id) as id, 'main' as vault, type, title, category, tags, body from plain)"
    ).replace("), headed", ", headed", 1)
    chunks = CHUNKS.replace(HEADED, keyed)
    own = "split_part(id, '|', 2)"
    vec = (
        """vecs as (select e.vec_id, concat('main|docs/', cast(e.vec_id as varchar)) as id, embedding::double[] as v from embeddings e),
cosines as (select q.vec_id as k, p.id, list_cosine_similarity(q.v, p.v) as cos from vecs q, vecs p where q.vec_id in (select query_id from bq)),"""
        if cosine
        else "cosines as (select 0 as k, '' as id, 0.0::double as cos where false),"
    )
    expand = term_rows("expansion", "(k, vault)", "joined", "e")
    named = f"coalesce(nullif(trim(title), ''), split_part({own}, '/', 2))"
    return rf"""{chunks}, {BENCH}, {term_rows('bq', 'query_id', 'query')},
tc as (select k, replace(term, ' ', '') as t from terms),
{vec}
fields as (
  select id, 3.0::double as w, {compact(own)} as text_c from headed
  union all select id, case when trim(title) <> '' then 10.0 else 5.0 end, {compact(named)} from headed
  union all select id, 4.0, {compact('category')} from headed
  union all select id, 4.0, {compact('tags')} from headed
  union all select id, 1.0, {compact('type')} from headed),
field_score as (select k, id, sum(w) as s from fields join tc on contains(text_c, t) group by k, id),
chunk_c as (select id, chunk_no, {compact('heading')} as h, {compact('content')} as c from chunks),
chunk_score as (
  select k, id, chunk_no, sum(case when contains(h, t) then 4.0 else 0 end + case when contains(c, t) then 1.0 else 0 end)::double as s
  from chunk_c join tc on contains(h, t) or contains(c, t) group by k, id, chunk_no),
best as (select k, id, s, chunk_no from (select *, row_number() over (partition by k, id order by s desc, chunk_no) as rn from chunk_score) where rn = 1),
lexical as (
  select k, id, sum(s)::double as lex from (select k, id, s from field_score union all select k, id, s from best) group by k, id),
scored as (
  select *, row_number() over (partition by k, vault order by lex desc, id) as rank1 from (
    select coalesce(l.k, c.k) as k, coalesce(l.id, c.id) as id, split_part(coalesce(l.id, c.id), '|', 1) as vault,
      coalesce(l.lex, 0.0)::double as lex, coalesce(c.cos, 0.0)::double as cos
    from lexical l full join (select * from cosines where id in (select id from headed)) c on c.k = l.k and c.id = l.id)
  where lex > 0 or cos >= 0.2),
words as (
  select s.k, s.vault, unnest(string_split({norm(f"concat_ws(' ', {named}, tags, body)")}, ' ')) as word
  from scored s join (select * exclude (vault) from headed) using (id) where rank1 <= 3),
fresh as (
  select w.k, vault, word, count(*) as n from words w join nq on nq.k = w.k
  where length(word) >= 4 and not contains(nq.n, word) and word not in ({STOP}) group by w.k, vault, word),
expansion as (
  select k, vault, string_agg(word, ' ' order by pos) as joined from (
    select *, row_number() over (partition by k, vault order by n desc, word) as pos from fresh) where pos <= 6 group by k, vault),
{expand},
etc as (select k, replace(term, ' ', '') as t from eterms),
boost as (
  select k, id, max(v) as b from (
    select s.k, s.id, chunk_no, sum(case when contains(h, t) then 2.0 else 0 end + case when contains(c, t) then 0.5 else 0 end)::double as v
    from scored s join chunk_c using (id) join etc on etc.k = (s.k, s.vault) where rank1 <= 25 group by s.k, s.id, chunk_no)
  group by k, id),
boosted as (
  select s.k, s.vault, s.id, s.lex + 6.0 * greatest(s.cos, 0) + coalesce(b.b, 0) * 0.4::double as score
  from scored s left join boost b on b.k = s.k and b.id = s.id),
final as (select *, row_number() over (partition by k, vault order by score desc, id) as rank from boosted),
detail as (
  select f.k, f.vault, split_part(f.id, '|', 2) as id, f.score, f.rank, p.type, {named.replace(own, "split_part(f.id, '|', 2)")} as title,
    case when ch.content <> '' then concat(case when ch.heading <> '' then concat('#', ch.heading, ' — ') else '' end, replace(substring(ch.content, 1, 180), chr(10), ' '))
      else replace(substring(trim(p.body, e' \t\n\r'), 1, 200), chr(10), ' ') end as preview, p.body
  from final f join headed p on p.id = f.id
  left join best b on b.k = f.k and b.id = f.id left join chunks ch on ch.id = b.id and ch.chunk_no = b.chunk_no)"""


# Words that never expand a query.
STOP = "'" + (
    "the this that with from have been were they their them will would could should about "
    "there which what when where than then also just more some such only other into over "
    "very after before because between through during without within along these those "
    "page section note info type used using"
).replace(" ", "', '") + "'"
KINDS = "case doc_id % 4 when 0 then 'skill' when 1 then 'case' else {} end"


ORACLES["recall_lexical"] = f"""with {recall_ctes()}
select s.k as query_id, rank1 as rank, split_part(s.id, '|', 2) as id, round(lex, 6) as score, coalesce(chunk_no, -1) as chunk_no
from scored s left join best b on b.k = s.k and b.id = s.id where rank1 <= 25"""
ORACLES["recall_feedback"] = f"""with {recall_ctes()}
select k as query_id, rank, id, title, type, preview, round(score, 6) as score from detail where rank <= 5"""
ORACLES["recall_hybrid"] = f"""with {recall_ctes(cosine=True)}
select k as query_id, rank, id, type, round(score, 6) as score from detail where rank <= 8 and score >= 5"""
ORACLES["semantic_topk"] = """with vecs as (select vec_id, embedding::double[] as v from embeddings),
pairs as (select q.vec_id as query_id, concat('docs/', cast(p.vec_id as varchar)) as id, list_cosine_similarity(q.v, p.v) as cosine from vecs q, vecs p where q.vec_id % 50 = 0)
select query_id, id, round(cosine, 6) as cosine from (
  select *, row_number() over (partition by query_id order by cosine desc, id) as rn from pairs where cosine >= 0.2) where rn <= 5"""

_LAYERED = """layered as (
  select *, row_number() over (partition by k order by layer, rank) as pos from (
    select *, row_number() over (partition by k, id order by layer, rank) as rn from (
      select *, case when vault = 'personal' then 0 else 1 end as layer from detail where rank <= {n}))
  where rn = 1)"""
ORACLES["recall_layered"] = f"""with {recall_ctes(layered=True)}, {_LAYERED.format(n=5)}
select k as query_id, vault, pos as rank, id, title, type, round(score, 6) as score from layered where pos <= 5"""
ORACLES["recall_skill"] = f"""with {recall_ctes(layered=True)}, {_LAYERED.format(n=20)}
select k as query_id, rank2 as rank, id, type, vault, round(score, 6) as score from (
  select *, row_number() over (partition by k order by pos) as rank2 from layered where pos <= 20 and type in ('skill', 'case')) where rank2 <= 5"""
ORACLES["recall_render"] = f"""with {recall_ctes()}
select k as query_id, concat('## Relevant Wiki Knowledge', chr(10), chr(10), '_', cast(count(*) as varchar), ' page(s) matched your query._', chr(10), chr(10),
  string_agg(concat('- **[[', id, ']]** — *', type, '* — ', title, case when preview = '' then '' else concat(chr(10), '  ', substring(preview, 1, 120), case when length(preview) > 120 then '…' else '' end) end, chr(10)), chr(10) order by rank),
  chr(10), 'Use `read` to view full pages. Add new findings via wiki_ensure_page or wiki_retro.', chr(10)) as text
from detail where rank <= 5 group by k"""

FILES = """files as (select concat('notes/', cast(doc_id as varchar)) as id, doc_id, doc_id % 10 as n, lang, source,
  regexp_replace(text, '\r\n?', chr(10), 'g') as text from documents)"""
_GOOD = """concat('{"producer":{"weights":[1,2.5,true],"when":"2026-08-02"}}')"""
ORACLES["frontmatter_parse"] = f"""with {FILES}
select id, case when n = 5 then 'note' else lang end as type, case when n <> 5 then concat('Doc ', cast(doc_id as varchar)) end as title,
  case when n <> 5 then concat(source, ' yes') end as tags, case when n = 5 then '2024-05-01' end as created,
  case when n = 5 then '{{}}' else {_GOOD} end as extensions, case when n = 5 then 'legacy-list' else 'canonical' end as sources_kind,
  case when n = 5 then '["raw one"]' else concat('[{{"id":"S', cast(doc_id as varchar), '"}}]') end as sources,
  case when n = 5 then 'created,sources' else '' end as legacy_fields,
  regexp_replace(text, '^\n', '') as body from files where n in (5, 8, 9)"""
_CODE = """case n when 0 then 'frontmatter_missing' when 1 then 'frontmatter_parse_error' when 2 then 'concept_missing_type'
  when 3 then 'frontmatter_duplicate_key' when 4 then 'frontmatter_alias_forbidden' when 6 then 'frontmatter_custom_tag_forbidden'
  when 7 then 'frontmatter_multiple_documents' end"""
ORACLES["frontmatter_diagnostics"] = f"""with {FILES}
select 'error' as severity, {_CODE} as code, concat(id, '.md') as path from files where n not in (5, 8, 9)"""
ORACLES["diagnostics_by_path"] = f"with {FILES} select {_CODE} as code, count(*) as pages from files where n not in (5, 8, 9) group by 1"
ORACLES["recoverable_codes"] = f"""with {FILES}
select concat(id, '.md') as path, case n when 1 then 'frontmatter_missing,frontmatter_parse_error'
  when 2 then 'concept_missing_type,frontmatter_missing' else 'frontmatter_missing' end as codes from files"""
ORACLES["serialise_documents"] = f"""with {FILES}
select concat(id, '.md') as path, concat(case when n = 5 then concat('---', chr(10), 'type: note', chr(10), 'sources:', chr(10), '  - raw one', chr(10),
    'created: 2024-05-01', chr(10), '---', chr(10))
  else concat('---', chr(10), 'type: ', lang, chr(10), 'title: Doc ', cast(doc_id as varchar), chr(10), 'tags:', chr(10), '  - ', source, chr(10), '  - yes', chr(10),
    'sources:', chr(10), '  - id: S', cast(doc_id as varchar), chr(10), 'producer:', chr(10), '  weights:', chr(10), '    - 1', chr(10), '    - 2.5', chr(10),
    '    - true', chr(10), '  when: 2026-08-02', chr(10), '---', chr(10)) end,
  case when rtrim(text, chr(10)) <> '' then concat(chr(10), rtrim(regexp_replace(text, '^\n', ''), chr(10)), chr(10)) else '' end) as content
from files where n in (5, 8, 9)"""
ORACLES["serialise_documents"] = ORACLES["serialise_documents"].replace(
    """'sources:', chr(10), '  - raw one', chr(10),
    'created: 2024-05-01', chr(10), '---', chr(10))""",
    """'created: 2024-05-01', chr(10), 'sources:', chr(10), '  - raw one', chr(10), '---', chr(10))""",
)
ORACLES["patch_documents"] = f"""with {FILES}
select id, case when n = 5 then '{{"created":"2024-05-01","status":"ingested","title":"NOTE","type":"note"}}'
  else concat('{{"status":"ingested","tags":["', source, '","yes"],"title":"', upper(lang), '","type":"', lang, '"}}') end as frontmatter,
  case when n = 5 then '{{}}' else {_GOOD} end as extensions
from files where n in (5, 8, 9)"""

EVENTS = """ev as (
  select event_id as seq, ts, trim(event_type) as kind, user_id, replace(props, ' ', '') as props,
    case when event_id % 97 = 0 then 'event_invalid_json' when event_id % 101 = 0 then 'event_invalid_timestamp'
      when event_id % 103 = 0 then 'event_missing_kind' end as code from events)"""
ORACLES["event_day_log"] = f"""with {EVENTS}
select strftime(ts, '%Y-%m-%d') as event_date, row_number() over (partition by cast(ts as date) order by epoch_us(ts) // 1000 desc, seq desc) as position,
  concat('- **', replace(kind, '_', '\\_'), '**: {{"props":', props, ',"user_id":', cast(user_id as varchar), '}}') as line
from ev where code is null""".replace("'\\\\_'", "'\\_'")
ORACLES["event_diagnostics"] = f"""with {EVENTS}
select 'warning' as severity, code, 'meta/events.jsonl' as path, concat(case code when 'event_invalid_json' then 'Invalid JSON at line '
  when 'event_invalid_timestamp' then 'Invalid timestamp at line ' else 'Missing kind at line ' end, cast(seq + 1 as varchar)) as message
from ev where code is not null"""
ORACLES["event_activity_log"] = f"""with {EVENTS}
select seq, concat('## [', case when seq % 101 = 0 then 'bad' else strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') end, '] ', case when seq % 103 = 0 then ' ' else kind end) as heading,
  concat('- user_id: ', cast(user_id as varchar), ', props: ', props) as details from ev where seq % 97 <> 0"""
ORACLES["event_digest_daily"] = f"with {EVENTS} select strftime(ts, '%Y-%m-%d') as period_start, kind, count(*) as events from ev where code is null group by 1, 2"
ORACLES["event_digest_weekly"] = f"with {EVENTS} select strftime(date_trunc('week', ts), '%Y-%m-%d') as period_start, kind, count(*) as events from ev where code is null group by 1, 2"
ORACLES["event_requests"] = """select event_id, case when event_id % 9 = 0 then '  ' else event_type end as kind,
  case when event_id % 8 = 0 then replace(props, '"k"', '"timestamp"') else props end as details,
  case when event_id % 9 = 0 then 'event_missing_kind' when event_id % 8 = 0 then 'event_reserved_field' end as error from events"""
ORACLES["reminder_state"] = """with a as (
  select cast(user_id as varchar) as session_id, event_id as seq, ts,
    case when event_type = 'error' and event_id % 40 = 0 then 'session_start' when event_type = 'error' and event_id % 7 = 0 then 'compact'
      when event_type = 'error' then 'retry' when event_type = 'purchase' and event_id % 5 = 0 then 'observe' else 'turn' end as action from events),
g as (select *, sum(case when action in ('session_start', 'compact') then 1 else 0 end) over w as rg,
    sum(case when action = 'session_start' then 1 else 0 end) over w as sg from a
  window w as (partition by session_id order by ts, seq rows unbounded preceding)),
c as (select *, sum(case when action = 'turn' then 1 else 0 end) over (partition by session_id, rg order by ts, seq rows unbounded preceding) as counter,
    max(case when action = 'observe' then 1 else 0 end) over (partition by session_id, sg order by ts, seq rows unbounded preceding) = 1 as observed from g)
select session_id, seq, cast(counter as bigint) as counter, observed, action = 'turn' and counter >= 5 and not observed as emit from c"""

EMBED = DOCS + r""",
emb_text as (
  select id, doc_id, concat('title: ', coalesce(nullif(trim(title), ''), id), chr(10), 'type: ', type, chr(10), 'tags: ', tags, chr(10), 'category: ', category,
    case when trim(body, e' \t\n\r') <> '' then concat(chr(10), chr(10), trim(body, e' \t\n\r')) else '' end) as text from docs),
hashed as (select id, doc_id, text, sha256(text) as hash from emb_text),
store as (
  select case when doc_id % 10 = 9 then concat('old/', id) else id end as id, case when doc_id % 10 = 1 then '0' else hash end as hash,
    case when doc_id % 10 = 2 then 'other' else 'mock' end as model,
    e.embedding[1]::double as first, coalesce(len(e.embedding), 0) as dim
  from hashed left join embeddings e on e.vec_id = doc_id),
stale as (select h.* from hashed h left join store s on s.id = h.id where s.id is null or s.hash <> h.hash or s.model <> 'mock')"""
ORACLES["embedding_text_hash"] = f"with {EMBED} select id, hash from hashed"
ORACLES["embedding_stale"] = f"with {EMBED} select id, hash from stale"
ORACLES["embedding_prune"] = f"with {EMBED} select id from store where id not in (select id from docs)"
ORACLES["embedding_stats"] = f"""with {EMBED}
select (select count(*) from stale) as embedded, (select count(*) from docs) - (select count(*) from stale) as skipped,
  (select count(*) from docs) as total, (select count(*) from store where id not in (select id from docs)) as pruned"""
ORACLES["embed_batches"] = f"with {EMBED} select count(*) as texts, cast(sum(length(text)) as bigint) as chars, 0 as over_count, 0 as over_chars from emb_text"
_COUNT = "(length(text) - length(replace(text, '{0}', '')))::double"
_NORM = "sqrt(" + " + ".join(f"{_COUNT.format(c)} * {_COUNT.format(c)}" for c in "aent") + ")"
ORACLES["embedding_refresh"] = f"""with {EMBED}
select id, hash, 'mock' as model, 4 as dim, '2024-02-01' as updated, round({_COUNT.format('a')} / {_NORM}, 6) as first from stale
union all
select id, hash, model, dim, '2024-01-01', coalesce(round(first, 6), -9.0) from store
where id in (select id from docs) and id not in (select id from stale)"""

_SP = r"[\t\n\v\f\r \x{00A0}]"
_STRIP = "html"
for _tag in ("head", "script", "style", "nav", "header", "footer", "noscript"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?is)<{_tag}.*?</{_tag}>', '', 'g')"
ORACLES["html_noise_strip"] = rf"""select concat('pages/', cast(page_id as varchar)) as id,
  trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) as title, {_STRIP} as stripped from pages"""

def page_markdown(html: str) -> str:
    """Markdown of the given web pages: what follows their navigation, up to the footer.

    Bold text is never closed there, so it ends where the article ends.
    """
    body = rf"regexp_replace(regexp_replace(split_part({html}, '</nav>', 2), '(?s)<footer.*', ''), '(?s)<!--.*?-->', '', 'g')"
    text = rf"regexp_replace(regexp_replace({body}, '\s+', ' ', 'g'), '([\\`*_~\[\]])', '\\\1', 'g')"
    text = rf"regexp_replace(replace(replace({text}, '<h1>', concat(chr(10), '# ')), '<b>', '**'), '<[^<>]*>', chr(10), 'g')"
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{plain}')"
    bold = f"repeat('**', ((length({html}) - length(replace({html}, '<b>', ''))) / 3)::int)"
    return rf"concat(trim(regexp_replace({text}, '\s*\n\s*', concat(chr(10), chr(10)), 'g'), concat(chr(32), chr(10))), {bold})"


ORACLES["html_to_markdown"] = f"select concat('pages/', cast(page_id as varchar)) as id, {page_markdown('html')} as markdown from pages"

_XML = r"regexp_replace(html, '(?i)<!DOCTYPE[^>]*>\s*', '', 'g')"
_XML = rf"regexp_replace({_XML}, '(?i)</(p|div|section|article|li|h\d|tr|blockquote|pre)>', chr(10), 'g')"
_XML = rf"regexp_replace({_XML}, '(?i)<br\s*/?>', chr(10), 'g')"
for _ in range(3):
    _XML = rf"regexp_replace({_XML}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
_XML = f"replace({_XML}, '<', '')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
    _XML = f"regexp_replace({_XML}, '(?i)&{_name};', '{_char}', 'g')"
_XML = rf"trim(regexp_replace({_XML}, '\n{{3,}}', concat(chr(10), chr(10)), 'g'), e' \t\n\r')"
ORACLES["xml_to_markdown"] = rf"""select id, case when t = '' then html when title <> '' then concat('# ', title, chr(10), chr(10), chr(10), t) else t end as markdown
from (select concat('pages/', cast(page_id as varchar)) as id, html, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) as title, {_XML} as t from pages)"""
ORACLES["json_to_markdown"] = r"""select event_id, concat('# ', event_type, chr(10), chr(10), '- **Name:** ', event_type, chr(10), '- **User id:** ', cast(user_id as varchar), chr(10),
  '## Props', chr(10), chr(10), '- **K:** ', regexp_extract(props, '(\d+)', 1), chr(10), chr(10),
  '## Tag List', chr(10), chr(10), '- a', chr(10), '- 2', chr(10), '- null', chr(10), chr(10),
  '## Items', chr(10), chr(10), '### i', chr(10), chr(10), '  - **Id:** i') as markdown from events"""
ORACLES["binary_sniff"] = """select concat('pages/', cast(page_id as varchar)) as id,
  (['zip','pdf','7z','gzip','png','jpeg','gif','bmp','tiff','tiff','riff','exe','macho','macho','macho','macho','class','elf','wasm','sqlite','mp3',null])[(page_id % 22) + 1] as format
from pages"""
_ROUTES = [
    (".pdf", "pdf", "markitdown", "application/pdf"), (".md", "markdown", "passthrough", "text/markdown"),
    (".txt", "text", "passthrough", "text/plain"), (".html", "html", "passthrough", "text/html"),
    (".htm", "html", "passthrough", "text/html"), (".xml", "xml", "xmlToMarkdown", "application/xml"),
    (".json", "json", "jsonToMarkdown", "application/json"),
    (".docx", "docx", "markitdown", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
]


def _route(at: int, default: str) -> str:
    return "case " + " ".join(f"when lower(name) like '%{r[0]}' then '{r[at]}'" for r in _ROUTES) + f" else {default} end"


ORACLES["extractor_route"] = rf"""with r as (
  select concat('pages/', cast(page_id as varchar)) as id,
    concat(regexp_extract(url, '^[^?#]*'), (['.pdf','.MD','.txt','.htm','.Xml','.json','.docx','.csv',''])[(page_id % 9) + 1]) as name from pages)
select id, name, {_route(1, "'file'")} as format, {_route(2, "'passthrough'")} as extractor, {_route(3, "null")} as content_type,
  case when regexp_extract(lower(name), '[^/.](\.[^./]*)$', 1) in ('.html', '.htm', '.md', '.pdf', '.txt', '.xml', '.json')
    then concat('source', regexp_extract(lower(name), '[^/.](\.[^./]*)$', 1)) else 'source.html' end as original from r"""

CAPTURE = r"""raw as (
  select concat('url-', lpad(cast(page_id as varchar), 12, '0')) as capture_order, 'url' as kind, url as name, url as url, page_id as n, html as payload, null as title from pages
  union all select concat('text-', lpad(cast(doc_id as varchar), 12, '0')), 'text', null, null, doc_id, text, case when lang = 'en' then concat('Doc ', cast(doc_id as varchar)) end from documents
  union all select concat('file-', lpad(cast(event_id as varchar), 12, '0')), 'file',
    concat('/data/e', cast(event_id as varchar), (['.json','.bin','.docx','.TXT'])[(event_id % 4) + 1]), null, event_id % 4, props, null from events),
numbered as (select *, row_number() over (order by capture_order) + (select max(doc_id) from labels) as num from raw),
packets as (
  select *, concat('SRC-2024-06-01-', case when num < 1000 then lpad(cast(num as varchar), 3, '0') else cast(num as varchar) end) as id from numbered)"""
_PAGE_TITLE = """coalesce(nullif(regexp_replace(replace(trim(regexp_extract(payload, '(?i)<title[^>]*>([^<]*)</title>', 1)), '&amp;', '&'), '([\\\\`*_~\\[\\]])', '\\\\\\1', 'g'), ''), url)"""
ORACLES["capture_packets"] = f"""with {CAPTURE}
select capture_order, id,
  case kind when 'text' then coalesce(title, 'Pasted text — 2024-06-01') when 'file' then split_part(name, '/', 3)
    else coalesce(nullif(regexp_replace(replace(trim(regexp_extract(payload, '(?i)<title[^>]*>([^<]*)</title>', 1)), '&amp;', '&'), '([\\\\`*_~\\[\\]])', '\\\\\\1', 'g'), ''), url) end as title,
  case kind when 'url' then 'web' when 'text' then 'text' else (['json','file','docx','text'])[n + 1] end as format,
  case kind when 'url' then 'htmlToMarkdown' when 'text' then 'passthrough' else (['jsonToMarkdown','magicBytes','markitdown','passthrough'])[n + 1] end as extractor,
  case when kind = 'file' then (['success','unsupported','failed','success'])[n + 1] else 'success' end as extraction_status,
  case when kind = 'file' then (['application/json',null,'application/vnd.openxmlformats-officedocument.wordprocessingml.document','text/plain'])[n + 1] end as content_type,
  concat('{{"source_id":"', id, '"', case when kind = 'url' then concat(',"url":"', url, '"') else '' end, ',"format":"',
    case kind when 'url' then 'web' when 'text' then 'text' else (['json','file','docx','text'])[n + 1] end, '"}}') as event
from packets"""
ORACLES["packet_pages"] = rf"""with {CAPTURE},
ex as (select *, case when kind = 'text' then payload when kind = 'url' then {page_markdown('payload')} else case n
    when 0 then concat('# JSON Extract', chr(10), chr(10), '- **K:** ', regexp_extract(payload, '(\d+)', 1))
    when 1 then concat('_Binary file could not be converted to markdown (detected format: zip).', chr(10), 'Capture a text-based version or a URL pointing to readable content instead._', chr(10))
    when 2 then concat('_DOCX content could not be converted to markdown from ', name, '. Ensure uvx and markitdown are installed._', chr(10))
    else payload end end as extracted,
  case kind when 'text' then coalesce(title, 'Pasted text — 2024-06-01') when 'file' then split_part(name, '/', 3) else {_PAGE_TITLE} end as ptitle from packets)
select concat('sources/', id) as page_id,
  concat('# ', ptitle, chr(10), case when kind = 'url' then concat('> _Original: [', url, '](', url, ')_', chr(10)) else '' end, chr(10), '## Summary', chr(10), chr(10), '[LLM: Replace with 2-3 paragraph summary of key content]', chr(10), chr(10),
    '> _Auto-preview: ', substring(trim(regexp_replace(regexp_replace(extracted, '[#*_`]', '', 'g'), '\s+', ' ', 'g')), 1, 500), case when length(extracted) > 500 then '...' else '' end, '_', chr(10), chr(10),
    '## Key Takeaways', chr(10), chr(10), '- [LLM: Most important point]', chr(10), '- [LLM: Second important point]', chr(10), '- [LLM: Third important point]', chr(10), chr(10),
    '## Entities Mentioned', chr(10), chr(10), '- [LLM: Add linked entities after review]', chr(10), chr(10), '## Concepts Mentioned', chr(10), chr(10), '- [LLM: Add linked concepts after review]', chr(10), chr(10),
    '## Notable Quotes', chr(10), chr(10), '> [LLM: Important quote] — attribution', chr(10), chr(10), '## Source Packet', chr(10), chr(10),
    '- **ID:** `sources/', id, '`', chr(10), '- **Extracted:** `raw/sources/', id, '/extracted.md`', chr(10), '- **Manifest:** `raw/sources/', id, '/manifest.json`', chr(10)) as page_body,
  concat('{{"id":"', id, '","captured":"2024-06-01","packet_version":"1.0","title":"', replace(ptitle, chr(92), chr(92) || chr(92)), '"', case kind when 'file' then concat(',"file_path":"', name, '"') when 'url' then concat(',"url":"', url, '"') else '' end,
    ',"format":"', case kind when 'text' then 'text' when 'url' then 'web' else (['json','file','docx','text'])[n + 1] end, '","extractor":"',
    case kind when 'text' then 'passthrough' when 'url' then 'htmlToMarkdown' else (['jsonToMarkdown','magicBytes','markitdown','passthrough'])[n + 1] end, '","extraction_status":"',
    case when kind = 'file' then (['success','unsupported','failed','success'])[n + 1] else 'success' end, '"',
    case when kind = 'file' and n <> 1 then concat(',"content_type":"', (['application/json','','application/vnd.openxmlformats-officedocument.wordprocessingml.document','text/plain'])[n + 1], '"') else '' end, '}}') as manifest
from ex"""

PENDING = """pend as (
  select concat('SRC-', lpad(cast(d.doc_id as varchar), 9, '0')) as id from documents d left join labels l on l.doc_id = d.doc_id where coalesce(l.quality, 0) <> 1)"""
ORACLES["pending_ingest"] = f"with {PENDING} select id from pend"
ORACLES["pending_batch"] = f"with {PENDING} select id, (select greatest(count(*) - 9, 0) from pend) as remaining from pend order by id limit 9"

ORACLES["requested_sources"] = """select distinct concat('SRC-', lpad(cast(l.doc_id * 3 as varchar), 9, '0')) as id,
  case when d.doc_id is null then 'not_found' else 'selected' end as status
from labels l left join documents d on d.doc_id = l.doc_id * 3"""

COMMIT = f"""parts as (select *, concat('SRC-', lpad(cast(p_partkey as varchar), 9, '0')) as source_id, case when p_partkey % 3 = 0 then 'de' else 'en' end as lang from part),
mentions as (
  select source_id, lang, 'entity' as kind, 0 as pos, p_brand as title, ' ' as txt from parts
  union all select source_id, lang, 'entity', 1, p_name, p_type from parts
  union all select source_id, lang, 'concept', 0, p_type, p_name from parts),
slugged as (select *, {slug('title')} as slug from mentions),
ids as (select *, concat(case kind when 'entity' then 'entities/' else 'concepts/' end, slug) as id from slugged),
ranked as (select *, row_number() over (partition by id order by source_id, pos) as rn,
  id in (select concat('entities/brand', cast(n_nationkey as varchar)) from nation) as existing from ids),
outcomes as (select source_id, kind, pos, slug, id, case when rn = 1 and not existing then 'created' else 'linked' end as outcome from ranked)"""
ORACLES["commit_new_pages"] = f"""with {COMMIT}
select id, kind as type, title, case when trim(txt) <> '' then trim(txt) when kind = 'concept' then 'One-line definition.' else 'One-line description.' end as description,
  '2024-07-01' as created, '2024-07-01' as updated, concat('[{{"id":"', source_id, '","resource":"/sources/', source_id, '.md"}}]') as sources,
  concat('# ', title, chr(10), chr(10), case when trim(txt) <> '' then trim(txt) when kind = 'concept' then 'One-line definition.' else 'One-line description.' end, chr(10), chr(10),
    '## ', case when kind = 'concept' then 'Definition' when lang = 'de' then 'Übersicht' else 'Overview' end, chr(10), chr(10),
    case when kind = 'concept' then '[Clear explanation]' else '[Key facts]' end, chr(10), chr(10), '## Links', chr(10), chr(10), '- [', source_id, '](/sources/', source_id, '.md)') as body
from ranked where rn = 1 and not existing"""
ORACLES["commit_outcomes"] = f"with {COMMIT} select source_id, kind, pos, slug, id, outcome from outcomes"
ORACLES["commit_stats"] = f"""with {COMMIT}
select p.source_id, count(*) filter (where kind = 'entity' and outcome = 'created') as entities_created, count(*) filter (where kind = 'entity' and outcome = 'linked') as entities_linked,
  count(*) filter (where kind = 'concept' and outcome = 'created') as concepts_created, count(*) filter (where kind = 'concept' and outcome = 'linked') as concepts_linked,
  case when p.p_partkey % 5 = 0 then 2 else 0 end as contradictions
from parts p join outcomes o using (source_id) group by p.source_id, p.p_partkey"""
ORACLES["touched_pages"] = f"with {COMMIT} select id from outcomes union select concat('sources/', source_id) from outcomes"
ORACLES["commit_sources"] = f"""with {COMMIT},
own as (select concat('sources/SRC-', lpad(cast(s_suppkey as varchar), 9, '0')) as id, s_name from supplier),
h as (select p.*, lang = 'de' as de from parts p)
select concat('sources/', source_id) as id, case when own.id is not null then 'patched' else 'created' end as action, coalesce(s_name, p_name) as title,
  'ingested' as status, '2024-07-01' as updated, source_id, 'web' as format, '2024-06-01' as captured,
  concat('# ', p_name, case when p_partkey % 2 = 0 then concat(chr(10), '> _Original: [https://example.com/', cast(p_partkey as varchar), '](https://example.com/', cast(p_partkey as varchar), ')_') else '' end,
    chr(10), chr(10), '## ', case when de then 'Zusammenfassung' else 'Summary' end, chr(10), chr(10), trim(concat('About ', p_name)),
    chr(10), chr(10), '## ', case when de then 'Wichtige Erkenntnisse' else 'Key Takeaways' end, chr(10), chr(10), '- ', trim(p_name), chr(10), '- ', trim(p_type),
    chr(10), chr(10), '## ', case when de then 'Erwähnte Entitäten' else 'Entities Mentioned' end, chr(10), chr(10),
    '- [', p_brand, '](/entities/', {slug('p_brand')}, '.md)', chr(10), '- [', p_name, '](/entities/', {slug('p_name')}, '.md)',
    chr(10), chr(10), '## ', case when de then 'Erwähnte Konzepte' else 'Concepts Mentioned' end, chr(10), chr(10), '- [', p_type, '](/concepts/', {slug('p_type')}, '.md)',
    chr(10), chr(10), '## ', case when de then 'Bemerkenswerte Zitate' else 'Notable Quotes' end, chr(10), chr(10),
    case when p_partkey % 4 = 0 then concat('> ', trim(p_name), ' — ', p_brand) when de then '> [Keine aufgezeichnet]' else '> [None recorded]' end, chr(10),
    case when p_partkey % 5 <> 0 then '' when de then concat(chr(10), '## Widersprüche', chr(10), chr(10), '⚠️ **Widerspruch**: x', chr(10), '⚠️ **Widerspruch**: y', chr(10))
      else concat(chr(10), '## Contradictions', chr(10), chr(10), '⚠️ **Contradiction**: x', chr(10), '⚠️ **Contradiction**: y', chr(10)) end,
    '## ', case when de then 'Quellenpaket' else 'Source Packet' end, chr(10), chr(10), '- **ID:** `sources/', source_id, '`', chr(10),
    '- **', case when de then 'Extrahiert' else 'Extracted' end, ':** `raw/sources/', source_id, '/extracted.md`', chr(10), '- **Manifest:** `raw/sources/', source_id, '/manifest.json`', chr(10)) as body
from h left join own on own.id = concat('sources/', source_id)"""

ENSURE = f"""reqs as (
  select p_partkey as request_id, (['entity','concept','synthesis','analysis','requirement','skill','case','other'])[(p_partkey % 8) + 1] as type, p_name as title,
    (['entities','concepts','syntheses','analyses','requirements','skills','cases','concepts'])[(p_partkey % 8) + 1] as folder,
    case when p_partkey % 16 = 3 then p_brand end as content from part),
rids as (select *, concat(folder, '/', {slug('title')}) as id from reqs),
rr as (select *, row_number() over (partition by id order by request_id) as rn, id in (select concat('entities/brand', cast(n_nationkey as varchar)) from nation) as existing from rids)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _templates() -> str:
    from ..operators.pages import TEMPLATES

    cases = " ".join(f"when {_quoted(t)} then {_quoted(body)}" for t, body in TEMPLATES.items() if t)
    return f"case type {cases} else {_quoted(TEMPLATES[''])} end"


ORACLES["ensure_pages"] = f"""with {ENSURE}
select id, type, title, '2024-07-01' as created, '2024-07-01' as updated, coalesce(content, concat('# ', title, chr(10), chr(10), {_templates()})) as body
from rr where rn = 1 and not existing"""
ORACLES["ensure_outcomes"] = f"with {ENSURE} select request_id, id, rn = 1 and not existing as created from rr"

ORACLES["observations"] = r"""with o as (
  select concat('obs-2024-06-01-turn-', cast(turn as varchar), '-of-', role) as slug,
    concat('2024-06-01T00:00:', lpad(cast(turn as varchar), 6, '0'), '.', lpad(cast(conv_id as varchar), 9, '0')) as observed_at,
    concat('Observation: Turn ', cast(turn as varchar), ' of ', role) as title, (['low','medium','high','critical'])[(conv_id % 4) + 1] as relevance,
    (['📝','🔍','⭐','🔴'])[(conv_id % 4) + 1] as icon, text, role, turn from conversations),
b as (select *, concat('# ', icon, ' ', title, chr(10), chr(10), text, chr(10), chr(10), '*Relevance: ', relevance, '*',
    case when turn = 0 then concat(chr(10), '*Context: start*') else '' end, case when role = 'user' then concat(chr(10), '*Tags:  a  user*') else '' end,
    chr(10), chr(10), '---', chr(10), '*Observed: ', observed_at, '*') as body from o),
r as (select *, row_number() over (partition by slug order by observed_at desc, body desc) as rn, count(*) over (partition by slug) - 1 as replaced from b)
select concat('sources/', slug) as id, 'source' as type, title, slug, 'observation' as status, '2024-06-01' as created, '2024-06-01' as updated, relevance, observed_at,
  case when role = 'user' then 'a,user' end as tags, case when turn = 0 then 'start' end as source_context, body, replaced from r where rn = 1"""
ORACLES["insights"] = r"""select case when doc_id % 6 = 0 then concat('Bad Slug ', cast(doc_id as varchar)) else concat('sources/note-', cast(doc_id as varchar)) end as id,
  source as title, case when lang = 'en' then 'en' end as category,
  case when doc_id % 6 = 0 then text else concat('# ', source, chr(10), chr(10), text, chr(10), chr(10), case when lang = 'en' then '*Category: en*' else '' end,
    chr(10), chr(10), '---', chr(10), '*Captured: 2024-07-01*', chr(10), chr(10), '## Related', chr(10), chr(10), '_Add links to related pages._') end as body,
  case when doc_id % 6 = 0 then concat('Invalid insight slug: Bad Slug ', cast(doc_id as varchar)) end as error from documents"""

STEPS = r"""steps as (
  select concat('chat/', cast(conv_id as varchar)) as session_id, turn, case when role = 'assistant' then 'assistant' else 'user' end as role,
    case when role = 'assistant' then trim(text, e' \t\n\r') else text end as text,
    case when role = 'assistant' then concat('m', cast(turn as varchar)) end as model,
    case when role = 'assistant' then (['read','bash','edit'])[((conv_id + turn) % 3) + 1] end as tool from conversations),
summary as (
  select session_id, trim(coalesce(arg_min(text, turn) filter (where role = 'user' and text <> ''), ''), e' \t\n\r') as prompt, arg_min(model, turn) filter (where model is not null) as model,
    count(*) as step_count, count(tool) as tool_call_count from steps group by session_id),
trj as (
  select *, row_number() over (order by session_id) as num from summary),
manifests as (select *, concat('TRJ-2024-06-01-', case when num < 1000 then lpad(cast(num as varchar), 3, '0') else cast(num as varchar) end) as id from trj)"""
ORACLES["trajectory_steps"] = f"""with {STEPS}
select session_id, turn, role, text, model, case when tool is not null then concat('c', cast(turn as varchar), ':', tool, ':{{}}') else '' end as calls from steps"""
_TITLE = r"case when prompt <> '' then substring(trim(regexp_replace(prompt, '\s+', ' ', 'g')), 1, 60) else concat('Task ', id) end"
ORACLES["trajectory_manifest"] = f"""with {STEPS}
select session_id, id, '2024-06-01' as captured, prompt, {_TITLE} as title, 'trajectory' as format, coalesce(model, 'unknown') as model, 'success' as outcome, step_count, tool_call_count
from manifests"""
ORACLES["tool_usage"] = f"with {STEPS} select session_id, tool as name, count(*) as calls, min(turn) as first_turn, 0 as first_pos from steps where tool is not null group by session_id, tool"
ORACLES["tool_sequence"] = f"""with {STEPS}
select session_id, position, concat(cast(position as varchar), '. `', tool, '`') as line from (
  select session_id, tool, row_number() over (partition by session_id order by turn) as position from steps where tool is not null)"""
ORACLES["undistilled"] = f"""with {STEPS}
select id, {_TITLE} as title from manifests where id not in (select concat('TRJ-2024-06-01-', lpad(cast((doc_id * 3) % 999 as varchar), 3, '0')) from labels)"""

_REST = "id not in (select concat('TRJ-2024-06-01-', lpad(cast((doc_id * 3) % 999 as varchar), 3, '0')) from labels)"
ORACLES["undistilled_batch"] = f"""with {STEPS}, rest as (select id from manifests where {_REST})
select id, (select greatest(count(*) - 5, 0) from rest) as remaining from rest order by id limit 5"""

ORACLES["repair_documents"] = rf"""with raw_files as (
  select concat('notes/', cast(doc_id as varchar), '.md') as path, doc_id, doc_id % 10 as n, text,
    case doc_id % 10 when 0 then text when 1 then concat('---', chr(10), 'type: note', chr(10), text)
      else concat('---', chr(10), 'title: Doc ', cast(doc_id as varchar), chr(10), '---', chr(10), text) end as content
  from documents where doc_id % 10 in (0, 1, 2)),
known as (
  select f.*, case when l.quality = 1 then 'entity' else 'concept' end as type,
    case when l.toxic = 1 then 'Known' else cast(f.doc_id as varchar) end as title from raw_files f left join labels l using (doc_id)),
fixed as (
  select *, case n when 2 then concat('---', chr(10), 'type: "', type, '"', chr(10), substring(content, 5))
    when 0 then concat('---', chr(10), 'type: ', type, chr(10), 'title: ', case when title = 'Known' then 'Known' else concat('"', title, '"') end, chr(10), 'legacy_repair: true', chr(10), '---', chr(10),
      case when rtrim(text, chr(10)) <> '' then concat(chr(10), rtrim(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), chr(10)) else '' end)
    else content end as done from known)
select path, case n when 0 then 'frontmatter_missing' when 1 then 'frontmatter_parse_error' else 'concept_missing_type' end as code,
  case n when 0 then 'rebuilt' when 1 then 'refused' else 'typed' end as status, sha256(content) as before_sha256, done as content from fixed"""
ORACLES["snapshot_diff"] = f"""with {DOCS},
kept as (select d.path, d.body, l.quality from docs d left join labels l using (doc_id) where coalesce(l.toxic, 0) = 0),
aft as (select case when quality = 0 then concat('new/', path) else path end as path, sha256(case when quality = 1 then concat(body, '!') else body end) as h from kept),
bef as (select path, sha256(body) as h from docs)
select coalesce(b.path, a.path) as path, case when b.path is null then 'added' when a.path is null then 'missing' when a.h <> b.h then 'changed' else 'same' end as change
from bef b full join aft a on a.path = b.path"""
ORACLES["ownership_audit"] = """with c as (
  select doc_id % 6 as n, case when doc_id % 6 < 4 then concat((['raw/','meta/','wiki/','outputs/'])[(doc_id % 6) + 1], cast(doc_id as varchar), '.md')
    else (['wiki/a/Index.md','meta/events.jsonl'])[(doc_id % 6) - 3] end as path from documents)
select path, n in (0, 1, 4, 5) as protected, case n when 0 then 'Raw sources are immutable. Use wiki_capture_source to add sources.'
  when 1 then 'Metadata is auto-generated. Use wiki_rebuild_meta or wiki_log_event instead.' when 4 then 'Generated index or log page.'
  when 5 then 'Event history is append-only authoritative state. Use wiki_log_event or an owning wiki operation instead.' end as reason from c"""
ORACLES["requirement_counts"] = """select lower(p_type) as status, concat('p', cast(p_size % 4 as varchar)) as priority, count(*) as requirements from part group by 1, 2"""

ORACLES["embed_batch_numbers"] = f"""with recursive {EMBED},
ordered as (select row_number() over (order by id) as n, id, length(text) as size from emb_text),
run as (
  select n, id, 0 as batch, 1 as held, size as chars from ordered where n = 1
  union all
  select o.n, o.id, case when held >= 96 or chars + size > 45000 then batch + 1 else batch end,
    case when held >= 96 or chars + size > 45000 then 1 else held + 1 end, case when held >= 96 or chars + size > 45000 then size else chars + size end
  from run r join ordered o on o.n = r.n + 1)
select id, batch from run"""
_REQUIREMENTS = """req as (
  select p_partkey as k, concat('req/', p_partkey) as id, case when p_partkey % 13 <> 0 then concat('p', p_partkey % 5) end as priority,
    (['draft', 'clarified', 'active', 'implemented', 'deferred', 'rejected', 'done'])[p_partkey % 7 + 1] as status from part)"""
ORACLES["requirement_faults"] = f"""with {_REQUIREMENTS}
select id, 'status' as field, status as value from req where status = 'done'
union all select id, 'priority', priority from req where priority is null or priority = 'p4'"""
ORACLES["requirement_levels"] = f"""with recursive {_REQUIREMENTS},
need as (
  select k, k + 1 as n from req where k % 7 <> 0 union select k, k + 5 from req where k % 7 = 1 union select k, k - 6 from req where k % 35 = 7),
arrow as (select need.k, n from need join req on req.k = n),
reach as (select k, n from arrow union select r.k, a.n from reach r join arrow a on a.k = r.n),
ring as (select distinct k from reach where k = n),
bad as (select k from ring union select k from reach where n in (select k from ring)),
level as (
  select k, 0 as level from req where k not in (select k from arrow)
  union select a.k, level + 1 from level l join arrow a on a.n = l.k where a.k not in (select k from bad))
select id, l.level::bigint as level,
  ((k % 11 = 0)::int + (k % 7 <> 0 and k + 1 not in (select k from req))::int + (k % 7 = 1 and k + 5 not in (select k from req))::int)::bigint as missing,
  l.level is null as cyclic
from req left join (select k, max(level) as level from level group by k) l using (k)"""

_PAGE_LINE = f"""concat('- [', {_ESC.format("coalesce(nullif(trim(title), ''), cast(doc_id as varchar))")}, '](', cast(doc_id as varchar), '.md)')"""
ORACLES["directory_index_lines"] = f"""with {DOCS}
select '' as dir, 0 as section, '' as name, concat('---', chr(10), 'okf_version: "0.2"', chr(10), '---', chr(10), chr(10), '# Corpus') as line
union all select '', 1, '', concat(chr(10), '## Directories', chr(10))
union all select '', 1, 'docs', '- [docs/](docs/)'
union all select 'docs', 0, '', '# docs'
union all select 'docs', 2, '', concat(chr(10), '## Concepts', chr(10))
union all select 'docs', 2, cast(doc_id as varchar), {_PAGE_LINE} from docs"""
ORACLES["index_lines"] = f"""with {DOCS}
select concat('- [[', id, ']] — ', coalesce(nullif(trim(title), ''), split_part(id, '/', 2)), ' *(created: unknown)*') as value from docs
union all select distinct concat('## ', upper(substring(type, 1, 1)), substring(type, 2), 's', chr(10)) from docs
union all select '' from (select distinct type from docs)
union all select concat('# Wiki Index', chr(10), chr(10), '> Auto-generated from meta/registry.json. Do not edit manually.', chr(10))
union all select concat('---', chr(10), '*Last updated: 2024-07-01* | *Total pages: ', cast(count(*) as varchar), '*') from docs"""
ORACLES["lint_report"] = f"""with {MARKED_LINKS}
select 0 as part, concat('# Wiki Lint Report', chr(10), 'Generated: 2024-07-01', chr(10), '## Summary', chr(10), '- Total pages: ', cast((select count(*) from linked) as varchar), chr(10),
  '- Orphans: ', cast((select count(*) from inbound where n = 0) as varchar), chr(10), '- Missing pages: ', cast((select count(*) from unres) as varchar), chr(10),
  '- Contradictions: ', cast((select count(*) from linked where contains(body, '⚠️ **Contradiction')) as varchar), chr(10), '## Findings') as line
union all select 1, concat('- Missing page: ', dst, ' (in ', src, ')') from unres
union all select 2, concat('- Orphan: ', id, ' has no inbound links') from inbound where n = 0
union all select 2, concat('- Contradiction flagged in ', id) from linked where contains(body, '⚠️ **Contradiction')"""
ORACLES["create_documents"] = r"""select concat('notes/', cast(doc_id as varchar), '.md') as path,
  case when lang <> 'fr' then concat('{"title":"', source, '","type":"note"}') end as frontmatter,
  case when lang <> 'fr' then concat('{"own":{"n":', cast(doc_id as varchar), '}}') end as extensions,
  case when lang <> 'fr' then rtrim(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) else concat(text, chr(13), chr(10), chr(10)) end as body,
  case when lang = 'fr' then 'Pass canonical sources in their own column' end as error from documents"""
ORACLES["query_vectors"] = """with v as (select doc_id, length(source)::double as a, (length(source) - length(replace(source, '1', '')))::double as b from documents)
select doc_id as query_id, round(a / sqrt(a * a + b * b + 1), 6) as first, round(b / sqrt(a * a + b * b + 1), 6) as second from v"""

_SINGLE = """bq as (select 1 as query_id, concat(lang, ' ', source, ' the tion') as query from (
  select lang, count(*) as n, min(source) as source from documents group by lang order by n desc, lang desc limit 1))"""
ORACLES["recall_single"] = f"""with {recall_ctes().replace(BENCH, _SINGLE)}
select k as query_id, rank, id, title, type, preview, round(score, 6) as score from detail where rank <= 10"""

_CUT = "'…(truncated — `read` the path above for the full page)'"
ORACLES["recall_render_links"] = f"""with {recall_ctes(layered=True)}, {_LAYERED.format(n=3)},
shown as (select *, trim(regexp_replace(preview, '\\s+', ' ', 'g')) as snip, trim(body, e' \\t\\n\\r') as b, type in ('skill', 'case') as skill from layered where pos <= 3),
lines as (
  select k, pos, vault, skill, concat(cast(pos as varchar), '. **[[', id, ']]** — *', type, '* — score ', printf('%.1f', score),
    case when vault = 'personal' then ' 📓 personal' else '' end, ' — ', title,
    case when snip = '' then '' else concat(' — ', substring(snip, 1, 80), case when length(snip) > 80 then '…' else '' end) end,
    chr(10), '   ↳ `read ', vault, '/', id, '.md`',
    case when skill and b <> '' then concat(chr(10), chr(10), '   ```', chr(10), '   ',
      replace(case when length(b) > 200 then concat(substring(b, 1, 200), chr(10), {_CUT}) else b end, chr(10), concat(chr(10), '   ')), chr(10), '   ```') else '' end) as line from shown)
select k as query_id, concat('## Relevant Wiki Knowledge (links-first)', chr(10),
  case when bool_or(skill) then concat(chr(10), '⚠️ A distilled skill/case below matches this task — read and APPLY it BEFORE experimenting on your own.', chr(10)) else '' end,
  chr(10), '_', cast(count(*) as varchar), ' page(s) matched your query', case when bool_or(vault = 'personal') then ' (personal + project)' else '' end,
  ', ranked. Two-stage recall: links only — open the ones you need to read their full content._', chr(10), chr(10),
  string_agg(line, chr(10) order by pos), chr(10), chr(10),
  'Call `read` on the exact path shown under each link to pull its full content. Add new findings via wiki_ensure_page or wiki_retro.', chr(10)) as text
from lines group by k"""
