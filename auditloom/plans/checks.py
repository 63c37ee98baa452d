"""The queries again as plain SQL for DuckDB, written apart from the Spark expressions.

Where Spark uses windows and running maxima, these use joins on token ranges; where Spark walks VARIANT
values, these use json_tree. They are checks for small inputs, not meant to scale.
"""

from auditloom.operators.jobs import BLOCKED, UNREACHED
from auditloom.plans import fixtures as X
from auditloom.schemas import MESSAGES, ROBOTS_POINTS, SCHEMA_TYPE_POINTS, UNREACHABLE_REASONS

CHECKS: dict[str, str] = {}
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
REST = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*>"""
TOKEN = (
    rf"(?is)<!--.*?-->|<script(?:>|[\s/]{REST}).*?</script\s*>|<style(?:>|[\s/]{REST}).*?</style\s*>"
    rf"|</?[a-z]{REST}|<[a-z/!?][^>]*>?|[^<]+"
)
HEADS = "('h1','h2','h3','h4','h5','h6')"
VOIDS = "('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr')"
DROP_TAGS = "('script','style','nav','footer','header','link','noscript','g','menu','button','svg','canvas')"
DROP_CLASSES = "['ad','ads','advertisements','banner','promo','sponsored']"
BLOCKS = (
    "('h1','h2','h3','h4','h5','h6','address','article','aside','blockquote','body','center','dd','details',"
    "'dialog','dir','div','dl','dt','fieldset','figcaption','figure','footer','form','header','hgroup','hr',"
    "'html','li','main','menu','nav','ol','p','pre','section','summary','table','tbody','td','tfoot','th',"
    "'thead','tr','ul')"
)


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def decode(x: str) -> str:
    """The entities that occur in the given tables; the ampersand last."""
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({code}))"
    return x


def attr(name: str, raw: str = "raw") -> str:
    value = r"""(?:"[^"]*"|''[^'']*''|[^\s>]*)"""
    pattern = rf"(?is)^<[^\s/>]+(?:[\s/]+[^\s=/>]+(?:\s*=\s*{value})?)*?[\s/]+{name}(?:\s*=\s*({value}))?[\s/>]"
    found = f"regexp_extract({raw}, '{pattern}', 1)"
    bare = rf"""regexp_replace({found}, '^["''](.*)["'']$', '\1', 's')"""
    return f"case when regexp_matches({raw}, '{pattern}') then {decode(bare)} end"


def half_even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INT)"


RAW = "pages_in as materialized (select page_id, url, html from pages)"
ENRICHED = f"pages_in as materialized ({X.sql_for_duckdb(X.ENRICHED_PAGES)})"
CAPTURES = f"pages_in as materialized ({X.sql_for_duckdb(X.SITE_CAPTURES)})"
TOKENS = rf"""
tok0 as (select page_id, url, unnest(regexp_extract_all(html, '{TOKEN}')) raw,
  generate_subscripts(regexp_extract_all(html, '{TOKEN}'), 1) - 1 pos from pages_in),
tok1 as (select *, lower(regexp_extract(raw, '^</?([A-Za-z][^\s/>]*)', 1)) t from tok0),
tok as materialized (select page_id, url, CAST(pos AS INT) pos, raw,
  case when t = '' and raw[1] = '<' then 'other' when t = '' then 'text' when raw[2] = '/' then 'close'
   when t in ('script','style') then 'raw' when t in {VOIDS} then 'void' else 'open' end kind,
  t tag from tok1)
"""
TREE = f"""
bal as (select *, sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over (partition by page_id, tag order by pos) b from tok),
pagelen as (select page_id, max(pos) last_pos from tok group by 1),
pair as (select o.page_id, o.tag, o.pos, min(c.pos) close_pos from bal o left join bal c on c.page_id=o.page_id and c.tag=o.tag and c.kind='close' and c.b=o.b-1 and c.pos>o.pos where o.kind='open' group by all),
lev as (select page_id, pos s, close_pos e from pair where close_pos is not null and tag<>'p'),
par as materialized (select t.page_id, t.pos, count(l.s) depth, max(l.s) parent_pos, min(l.e) parent_end from tok t left join lev l on l.page_id=t.page_id and l.s<t.pos and l.e>t.pos group by all),
blk as (select page_id, pos from tok where tag in {BLOCKS} and kind in ('open','close','void')),
brk as (select p.page_id, p.pos, min(b.pos) brk_at from pair p join blk b on b.page_id=p.page_id and b.pos>p.pos where p.tag='p' or (p.close_pos is null and p.tag in {HEADS}) group by all),
span as materialized (select p.page_id, p.tag, p.pos start_pos,
  CAST(case when p.tag='p' then coalesce(brk.brk_at-1, last_pos) when close_pos is not null then close_pos
   when p.tag in {HEADS} then coalesce(least(brk.brk_at, parent_end)-1, last_pos) else coalesce(parent_end-1, last_pos) end AS INT) end_pos,
  CAST(depth AS INT) depth, parent_pos, coalesce(parent_end, last_pos+1) parent_end
  from pair p join par using (page_id, pos) join pagelen using (page_id) left join brk using (page_id, pos)),
cont as (select page_id, coalesce(min(case when tag='main' then start_pos end), min(case when tag='body' then start_pos end)) c0 from span group by 1),
box as materialized (select cont.page_id, c0, span.end_pos c1 from cont join span on span.page_id=cont.page_id and span.start_pos=cont.c0),
gone as materialized (select t.page_id, t.pos s, coalesce(span.end_pos, t.pos) e from tok t join box using (page_id) left join span on span.page_id=t.page_id and span.start_pos=t.pos
  where t.pos>c0 and t.kind in ('open','void','raw') and (t.tag in {DROP_TAGS} or list_has_any({words(attr('class', 't.raw'))}, {DROP_CLASSES}))),
kept as materialized (select t.* from tok t where t.kind<>'other' and not exists (select 1 from gone g join box using (page_id) where g.page_id=t.page_id and t.pos between g.s and g.e and t.pos<=c1)),
txt as materialized (select page_id, pos, {decode('raw')} txt, {strip(decode('raw'))} s from kept where kind='text')
"""
EXTRACT = rf"""
ids as (select * exclude (html) from pages_in),
title as (select k.page_id, max(x.txt) title from (select page_id, min(pos) pos from kept where tag='title' and kind='open' group by 1) k
  join span on span.page_id=k.page_id and span.start_pos=k.pos join txt x on x.page_id=k.page_id and x.pos=k.pos+1 where span.end_pos-k.pos=2 group by 1),
meta as (select page_id, {attr('name')} n, first({attr('content')} order by pos) v from kept where tag='meta' group by page_id, n),
canon as (select page_id, first({attr('href')} order by pos) v from kept where tag='link' and list_contains({words(attr('rel'))}, 'canonical') group by 1),
head as materialized (select page_id, start_pos, end_pos, span.tag, parent_pos, parent_end, row_number() over (partition by page_id order by start_pos)-1 pos from span
  where span.tag in {HEADS} and exists (select 1 from kept k where k.page_id=span.page_id and k.pos=span.start_pos)),
headings as (select h.page_id, CAST(h.pos AS INT) pos, h.tag, coalesce({strip("string_agg(x.txt, '' order by x.pos)")}, '') txt,
  coalesce(string_agg(x.s, ' ' order by x.pos) filter (x.s<>''), '') joined
  from head h left join txt x on x.page_id=h.page_id and x.pos>h.start_pos and x.pos<=h.end_pos group by h.page_id, h.pos, h.tag),
stops as (select h.page_id, h.pos, h.end_pos, coalesce(min(n.start_pos), h.parent_end) stop from head h
  left join head n on n.page_id=h.page_id and n.start_pos>h.start_pos and n.parent_pos is not distinct from h.parent_pos group by h.page_id, h.pos, h.end_pos, h.parent_end),
sections as materialized (select s.page_id, CAST(s.pos AS INT) pos, hd.joined heading, coalesce(string_agg(x.s, ' ' order by x.pos) filter (x.s<>''), '') content
  from stops s join headings hd on hd.page_id=s.page_id and hd.pos=s.pos left join txt x on x.page_id=s.page_id and x.pos>s.end_pos and x.pos<s.stop group by s.page_id, s.pos, hd.joined),
body as (select box.page_id, coalesce(string_agg(x.s, ' ' order by x.pos) filter (x.s<>''), '') body_text_content from box left join txt x on x.page_id=box.page_id and x.pos>c0 and x.pos<=c1 group by 1),
imgs as (select page_id, count(*) n from kept where tag='img' and coalesce({strip(attr('alt'))}, '')='' group by 1),
jblock as materialized (select page_id, txt, CAST(row_number() over (partition by page_id order by pos)-1 AS INT) block from
  (select page_id, pos, regexp_replace(regexp_replace(raw, '(?i)^<script[^>]*>', ''), '(?i)</script\s*>$', '') txt from kept where tag='script' and {attr('type')}='application/ld+json') q where json_valid(txt)),
jtree as materialized (select page_id, block, t.key, t.value, t.type, t.id, t.parent, t.fullkey from jblock, json_tree(jblock.txt) t)
"""


def resolve_ctes(source: str) -> str:
    """`res`: page_id, n, url and the absolute link, from `source` with page_id, n, url and href."""
    parts = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

    def part(x, i):
        return f"regexp_extract({x}, '{parts}', {i})"

    step = (
        "case when s='..' then regexp_replace(a, '(^|/)[^/]*$', '') when s='.' then a else concat(a, '/', s) end"
    )
    return rf"""
u0 as (select page_id, n, url, regexp_replace(href, '^[\x00-\x20]+', '') h from ({source}) q),
u1 as (select *, lower(regexp_extract(h, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) hs, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) bs,
  {part('h', 1)} ha, {part('h', 2)} hp, {part('h', 3)} hq, {part('h', 4)} hf, {part('url', 1)} ba, {part('url', 2)} bp, {part('url', 3)} bq from u0),
u2 as (select *, case when hp[1]='/' then hp else concat(case when bp='' then '/' else regexp_replace(bp, '[^/]*$', '') end, hp) end m from u1),
u3 as (select *, string_split(case when hp[1]='/' then m[2:] else regexp_replace(m, '/+', '/', 'g')[2:] end, '/') segs from u2),
u4 as (select *, list_reduce(segs, lambda a, s: {step}, '') walked, segs[-1] tail from u3),
res as materialized (select page_id, n, url, case when h='' then url when hs<>'' and hs<>bs then h
  when length(ha)>2 then concat(bs, ':', ha, hp, hq, hf)
  when hp='' then concat(bs, ':', ba, bp, case when hq<>'' then hq else bq end, hf)
  else concat(bs, ':', ba, case when tail in ('.','..') then concat(walked, '/') when walked='' then '/' else walked end, hq, hf) end link from u4),
norm0 as (select *, lower(regexp_extract(link, '^(https?)://', 1, 'i')) sc, lower(regexp_extract(link, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#@:]+)', 1)) ho,
  lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#@:]+)', 1)) home, {part('link', 2)} pa from res),
norm as materialized (select page_id, n, case when sc<>'' and ho=home then rtrim(lower(concat(sc, '://', ho, pa)), '/') end target from norm0)
"""


KEPT_LINKS = resolve_ctes(f"select page_id, pos n, url, {attr('href')} href from kept where tag='a' and kind<>'close' and {attr('href')} is not null")
ALL_LINKS = resolve_ctes(f"select page_id, pos n, url, {attr('href')} href from tok where tag='a' and kind='open' and {attr('href')} is not null")

FAQ = """
fnode as (select t.page_id, t.block, t.id, json_extract(t.value, '$.mainEntity') me from jtree t where t.type='OBJECT'
  and (json_extract_string(t.value, '$."@type"')='FAQPage' or (json_type(t.value, '$."@type"')='ARRAY' and list_contains(CAST(json_extract_string(t.value, '$."@type"[*]') AS VARCHAR[]), 'FAQPage')))),
fitem as (select page_id, block, id, unnest(CAST(json_extract(me, '$[*]') AS JSON[])) it, generate_subscripts(CAST(json_extract(me, '$[*]') AS JSON[]), 1) i from fnode),
faq as materialized (select page_id, block, CAST(row_number() over (partition by page_id, block order by id, i)-1 AS INT) bpos, CAST(row_number() over (partition by page_id order by block, id, i)-1 AS INT) pos,
  it->>'name' question, concat_ws(' ', nullif(it->'acceptedAnswer'->>'text',''), nullif(it->>'text','')) answer from fitem
  -- an answer object counts even where its text is empty
  where coalesce(it->>'name','')<>'' and (json_type(it, '$.acceptedAnswer')='OBJECT' or coalesce(it->>'text','')<>''))
"""

PARSED = f"""
typed as (select page_id, json_extract_string(value, '$') v from jtree where key='@type' and type='VARCHAR'
  union all select a.page_id, json_extract_string(e.value, '$') from jtree a join jtree e on e.page_id=a.page_id and e.block=a.block and e.parent=a.id where a.key='@type' and a.type='ARRAY'),
types as (select page_id, string_agg(distinct v, '|' order by v) schema_types, list(distinct v) names from typed group by 1),
lnk as (select page_id, count(*) n, string_agg(target, '|' order by n) internal_links from norm where target is not null group by 1),
parsed as materialized (select i.*, len({words('body_text_content')}) word_count, exists (select 1 from jblock j where j.page_id=i.page_id) has_schema,
  CAST(coalesce(imgs.n, 0) AS INT) images_without_alt, nullif(title.title, '') title, d.v meta_description, r.v meta_robots, c.v canonical_url, body_text_content,
  coalesce(hh.hs, '') headings, coalesce(hh.n, 0) n_heads, coalesce(hh.n1, 0) n_h1, coalesce(hh.n2, 0) n_h2, coalesce(hh.w, 0) head_words,
  coalesce(lnk.internal_links, '') internal_links, coalesce(lnk.n, 0) n_links, coalesce(jb.texts, '') json_ld_schema,
  coalesce(types.schema_types, '') schema_types, coalesce(types.names, []) type_names, coalesce(fq.items, '') faq_items, coalesce(fq.n, 0) n_faq, coalesce(fq.w, 0) faq_words, coalesce(sec.items, '') sections
 from ids i left join body using (page_id) left join imgs using (page_id) left join title using (page_id) left join meta d on d.page_id=i.page_id and d.n='description' left join meta r on r.page_id=i.page_id and r.n='robots'
 left join canon c on c.page_id=i.page_id left join (select page_id, count(*) n, count(*) filter (tag='h1') n1, count(*) filter (tag='h2') n2, sum(len({words('txt')})) w, string_agg(concat(tag, '=', txt), '|' order by pos) hs from headings group by 1) hh on hh.page_id=i.page_id
 left join lnk on lnk.page_id=i.page_id left join (select page_id, string_agg(txt, '|' order by block) texts from jblock group by 1) jb on jb.page_id=i.page_id left join types on types.page_id=i.page_id
 left join (select page_id, count(*) n, sum(len({words('answer')})) w, string_agg(concat(question, '=', answer), '|' order by pos) items from faq group by 1) fq on fq.page_id=i.page_id
 left join (select page_id, string_agg(concat(heading, '=', content), '|' order by pos) items from sections group by 1) sec on sec.page_id=i.page_id)
"""


def with_ctes(*ctes: str) -> str:
    return "with recursive " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n"


TREE_OF = [ENRICHED, TOKENS, TREE]
ALL = [ENRICHED, TOKENS, TREE, EXTRACT, KEPT_LINKS, FAQ, PARSED]
SITE = [CAPTURES, TOKENS, TREE, EXTRACT, KEPT_LINKS, FAQ, PARSED]


def check(name: str, sql: str) -> None:
    CHECKS[name] = sql


check("page_scan_json", "select case when page_id%10 not in (3,7) then page_id end page_id, case when page_id%10 not in (3,7) then url end url, case when page_id%10 not in (3,7) then CAST(length(html) AS INT) end n_chars, case page_id%10 when 3 then CAST(page_id AS VARCHAR) when 7 then concat('x', page_id) end rescued_id from pages")
check("page_scan", "select page_id, url, length(html) n_chars from pages")
check("fetch_ok_filter", with_ctes(ENRICHED) + "select page_id, status_code from pages_in where status_code=200")
check("html_tokens", with_ctes(RAW, TOKENS) + "select page_id, pos, kind, case when kind='other' then '' else tag end tag, length(raw) n_chars from tok")
check("element_spans", with_ctes(*TREE_OF) + "select page_id, tag, start_pos, end_pos, depth from span")
check("pruned_tokens", with_ctes(*TREE_OF) + "select page_id, pos, kind, tag from kept")
for _name in ("word_count", "images_without_alt", "has_schema", "schema_types", "meta_description", "meta_robots", "canonical_url"):
    check(_name, with_ctes(*ALL) + f"select page_id, {_name} from parsed")
check("page_title", with_ctes(*ALL) + "select page_id, title from parsed")
check("body_text", with_ctes(*ALL) + "select page_id, body_text_content from parsed")
check("headings", with_ctes(*TREE_OF, EXTRACT) + "select page_id, pos, tag, txt as text from headings")
check("sections", with_ctes(*TREE_OF, EXTRACT) + "select page_id, pos, heading, content from sections")
check("internal_links", with_ctes(*TREE_OF, KEPT_LINKS) + "select page_id, CAST(row_number() over (partition by page_id order by n)-1 AS INT) pos, target link from norm where target is not null")
check("crawl_links", with_ctes(RAW, TOKENS, ALL_LINKS) + "select page_id, n pos, target from norm where target is not null")
check("jsonld_blocks", with_ctes(*TREE_OF, EXTRACT) + "select page_id, block, txt as text from jblock")
check(
    "jsonld_walk",
    with_ctes(*TREE_OF, EXTRACT)
    + ", up as (select page_id, block, id, 0 depth from jtree where parent is null union all select c.page_id, c.block, c.id, up.depth+1 from up join jtree c on c.page_id=up.page_id and c.block=up.block and c.parent=up.id)"
    + " select page_id, block, depth, replace(fullkey, '\"', '') path, case when fullkey like '%]' then null else key end as key, case when type='VARCHAR' then json_extract_string(value, '$') end string_value from jtree join up using (page_id, block, id) where depth>0",
)
check("faq_build", with_ctes(*TREE_OF, EXTRACT, FAQ) + "select page_id, block, bpos pos, question, answer from faq")
check("faq_items", with_ctes(*TREE_OF, EXTRACT, FAQ) + "select page_id, pos, question, answer from faq")
check(
    "parse_page",
    with_ctes(*ALL)
    + "select page_id, url, status_code, word_count, has_schema, images_without_alt, title, meta_description, meta_robots, canonical_url, body_text_content, headings, internal_links, json_ld_schema, schema_types, faq_items, sections from parsed",
)
_SHAPES = ", ".join(f"{{'n': {i}, 'href': '{h}'}}" for i, h in enumerate(X.LINK_SHAPES))
_CASES = resolve_ctes(f"select page_id, u.n, url, u.href from (select page_id, url, unnest([{_SHAPES}]) u from pages) z")
check("url_resolve", with_ctes(_CASES) + "select page_id, n case_id, link resolved from res")
check("url_same_host", with_ctes(_CASES) + "select page_id, n case_id, coalesce(sc<>'' and ho=home, false) same_host from norm0")
check("url_normalize", with_ctes(_CASES) + "select page_id, n case_id, target link from norm")


# rules: score, findings and recommendations as CASE ladders

def ladder(rows: list[tuple[str, str, str, str]]) -> tuple[str, str, str]:
    parts = [" ".join(f"when {r[0]} then {r[i]}" for r in rows) for i in (1, 2, 3)]
    return tuple(f"case {p} end" for p in parts)


def lit(x: str) -> str:
    return f"'{x}'"


def length_rules(col: str, low: int, high: int, name: str):
    n = f"len({words(col)})"
    return ladder([
        (f"coalesce({col},'')=''", "0", lit(f"{name}.missing|{name}.empty"), lit(f"{name}.add|{name}.matters")),
        (f"{n}<{low}", half_even(f"CAST({n} AS DOUBLE)/{low}*30"), lit(f"{name}.short"), lit(f"{name}.lengthen|{name}.describe")),
        (f"{n}<={high}", "30", lit(f"{name}.good"), "''"),
        ("true", f"greatest(30-2*({n}-{high}),10)", lit(f"{name}.long"), lit(f"{name}.shorten")),
    ])


def points(table: dict) -> str:
    return "case x " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " else 0 end"


ROBOT_SUM = f"greatest(0, least(20, 12 + list_sum([{points(ROBOTS_POINTS)} for x in [lower({strip('y')}) for y in string_split(coalesce(meta_robots,''), ',')]])))"
TYPE_SUM = f"CAST(least(30, coalesce(list_sum([{points(SCHEMA_TYPE_POINTS)} for x in type_names]), 0)) AS INT)"
RATIO = f"(CAST(len(list_distinct({words('body_text_content')})) AS DOUBLE) / greatest(len({words('body_text_content')}),1))"
HEAD_MEAN = "(CAST(head_words AS DOUBLE) / greatest(n_heads,1))"
FAQ_MEAN = "(CAST(faq_words AS DOUBLE) / greatest(n_faq,1))"


def join_ladders(*ladders) -> tuple[str, str, str]:
    score = " + ".join(x[0] for x in ladders)
    texts = ["concat_ws('|', " + ", ".join(f"nullif({x[i]},'')" for x in ladders) + ")" for i in (1, 2)]
    return (score, *texts)


_H = join_ladders(
    ladder([("n_h1=1", "10", lit("h1.single"), "''"), ("n_h1>1", "5", lit("h1.several"), lit("h1.keep_one")), ("true", "0", lit("h1.missing"), lit("h1.add"))]),
    ladder([("n_heads>=3", "10", lit("headings.enough"), "''"), ("n_heads>0", "5", lit("headings.few"), lit("headings.add_more")), ("true", "0", lit("headings.none"), lit("headings.add"))]),
    ladder([("n_h1>0 and n_h2>0", "10", lit("hierarchy.good"), "''"), ("n_h1>0", "5", lit("hierarchy.no_h2"), lit("hierarchy.add_h2")), ("true", "0", lit("hierarchy.none"), lit("hierarchy.add"))]),
    ladder([(f"{HEAD_MEAN} between 5 and 10", "10", lit("heading_words.good"), "''"), (f"{HEAD_MEAN}>=1 and {HEAD_MEAN}<5", "5", lit("heading_words.brief"), lit("heading_words.lengthen")), ("true", "0", lit("heading_words.off"), lit("heading_words.fix"))]),
)
_Q = join_ladders(
    ladder([("n_faq=0", "0", "''", "''"), ("n_faq<=5", half_even("n_faq/5.0::DOUBLE*20") + "+10", lit("faq.limited"), lit("faq.add_more")), ("n_faq<=10", "30", lit("faq.good"), "''"), ("true", "10+greatest(20-2*(n_faq-10),7)", lit("faq.many"), lit("faq.reduce"))]),
    ladder([("n_faq=0", "0", lit("faq.none"), lit("faq.add")), (f"{FAQ_MEAN}<10", "0", lit("faq_answers.brief"), lit("faq_answers.expand")), (f"{FAQ_MEAN}<=50", half_even(f"{FAQ_MEAN}/50*20"), lit("faq_answers.good"), "''"), ("true", "10", lit("faq_answers.long"), lit("faq_answers.shorten"))]),
)
IMG = "images_without_alt"
IMG_TEXT = f"concat('images.missing:', {IMG})"
RULES = {
    "title": length_rules("title", 5, 15, "title"),
    "meta_description": length_rules("meta_description", 15, 20, "description"),
    "canonical_url": ladder([("coalesce(canonical_url,'')=''", "0", lit("canonical.missing"), lit("canonical.add")), ("true", "20", lit("canonical.present"), "''")]),
    "meta_robots": ladder([
        (f"{ROBOT_SUM}=0", "0", lit("robots.blocked"), lit("robots.unblock")), (f"{ROBOT_SUM}<12", ROBOT_SUM, lit("robots.restricted"), lit("robots.review")),
        (f"{ROBOT_SUM}=12", "12", lit("robots.default"), lit("robots.state")), (f"{ROBOT_SUM}<20", ROBOT_SUM, lit("robots.mostly_open"), "''"), ("true", "20", lit("robots.open"), "''")]),
    "word_count": ladder([
        ("word_count<800", half_even("CAST(word_count AS DOUBLE)/800*20"), lit("length.short"), lit("length.lengthen|length.detail")),
        ("word_count<=2500", "20", lit("length.good"), "''"), ("true", "greatest(20-2*(word_count-2500),7)", lit("length.long"), lit("length.focus|length.spam"))]),
    "headings": _H,
    "body_text_content": ladder([
        ("coalesce(body_text_content,'')=''", "0", lit("body.empty"), lit("body.write|body.matters")), (f"{RATIO}>0.7::DOUBLE", "40", lit("body.diverse"), "''"),
        (f"{RATIO}>=0.4::DOUBLE", half_even(f"40*{RATIO}"), lit("body.moderate"), lit("body.vary")), ("true", half_even(f"40*{RATIO}"), lit("body.repetitive"), lit("body.rewrite|body.no_stuffing"))]),
    "has_schema": ladder([("has_schema", "20", lit("schema.present"), "''"), ("true", "0", lit("schema.missing"), lit("schema.add"))]),
    "schema_types": ladder([
        (f"{TYPE_SUM}=0", "0", lit("types.none"), lit("types.add")), (f"{TYPE_SUM}<=10", TYPE_SUM, lit("types.basic"), lit("types.add_more")),
        (f"{TYPE_SUM}<=25", TYPE_SUM, lit("types.good"), "''"), ("true", TYPE_SUM, lit("types.excellent"), "''")]),
    "faq_items": _Q,
    "internal_links": ladder([
        ("n_links=0", "0", lit("links.none"), lit("links.add")), ("n_links<=5", "30", lit("links.few"), lit("links.add_more")),
        ("n_links<=20", half_even("CAST(n_links AS DOUBLE)/20*100"), lit("links.good"), "''"), ("true", "greatest(100-2*(n_links-20),50)", lit("links.many"), lit("links.reduce"))]),
    "images_without_alt": ladder([
        (f"{IMG}=0", "100", lit("images.good"), "''"), (f"{IMG}<=10", half_even(f"100-CAST({IMG} AS DOUBLE)/10*50"), IMG_TEXT, lit("images.add")),
        (f"{IMG}<=20", half_even(f"50-CAST({IMG}-10 AS DOUBLE)/10*50"), IMG_TEXT, lit("images.urgent")), ("true", "0", f"concat('images.critical|', {IMG_TEXT})", lit("images.audit"))]),
}
for _query, _rule in [
    ("score_title", "title"), ("score_meta_description", "meta_description"), ("score_canonical", "canonical_url"), ("score_meta_robots", "meta_robots"),
    ("score_word_count", "word_count"), ("score_headings", "headings"), ("score_body_content", "body_text_content"), ("score_has_schema", "has_schema"),
    ("score_schema_types", "schema_types"), ("score_faq", "faq_items"), ("score_internal_links", "internal_links"), ("score_images_alt", "images_without_alt"),
]:
    _s, _f, _r = RULES[_rule]
    check(_query, with_ctes(*ALL) + f"select page_id, CAST({_s} AS INT) score, {_f} findings, {_r} recommendations from parsed")

GROUPS = {
    "metadata": ["title", "meta_description", "canonical_url", "meta_robots"],
    "content_quality": ["word_count", "headings", "body_text_content"],
    "structured_data": ["has_schema", "schema_types", "faq_items"],
    "connectivity": ["internal_links"],
    "technical_compliance": ["images_without_alt"],
}
_RULED = "ruled as materialized (select *, " + ", ".join(
    f"CAST({RULES[r][0]} AS INT) s_{r}, {RULES[r][1]} f_{r}, {RULES[r][2]} r_{r}" for rs in GROUPS.values() for r in rs
) + " from parsed)"


def group_columns(category: str) -> tuple[str, str, str]:
    rules = GROUPS[category]
    return (
        "+".join(f"s_{r}" for r in rules),
        "concat_ws('|', " + ", ".join(f"nullif(f_{r},'')" for r in rules) + ")",
        "concat_ws('|', " + ", ".join(f"nullif(r_{r},'')" for r in rules) + ")",
    )


for _query, _category in [
    ("category_metadata", "metadata"), ("category_content", "content_quality"), ("category_structured", "structured_data"),
    ("category_connectivity", "connectivity"), ("category_technical", "technical_compliance"),
]:
    _s, _f, _r = group_columns(_category)
    _m = "concat_ws('|', " + ", ".join(f"concat('{r}=', s_{r})" for r in sorted(GROUPS[_category])) + ")"
    check(_query, with_ctes(*ALL, _RULED) + f"select page_id, {_s} score, 100 max_possible, {_m} metrics, {_f} findings, {_r} recommendations from ruled")

REASONS = "reasons as (select * from (values " + ", ".join(f"({k}, '{v}')" for k, v in UNREACHABLE_REASONS.items()) + ") v(status_code, reason))"
check("reachability", with_ctes(ENRICHED, REASONS) + "select page_id, status_code, reason is null scorable, reason from pages_in left join reasons using (status_code)")
_SCORED = (
    "scored as materialized (select *, " + ", ".join(f"{group_columns(c)[0]} {c}_score, {group_columns(c)[1]} f_{c}, {group_columns(c)[2]} r_{c}" for c in GROUPS)
    + " from ruled where status_code not in (select status_code from reasons)),"
    + " paged as materialized (select *, " + half_even("structured_data_score*0.40::DOUBLE + metadata_score*0.25::DOUBLE + content_quality_score*0.20::DOUBLE + connectivity_score*0.10::DOUBLE + technical_compliance_score*0.05::DOUBLE")
    + " overall_score from scored)"
)
check("score_page", with_ctes(*ALL, _RULED, REASONS, _SCORED) + "select page_id, overall_score, metadata_score, content_quality_score, structured_data_score, connectivity_score, technical_compliance_score from paged")

ORDER = ["structured_data", "connectivity", "content_quality", "technical_compliance", "metadata"]
_MESSAGES = "msg as materialized (" + " union all ".join(
    f"select site_id, '{kind}' kind, crawl_pos, {i} category_pos, CAST(generate_subscripts(string_split({p}_{c}, '|'), 1)-1 AS INT) pos, unnest(string_split({p}_{c}, '|')) message from paged where {p}_{c}<>''"
    for i, c in enumerate(ORDER) for kind, p in (("finding", "f"), ("recommendation", "r"))
) + ")"
_TOPS = """
cnt as (select site_id, kind, message, count(*) n, min(crawl_pos*1000000+category_pos*1000+pos) first_at from msg group by all),
top as materialized (select *, CAST(row_number() over (partition by site_id, kind order by n desc, first_at) AS INT) "rank" from cnt qualify "rank"<=5)
"""
SITES = "sites as (select distinct CAST(page_id%9 AS INT) site_id, concat('https://site', page_id%9, '.example.com') url from pages)"
SITE_ALL = [*SITE, _RULED, REASONS, _SCORED, _MESSAGES, _TOPS, SITES]
_MEAN = "CAST(round_even(CAST(sum(overall_score) AS DOUBLE)/count(*), 0) AS INT)"
check("site_score", with_ctes(*SITE_ALL) + f"select sites.site_id, coalesce(s.m, 0) overall_score, coalesce(s.n, 0) pages_scored from sites left join (select site_id, {_MEAN} m, CAST(count(*) AS INT) n from paged group by 1) s using (site_id)")
check("site_messages", with_ctes(*SITE_ALL) + "select site_id, kind, crawl_pos, category_pos, pos, message from msg")
for _kind in ("finding", "recommendation"):
    check(f"top_{_kind}s", with_ctes(*SITE_ALL) + f"select site_id, \"rank\", message, n from top where kind='{_kind}'")
_WORDING = "wording(code, words) as (values " + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in MESSAGES.items()) + ")"
check("report_messages", with_ctes(*SITE_ALL, _WORDING) + """select site_id, kind, "rank", case when words is null then message when ends_with(code, ':') then concat(words, ': ', message[length(code)+1:]) else words end as "text", n from top left join wording on (case when strpos(message, ':')>0 then message[:strpos(message, ':')] else message end)=code""")
check("crawl_duration", with_ctes(CAPTURES) + "select site_id, CAST(max(fetched)-min(fetched) AS DOUBLE) crawl_duration_seconds from pages_in group by 1")
_LONG = "long as (" + " union all ".join(f"select site_id, '{c}' category, '{r}' metric, s_{r} points from paged" for c, rs in GROUPS.items() for r in rs) + ")"
check("category_rollup", with_ctes(*SITE_ALL, _LONG) + "select site_id, category, metric, count(*) n, CAST(sum(points) AS DOUBLE)/count(*) mean_points from long group by rollup(site_id, category, metric) having site_id is not null")

# semantics
_BAG = f"""
chunk as materialized (select page_id, pos section_position, heading, content from sections where heading<>'' and content<>''),
tokened as (select page_id, section_position, 'h' side, unnest({words('lower(heading)')}) w from chunk union all select page_id, section_position, 'c', unnest({words('lower(content)')}) from chunk),
counted as (select page_id, section_position, side, CAST(concat('0x', md5(w)[1:2]) AS INT) % 64 bucket, CAST(count(*) AS DOUBLE) v from tokened group by all),
weighted as materialized (select *, CAST(v / sqrt(sum(v*v) over (partition by page_id, section_position, side)) AS FLOAT) weight from counted),
dots as (select h.page_id, h.section_position, sum(CAST(h.weight AS DOUBLE)*CAST(c.weight AS DOUBLE)) d from weighted h join weighted c using (page_id, section_position, bucket) where h.side='h' and c.side='c' group by all),
aligned as materialized (select page_id, section_position, heading, {half_even('coalesce(d,0)*100')} alignment_score from chunk left join dots using (page_id, section_position))
"""
_BANDS = """case when alignment_score>70 then concat('section.coherent:', heading) when alignment_score>30 then concat('section.drifts:', heading) else concat('section.misaligned:', heading) end finding,
 case when alignment_score>70 then null when alignment_score>30 then concat('section.refocus:', heading) else 'section.rewrite' end recommendation"""
check("chunks", with_ctes(*TREE_OF, EXTRACT, _BAG) + "select page_id, section_position, heading, content from chunk")
check("embed_chunks", with_ctes(*TREE_OF, EXTRACT, _BAG) + "select page_id, section_position, CAST(bucket AS INT) bucket, round(CAST(weight AS DOUBLE), 5) weight from weighted where side='c'")
check("alignment_band", with_ctes(*TREE_OF, EXTRACT, _BAG) + f"select page_id, section_position, alignment_score, {_BANDS} from aligned")
_COUNTS = [f"CAST({e} AS DOUBLE)" for e in ("length(T)", "length(T)-length(replace(T,'e',''))", "length(T)-length(replace(T,'n',''))", "length(T)-length(replace(T,' ',''))")]
_LETTERS = ", ".join(f"round(CAST(CAST(({e})/sqrt({'+'.join(f'({x})*({x})' for x in _COUNTS)}) AS FLOAT) AS DOUBLE), 5) {name}{k}".replace("(T", f"({t}") for name, t in (("h", "heading"), ("c", "content")) for k, e in enumerate(_COUNTS))
check("embed_chunks_model", with_ctes(*TREE_OF, EXTRACT, _BAG) + f"select page_id, section_position, {_LETTERS} from chunk")
_VECTORS = f"vec as ({X.CHUNK_VECTORS.strip()})"
check("embed_chunks_table", with_ctes(_VECTORS) + "select chunk_id, page_id, CAST(len(hv) AS INT) n_dims from vec")
_VALIGN = f"valign as materialized (select *, {half_even('list_sum([CAST(hv[i] AS DOUBLE)*CAST(cv[i] AS DOUBLE) for i in range(1, len(hv)+1)])*100')} alignment_score from vec)"
check("alignment_score", with_ctes(_VECTORS, _VALIGN) + "select chunk_id, alignment_score from valign")


def page_means(source: str, keys: str) -> str:
    return f"""select {keys}, {half_even('CAST(sum(alignment_score) AS DOUBLE)/count(*)')} overall_score from {source} group by all"""


_PBANDS = """case when overall_score>70 then 'page.coherent' when overall_score>=40 then 'page.moderate' else 'page.poor' end finding,
 case when overall_score>70 then null when overall_score>=40 then 'page.review' else 'page.overhaul' end recommendation"""
_VPAGES = f"vpages as materialized (select *, {_PBANDS} from ({page_means('valign', 'page_id')}))"
check("page_semantic", with_ctes(_VECTORS, _VALIGN, _VPAGES) + "select page_id, overall_score, finding, recommendation, s.sections from vpages join (select page_id, string_agg(concat('h', chunk_id, '=', alignment_score), '|' order by chunk_id) sections from valign group by 1) s using (page_id)")


def semantic_site(pages: str, site: str, at: str) -> str:
    """`ssem`: site_id, score and top lists of page messages."""
    return f"""
smsg as (select {site} site_id, 'finding' kind, {at} seen_at, finding message from {pages} union all select {site}, 'recommendation', {at}, recommendation from {pages} where recommendation is not null),
scnt as (select site_id, kind, message, count(*) n, min(seen_at) f from smsg group by all),
stop as (select *, row_number() over (partition by site_id, kind order by n desc, f) rk from scnt qualify rk<=5),
slist as (select site_id, string_agg(message, '|' order by rk) filter (kind='finding') findings, string_agg(message, '|' order by rk) filter (kind='recommendation') recommendations from stop group by 1),
ssem as (select p.*, findings, coalesce(recommendations, '') recommendations from (select {site} site_id, {_MEAN} overall_score from {pages} group by 1) p join slist using (site_id))
"""


check("site_semantic", with_ctes(_VECTORS, _VALIGN, _VPAGES, semantic_site("vpages", "CAST(page_id%5 AS INT)", "page_id//5")) + "select site_id, overall_score, findings, recommendations from ssem")

# nested reports
_SPAGES = f"spages as materialized (select p.site_id, p.crawl_pos, q.*, {_PBANDS} from ({page_means('aligned', 'page_id')}) q join pages_in p using (page_id))"
_REPORT = """
tl as (select site_id, string_agg(message, '|' order by "rank") filter (kind='finding') findings, string_agg(message, '|' order by "rank") filter (kind='recommendation') recommendations from top group by 1),
sm as (select site_id, CAST(count(*) AS INT) pages_scored, CAST(round_even(CAST(sum(overall_score) AS DOUBLE)/count(*), 0) AS INT) overall_score, CAST(sum(content_quality_score) AS INT) content_points, sum(overall_score) points from paged group by 1),
un as (select site_id, CAST(count(*) AS INT) pages_unreachable from pages_in join reasons using (status_code) group by 1),
cap as (select site_id, CAST(count(*) AS INT) pages_crawled, CAST(max(fetched)-min(fetched) AS DOUBLE) secs from pages_in group by 1),
report as materialized (select sites.site_id, sites.url, coalesce(pages_crawled, 0) pages_crawled, coalesce(pages_scored, 0) pages_scored, coalesce(pages_unreachable, 0) pages_unreachable, coalesce(sm.overall_score, 0) overall_score, coalesce(ssem.overall_score, 0) semantic_score,
 coalesce(tl.findings, '') findings, coalesce(tl.recommendations, '') recommendations, coalesce(ssem.findings, '') semantic_findings, coalesce(ssem.recommendations, '') semantic_recommendations,
 coalesce(secs, 0.0) crawl_duration_seconds, content_points, points
 from sites left join cap using (site_id) left join sm using (site_id) left join un using (site_id) left join ssem using (site_id) left join tl using (site_id))
"""
REPORT_ALL = [*SITE_ALL, _BAG, _SPAGES, semantic_site("spages", "site_id", "crawl_pos"), _REPORT]
_LISTS = "findings, recommendations, semantic_findings, semantic_recommendations"
check("site_report", with_ctes(*REPORT_ALL) + f"select site_id, url, pages_crawled, pages_scored, pages_unreachable, overall_score, semantic_score, {_LISTS}, crawl_duration_seconds from report")
check("audit_digest", with_ctes(*REPORT_ALL) + f"select site_id, url, overall_score, semantic_score, pages_crawled, crawl_duration_seconds, {_LISTS} from report")
check("report_write", with_ctes(*REPORT_ALL) + "select site_id, url, pages_crawled, overall_score, nullif(split_part(findings, '|', 1), '') first_finding, pages_scored n_pages from report")
check("report_pages", with_ctes(*REPORT_ALL) + "select p.site_id, p.crawl_pos, p.url, g.overall_score page_score, s.overall_score semantic_score, s.n_sections, r.status_code gone_code, r.reason gone_reason from pages_in p left join paged g using (site_id, crawl_pos) left join (select spages.*, CAST(n AS INT) n_sections from spages join (select page_id, count(*) n from aligned group by 1) using (page_id)) s using (site_id, crawl_pos) left join reasons r on r.status_code=p.status_code where g.overall_score is not null or s.overall_score is not null or r.reason is not null")
_ERROR = f"case when pages_crawled=0 then '{UNREACHED}' when pages_scored=0 then '{BLOCKED}' end"
check("job_outcome", with_ctes(*REPORT_ALL) + f"select concat('job-', site_id) job_id, case when {_ERROR} is null then 'SUCCESS' else 'FAILURE' end status, {_ERROR} error_message, case when {_ERROR} is null then url end url, {_ERROR} is null has_result from report")
check("job_life_cycle", with_ctes(*REPORT_ALL) + f"""select sha256(concat_ws('|', site_id, url, 'a@example.org')) job_id, url, 'a@example.org' email, case when {_ERROR} is null then 'success' else 'failure' end status, {_ERROR} error_message,
 make_timestamp(CAST(1704067200+site_id AS BIGINT)*1000000) created_at, make_timestamp(CAST(1704067800+site_id AS BIGINT)*1000000) updated_at, make_timestamp(CAST(1704067800+site_id AS BIGINT)*1000000) completed_at, case when {_ERROR} is null then overall_score end overall_score, case when {_ERROR} is null then pages_crawled end pages_crawled, case when {_ERROR} is null then findings end findings from report""")
check("report_read", with_ctes(*REPORT_ALL) + f"select concat('job-', site_id) job_id, case when {_ERROR} is null then 'success' else 'failure' end status, {_ERROR} error_message, case when {_ERROR} is null then overall_score end overall_score, case when {_ERROR} is null then pages_crawled end pages_crawled, case when {_ERROR} is null then findings end findings, case when {_ERROR} is null then pages_scored end n_pages, case when {_ERROR} is null then content_points end content_points from report")

_RAW = "pages_in as materialized (select CAST(page_id%8 AS INT) site_id, CAST(page_id//8 AS INT) crawl_pos, page_id, url, CAST(200 AS INT) status_code, 1704067200+page_id fetched, html from pages)"
check("stream_page_audit", with_ctes(_RAW, *REPORT_ALL[1:]) + "select site_id, pages_crawled, pages_scored, overall_score, semantic_score, findings, semantic_findings, CAST(points AS BIGINT) points from report where pages_crawled>0")

# each seed reaches the newest capture of its own URL: no link leads to another capture
_SEEDED = f"""caps as materialized ({X.sql_for_duckdb(X.SITE_CAPTURES)}),
named as materialized (select *, regexp_extract(url, '//([^/?#]*)', 1) host, rtrim(lower(regexp_extract(url, '^[^?#]*')), '/') plain_url from caps),
sites as materialized (select CAST(page_id AS INT) site_id, url, plain_url from (select *, min(page_id) over (partition by host) lo, max(page_id) over (partition by host) hi from named) t where page_id in (lo, hi)),
pages_in as materialized (select s.site_id, 0 crawl_pos, CAST(s.site_id AS BIGINT) page_id, n.url, n.status_code, n.fetched, n.html from sites s join (select plain_url, arg_max(page_id, (fetched, -page_id)) page_id from named where status_code=200 group by 1) last using (plain_url) join named n on n.page_id=last.page_id)"""
check("audit_from_seed", with_ctes(_SEEDED, *[x for x in REPORT_ALL[1:] if x != SITES]) + f"select site_id, url, pages_crawled, pages_scored, pages_unreachable, overall_score, semantic_score, {_LISTS}, crawl_duration_seconds from report")

# jobs
_STATE = f"select job_id, arg_max(status, (ts, event_id)) status, arg_max(error_message, (ts, event_id)) filter (error_message is not null) error_message, min(ts) created_at, max(ts) updated_at from ({X.JOB_EVENTS.strip()}) e group by 1"
check("job_latest_state", _STATE)
check("stream_job_state", _STATE)
check("job_lookup", f"select job_id, status, error_message from ({_STATE}) where job_id='job-7'")
check("client_key", f"select event_id, trim(split_part(xff, ',', 1)) client from ({X.REQUESTS.strip()}) r")
check("job_create", f"select sha256(concat_ws('|', event_id, url, 'a@example.org')) job_id, event_id, url, 'PENDING' status from (select event_id, concat('https://', trim(split_part(xff, ',', 1))) url from ({X.REQUESTS.strip()}) r)")


def cooldown(seconds: int) -> str:
    return f"""with recursive req as materialized (select event_id, ts, trim(split_part(xff, ',', 1)) client from ({X.REQUESTS.strip()}) r),
adm as (select client, min(ts) ts from req group by 1
 union all select a.client, (select min(r.ts) from req r where r.client=a.client and r.ts>=a.ts + interval {seconds} second) ts from adm a where a.ts is not null),
won as (select min(event_id) event_id from adm join req using (client, ts) group by client, ts)
"""


for _name, _seconds in (("cooldown_admit", 300), ("cooldown_admit_day", 86400)):
    check(_name, cooldown(_seconds) + "select event_id, client, event_id in (select event_id from won) admitted from req")
check("stream_cooldown", cooldown(86400) + "select event_id, client from req where event_id in (select event_id from won)")

# link graph
_SP = f"pages_in as materialized ({X.SITE_PAGES.strip()})"
_LINKS = [_SP, TOKENS, ALL_LINKS]
_SLINKS = "sl as materialized (select p.site_id, n.page_id, n.n pos, target, CAST(n.page_id//4 AS INT) crawl_pos from norm n join pages_in p using (page_id) where target is not null)"
# the rules of the fixture's files, from the pages that their lines come from
_RULES = f"""li as materialized ({X.HOST_LINES.strip()}),
files as materialized (select host, min(page_id)%7=6 is_empty, count(*) filter (page_id%2=0) n_even, bool_or(page_id%6<>4) filter (page_id%2=0) has_1, coalesce(bool_or(page_id%2=1), false) has_2 from li group by host having min(page_id)%5<>4),
numbered as (select li.host, page_id, path, page_id%2+1 entry, row_number() over (partition by li.host, page_id%2 order by page_id) k, n_even from li join files using (host) where not is_empty),
rules as materialized (select host, CAST(entry AS INT) entry, case entry when 1 then '*' else 'audit-bot,other' end agents, CAST(case entry when 1 then k else greatest(n_even, 1)+3+k end AS INT) line,
 page_id%6 in (2,3) or path='' allow, case when page_id%6=0 then left(path, 4) else path end path from numbered where page_id%6<>4)"""
check("robots_rules", with_ctes(_RULES) + "select * from rules")


def allowed(missing: str) -> str:
    """Agent audit-bot is named by the second group; where it has no rules, the group for all holds."""
    path = "case when regexp_extract(target, '^https?://[^/]*(.*)$', 1)='' then '/' else regexp_extract(target, '^https?://[^/]*(.*)$', 1) end"
    first = f"(select arg_min(allow, line) from rules r where r.host=h and r.entry=case when has_2 then 2 else 1 end and starts_with({path}, r.path))"
    return f"select page_id, pos, target from (select *, regexp_extract(target, '^https?://([^/]*)', 1) h from (select page_id, n pos, target from norm where target is not null)) l left join files on files.host=h where case when files.host is null then {missing} else coalesce({first}, true) end"


for _name, _missing in (("robots_filter", "false"), ("robots_filter_allow", "true")):
    check(_name, with_ctes(RAW, TOKENS, ALL_LINKS, _RULES) + allowed(_missing))
check("new_links", with_ctes(RAW, TOKENS, ALL_LINKS) + """select CAST(page_id%4 AS INT) site_id, target url, min(page_id*100000+n)//100000 found_at, CAST(min(page_id*100000+n)%100000 AS INT) found_pos from norm
where target is not null and page_id%3<>0 and (page_id%4, target) not in (select (page_id%4, target) from norm where target is not null and page_id%3=0) group by 1, 2""")
# the generated sites' files, stated plainly
_SITE_RULES = "rules as (select * from (values ('s0.example.com',1,'*',1,false,'/p5'),('s2.example.com',1,'audit-bot',2,true,'/p31'),('s2.example.com',1,'audit-bot',3,false,'/p3'),('s2.example.com',2,'*',7,false,'/')) v(host, entry, agents, line, allow, path))"


def site_allowed(missing: str) -> str:
    first = "(select arg_min(allow, line) from rules r where r.host=concat('s', site_id, '.example.com') and entry=1 and starts_with(regexp_extract(target, '^https://[^/]*(.*)$', 1), r.path))"
    return f"case when site_id=1 then {missing} else coalesce({first}, true) end"


def replay(limit: int, rule: str) -> str:
    """One fetched batch per step, with the queue and the visited list carried as arrays."""
    out = f"""
ok as materialized (select page_id, site_id, url from pages_in where status_code=200),
adj as materialized (select l.site_id, ok.url, list(target order by pos) out_links from sl l join ok using (page_id) where {rule.replace('site_id', 'l.site_id')} group by 1, 2),
run as (select site_id, [concat('https://s', site_id, '.example.com/p0')] queue, CAST(0 AS BIGINT) head, CAST([] AS VARCHAR[]) got from (select distinct site_id from pages_in) s
 union all select site_id, list_concat(queue, fresh), head+len(batch), list_concat(got, hits) from (
  select r.site_id, queue, head, got, batch, (select coalesce(list(bu order by bi), []) from (select unnest(batch) bu, generate_subscripts(batch, 1) bi) b join ok on ok.site_id=r.site_id and ok.url=bu) hits,
   (select coalesce(list(u order by f), []) from (select u, min(bi*100000+li) f from (select bi, unnest(out_links) u, generate_subscripts(out_links, 1) li from (select unnest(batch) bu, generate_subscripts(batch, 1) bi) b join adj on adj.site_id=r.site_id and adj.url=bu) e where not list_contains(queue, u) group by u)) fresh
  from (select *, queue[head+1:head+3] batch from run where len(got)<{limit} and head<len(queue)) r))
"""
    return with_ctes(*_LINKS, _SLINKS, _SITE_RULES, out) + "select site_id, CAST(generate_subscripts(got, 1)-1 AS INT) crawl_pos, unnest(got) url from (select site_id, arg_max(got, head) got from run group by 1)"


for _name, _limit, _rule in [
    ("crawl_replay", 20, "true"), ("crawl_replay_limit_5", 5, "true"),
    ("crawl_replay_robots", 10, site_allowed("false")), ("crawl_replay_robots_allow", 10, site_allowed("true")),
]:
    check(_name, f"select r.site_id, r.crawl_pos, p.page_id, r.url from ({replay(_limit, _rule)}) r join ({X.SITE_PAGES.strip()}) p using (url)")
