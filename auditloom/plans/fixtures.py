"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

Raw pages carry no status codes, meta tags, JSON-LD or images, so these queries add them by rule. `/*G*/`
stands for the global-replace flag, which DuckDB needs and Spark does not take.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["pages", "documents", "conversations", "embeddings", "events"]

# Letters of any script, digits and marks that need no escape in markup or JSON; all else becomes a blank.
PLAIN = "[^ !#$%()*+,./0-9:;=?@A-Z_a-z{|}¡-\ud7ff-]+"


def plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '{PLAIN}', ' ' /*G*/), '  +', ' ' /*G*/))"


def in_order(x: str, first: str, second: str, sep: str) -> str:
    """The group's texts one after another, sorted by two numbers."""
    lead = f"concat(lpad(CAST({first} AS STRING), 12, '0'), lpad(CAST({second} AS STRING), 12, '0'), '~', {x})"
    return f"regexp_replace(array_join(array_sort(array_agg({lead})), '{sep}'), '[0-9]+~', '' /*G*/)"


# Every document is dealt to a page and becomes a section of it; every two turns of a conversation become a question and
# its answer on a page.
ENRICHED_PAGES = f"""
with turns as (select conv_id, turn-turn%2 pair, max(case when turn%2=0 then {plain("text")} end) q, max(case when turn%2=1 then {plain("text")} end) a from conversations group by 1, 2),
faq as (select page_id, {in_order("""concat('{"@type":"Question","name":"',coalesce(nullif(q,''),'q'),'","acceptedAnswer":{"@type":"Answer","text":"',coalesce(a,''),'"}}')""", "conv_id", "pair", ",")} items
 from (select conv_id%(select max(page_id)+1 from pages) page_id, conv_id, pair, q, a from turns) t group by page_id),
doc as (select page_id, min(concat(lpad(CAST(doc_id AS STRING), 12, '0'), '~', line)) line, {in_order("concat('<h2>',left(line,60),'</h2><p>',w,'</p>')", "doc_id", "0", "")} sections
 from (select page_id, doc_id, {plain("split_part(text,chr(10),1)")} line, {plain("text")} w
  -- dealt by page before the texts are worked on, which the grouping then needs no exchange for
  from (select /*+ REPARTITION(page_id) */ doc_id%(select max(page_id)+1 from pages) page_id, doc_id, text from documents) d) t group by page_id),
mix as (select p.page_id, p.url, p.html, faq.items, doc.sections, regexp_replace(doc.line, '^[0-9]+~', '') line from pages p left join doc on doc.page_id=p.page_id left join faq on faq.page_id=p.page_id)
select p.page_id, p.url, CAST(case when p.page_id%17=5 then 404 when p.page_id%17=9 then 201 else 200 end AS INT) status_code,
 replace(replace(p.html,'</title>', concat('</title>',
  case when p.page_id%5=0 then '' else concat('<meta name="description" content="',coalesce(p.line,''),'">') end,
  case p.page_id%7 when 1 then '<meta name="robots" content="INDEX, follow">' when 2 then '<meta name="robots" content="noindex">' when 3 then '<meta name="robots" content="none">' when 4 then '<meta name="robots" content="noarchive">' when 6 then '<meta name="robots" content="index, nosnippet">' when 5 then '<meta name="robots">' else '' end,
  case when p.page_id%3=0 then '' else concat('<link rel="canonical" href="',p.url,'">') end,
  case p.page_id%6 when 0 then '' when 1 then '<script type="application/ld+json">{{"@type":"Article"</script>' when 2 then '<script type="application/ld+json">{{"@type":["Product","Organization","Article","BreadcrumbList","LocalBusiness","Person","WebPage"]}}</script>'
   when 3 then '<script type="application/ld+json">{{"@graph":[{{"@type":"Organization"}},{{"@type":"Product","brand":{{"@type":"Person"}}}}]}}</script>'
   else concat('<script type="application/ld+json">{{"@type":"FAQPage","mainEntity":[{{"@type":"Question","name":"q","acceptedAnswer":{{"@type":"Answer","text":"a"}}}}',
     repeat(concat(',{{"name":"again","text":"',coalesce(p.line,'x'),'"}}'),CAST(p.page_id%14 AS INT)),']}}</script>') end,
  case when p.items is null then '' else concat('<script type="application/ld+json">{{"@type":"FAQPage","mainEntity":[',p.items,']}}</script>') end)),
  '</article>', concat(
   case when p.page_id%9=2 then '<h1>one more</h1>' else '' end,
   coalesce(p.sections,''),case when p.page_id%4=0 then '' else '<div><h3>inner part</h3><p>nested</p></div><p>tail</p>' end,
   repeat('<img src="a.png">',CAST(p.page_id%27 AS INT)),'<img src="b.png" alt="b">',case when p.page_id%27=0 then '' else '<img src="c.png" alt=" ">' end,case when p.page_id%3=1 then '<script type="application/ld+json">{{"@type":"Event"}}</script>' else '' end,
   repeat('<a href="../X/./y/?q=1#f">in</a>',CAST((p.page_id*7)%31 AS INT)),'<a href="https://other.example.org/">out</a><a href="mailto:a@b.c">m</a>','</article>')) html
from mix p
"""

# Eight sites over the enriched pages; `fetched` is the capture time in seconds.
SITE_CAPTURES = f"""
select CAST(page_id%8 AS INT) site_id, CAST(floor(page_id/8) AS INT) crawl_pos, page_id, url, status_code,
 1704067200+(page_id*37)%5000 fetched, html
from ({ENRICHED_PAGES}) e
"""

# Four crawlable sites with navigation, upper-case and query variants, back links and 404s.
SITE_PAGES = """
select CAST(page_id%4 AS INT) site_id, page_id, concat('https://s',CAST(page_id%4 AS STRING),'.example.com/p',CAST(i AS STRING)) url, CAST(case when i%11=7 then 404 else 200 end AS INT) status_code,
 concat('<html><body><nav><a href="/p',CAST(3*i+1 AS STRING),'">n</a></nav><main><h1>p</h1><a href="/p',CAST(3*i+2 AS STRING),'">n</a><a href="/P',CAST(3*i+3 AS STRING),'/?a=1">n</a><a href="/p0">home</a></main></body></html>') html
from (select page_id, CAST(floor(page_id/4) AS INT) i from pages) q
"""

# A robots file for most hosts of the captured pages, a line from the first link of each of their pages: a group for all
# agents from even pages, one for two named agents from odd ones. Some hosts have an empty file, some have none.
HOST_LINES = """
select regexp_extract(url, '//([^/?#]*)', 1) host, page_id, lower(regexp_extract(html, 'href="(/[^"]*)"', 1)) path from pages
"""
ROBOTS = f"""
with li as ({HOST_LINES.strip()}),
ru as (select host, page_id, concat(lpad(CAST(page_id AS STRING), 12, '0'), '~', case page_id%6 when 0 then concat('Disallow: ', left(path, 4)) when 1 then concat('Disallow: ', path)
 when 2 then concat('Allow: ', path) when 3 then concat('ALLOW : ', path) when 4 then concat('# ', path) else concat('disallow:', path, ' # note') end) line from li)
select host, case when min(page_id)%7=6 then '' else regexp_replace(concat('User-agent: *', chr(10), coalesce(array_join(array_sort(array_agg(case when page_id%2=0 then line end)), chr(10)), ''),
 chr(10), chr(10), 'User-agent: audit-bot', chr(10), 'User-agent: Other', chr(10), coalesce(array_join(array_sort(array_agg(case when page_id%2=1 then line end)), chr(10)), '')), '[0-9]+~', '' /*G*/) end body
from ru group by host having min(page_id)%5<>4
"""

# A file for every generated site but site 1; site 3 has an empty one.
SITE_ROBOTS = """
select distinct concat('s',CAST(page_id%4 AS STRING),'.example.com') host,
 case page_id%4 when 0 then concat('User-agent: *',chr(10),'Disallow: /p5')
  when 2 then concat('# rules',chr(10),'User-agent: audit-bot',chr(10),'Allow: /p31',chr(10),'Disallow: /p3',chr(10),chr(10),'Disallow: /p4',chr(10),'User-agent: *',chr(10),'Disallow: /')
  else '' end body
from pages where page_id%4<>1
"""

CHUNK_VECTORS = """
select h.vec_id chunk_id, CAST(floor(h.vec_id/12) AS BIGINT) page_id, h.embedding hv, c.embedding cv from embeddings h join embeddings c on c.vec_id=h.vec_id+1 where h.vec_id%2=0
"""

JOB_EVENTS = """
select concat('job-',CAST(user_id AS STRING)) job_id, ts, event_id, case event_type when 'signup' then 'PENDING' when 'view' then 'CRAWLING' when 'click' then 'SCORING' when 'purchase' then 'SUCCESS' else 'FAILURE' end status, case when event_type='error' then props end error_message from events
"""

REQUESTS = """
select event_id, concat(case when event_id%2=0 then ' ' else '' end,'u',CAST(user_id AS STRING),', proxy') xff, ts from events
"""

# Links of every shape, each resolved from every page.
LINK_SHAPES = [
    "../X/./y/?q=1#f", "?p=2", "#top", "", "//other.example.org/z", "/abs/../k", "HTTPS://user@HOST.example/A/../b",
    "mailto:a@b.c", "a//b/../../c/.", "../../../up", "/About/?x=1#y", "./", "..", "page;v=1?z", " /lead/Space",
    "ftp://a.example/x",
]


def _listed() -> str:
    """The class of PLAIN with its ASCII ranges written out: Java looks listed characters up in one table, while every
    range is one more call for each character of a text, which took most of the time of making these inputs."""
    ascii_chars = [c for c in map(chr, range(128)) if not re.fullmatch(PLAIN, c)]
    return "[^" + "".join(c if c.isalnum() or c == " " else f"\\\\{c}" for c in ascii_chars) + "¡-\ud7ff]+"


def sql_for_spark(sql: str, sf_dir: str) -> str:
    sql = sql.replace(PLAIN, _listed())
    for table in TABLES:
        for lead in ("from ", "join "):
            sql = sql.replace(f"{lead}{table} ", f"{lead}parquet.`{sf_dir}/{table}.parquet` ")
            sql = sql.replace(f"{lead}{table})", f"{lead}parquet.`{sf_dir}/{table}.parquet`)")
            sql = sql.replace(f"{lead}{table}\n", f"{lead}parquet.`{sf_dir}/{table}.parquet`\n")
    return sql


def sql_for_duckdb(sql: str) -> str:
    return sql.replace(" /*G*/", ", 'g'").replace("array_join(", "array_to_string(").strip()


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql_for_spark(sql, sf_dir))
