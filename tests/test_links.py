"""Robots rules, new links and the crawl replay, the latter against a plain queue."""

from collections import deque
from urllib.robotparser import RobotFileParser

from auditloom.operators import links as L

AGENT = "page-audit-bot/1.0"
FILES = {
    "a.example": "User-agent: *\nDisallow: /p5",
    "b.example": "User-agent: audit-bot\nAllow: /p31\nDisallow: /p3\n\nDisallow: /p4\nUser-agent: *\nDisallow: /",
    "c.example": "",
    "d.example": "# note\nUser-agent: other\nUser-agent: AUDIT\nDisallow:\nCrawl-delay: 3\nUser-agent: *\nDisallow: /",
    "e.example": "Disallow: /p1\nUser-agent: *\n\nDisallow: /p2\n",
    "f.example": "User-agent: *\nAllow: /p%31\nDisallow: /p\n",
    "g.example": "User-agent: zzz\nDisallow: /\n",
}
PATHS = ["", "/", "/p1", "/p2", "/p3", "/p31", "/p4", "/p5", "/p55", "/q"]


def test_robots_match_the_standard_library(spark):
    robots = spark.createDataFrame(list(FILES.items()), "host string, body string")
    targets = [(h, f"https://{h}{p}") for h in [*FILES, "missing.example"] for p in PATHS]
    links = spark.createDataFrame(targets, "site string, target string")
    got = {r.target for r in L.robots_filter(links, robots, AGENT).collect()}
    want = set()
    for h, target in targets:
        parser = RobotFileParser()
        if h in FILES:
            parser.parse(FILES[h].splitlines())
        if parser.can_fetch(AGENT, target):
            want.add(target)
    assert got == want
    allowing = {r.target for r in L.robots_filter(links, robots, AGENT, "allow").collect()}
    assert allowing == want | {t for h, t in targets if h == "missing.example"}


def test_robots_of_a_host_with_many_rules(spark):
    n = 100_000
    lines = [f"{'Allow' if i % 3 == 0 else 'Disallow'}: /d{i % 300}/p{i}" for i in range(n)]
    robots = spark.createDataFrame([("big.example", "User-agent: *\n" + "\n".join(lines))], "host string, body string")
    wanted = [(i, f"https://big.example/d{i % 300}/p{i}/x") for i in range(0, n, 997)] + [(-1, "https://big.example/none")]
    links = spark.createDataFrame(wanted, "k int, target string")
    got = {r.k for r in L.robots_filter(links, robots, AGENT).collect()}

    def first(i):
        # the shortest rule line that is a prefix comes first: /d1/p1 before /d1/p12
        path = f"/d{i % 300}/p{i}"
        return min((j for j in {int(str(i)[:k]) for k in range(1, len(str(i)) + 1)} if path.startswith(f"/d{j % 300}/p{j}")), default=None)

    assert got == {-1} | {i for i, _ in wanted if i >= 0 and first(i) % 3 == 0}
    rules, lengths = L.prefix_rules(robots, AGENT)
    assert rules.count() == n and lengths.first().lengths == sorted({len(x.split(": ")[1]) for x in lines})


def test_every_document_and_turn_is_in_a_derived_page(spark):
    from auditloom.plans import fixtures as X

    folder = "/root/testdata/sf0.001"
    pages = X.table(spark, folder, X.ENRICHED_PAGES)
    got = pages.selectExpr("sum(regexp_count(html, '<h2>'))", "sum(regexp_count(html, '\"@type\":\"Question\"') - CAST(page_id % 6 IN (4, 5) AS INT))").first()
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    pairs = spark.read.parquet(f"{folder}/conversations.parquet").selectExpr("conv_id", "turn - turn % 2").distinct().count()
    assert tuple(got) == (docs, pairs)
    letters = "[^A-Za-z\u00c0-\u024f]"
    text = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(f"sum(length(regexp_replace(text, '{letters}', '')))").first()[0]
    body = pages.selectExpr(f"sum(length(regexp_replace(array_join(regexp_extract_all(html, '</h2><p>([^<]*)</p>', 1), ''), '{letters}', '')))").first()[0]
    assert body == text


def test_new_links(spark):
    links = spark.createDataFrame(
        [(0, 1, 4, "x"), (0, 0, 9, "x"), (0, 0, 2, "y"), (1, 0, 0, "x")], "site_id int, crawl_pos int, pos int, target string"
    )
    visited = spark.createDataFrame([(0, "y")], "site_id int, url string")
    rows = L.new_links(links, visited).collect()
    assert sorted((r.site_id, r.url, r.found_at, r.found_pos) for r in rows) == [(0, "x", 0, 9), (1, "x", 0, 0)]


def plain_crawl(pages, seed, limit):
    queue, visited, got = deque([seed]), {seed}, []
    while queue and len(got) < limit:
        batch = [queue.popleft() for _ in range(min(3, len(queue)))]
        for url in batch:
            if url in pages:
                got.append(url)
                for target in pages[url]:
                    if target not in visited:
                        visited.add(target)
                        queue.append(target)
    return got


def graph(site, n, fan, dead):
    base = f"https://s{site}.example"
    pages = {}
    for i in range(n):
        if i and dead(i):
            continue
        pages[f"{base}/p{i}"] = [f"{base}/p{j}" for j in fan(i)]
    return pages


def test_crawl_replay(spark):
    sites = {
        0: graph(0, 200, lambda i: (3 * i + 1, 3 * i + 2, 3 * i + 3, 0), lambda i: False),
        1: graph(1, 200, lambda i: (3 * i + 1, 3 * i + 2, 3 * i + 3), lambda i: i % 11 == 7),
        2: graph(2, 60, lambda i: (i + 1,), lambda i: False),
        3: graph(3, 300, lambda i: range(i + 1, i + 6), lambda i: i % 2 == 1),
        4: graph(4, 3, lambda i: (1, 2), lambda i: False),
        5: {},
    }
    rows, n = [], 0
    for pages in sites.values():
        for url, targets in pages.items():
            rows.append((n, url, 200, "".join(f'<a href="{t}">x</a>' for t in targets)))
            n += 1
    df = spark.createDataFrame(rows, "page_id long, url string, status_code int, html string")
    seeds = spark.createDataFrame([(s, f"https://s{s}.example/p0") for s in sites], "site_id int, seed_url string")
    for limit in (5, 20):
        got = {}
        for r in L.crawl_replay(df, seeds, limit=limit).collect():
            got.setdefault(r.site_id, []).append((r.crawl_pos, r.url))
        for s, pages in sites.items():
            assert [u for _, u in sorted(got.get(s, []))] == plain_crawl(pages, f"https://s{s}.example/p0", limit), (s, limit)
        assert len(got[0]) == {5: 7, 20: 22}[limit]
