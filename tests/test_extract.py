"""HTML snippets to page signals; all snippets are parsed in one job."""

import pytest

from auditloom.operators.extract import parse_pages

URL = "https://site.example/dir/page"
LD = '<script type="application/ld+json">{}</script>'

CASES = [
    # title
    ("<html><head><title>Plain title</title></head></html>", {"title": "Plain title", "body_text_content": None}),
    ("<title></title>", {"title": None}),
    ("<head></head>", {"title": None, "headings": [], "word_count": 0}),
    ("<title>a <b>b</b></title>", {"title": None}),
    ("<title> Fish &amp; chips &#8217;&#x41; &nope; </title>", {"title": " Fish & chips ’A &nope; "}),
    ("<TITLE>first</TITLE><title>second</title>", {"title": "first"}),
    # meta and link
    ('<meta name="description" content="A &lt;b&gt;"><meta name="description" content="later">', {"meta_description": "A <b>"}),
    ("<meta name='description'><meta name='description' content='late'>", {"meta_description": None}),
    ("<meta content=bare name=robots>", {"meta_robots": "bare"}),
    ('<meta content="x name=robots" name="other">', {"meta_robots": None}),
    ('<head><link rel="alternate canonical" href="/c"></head>', {"canonical_url": "/c"}),
    ('<head><link rel="Canonical" href="/c"></head>', {"canonical_url": None}),
    ('<body><p>x</p><link rel="canonical" href="/c"></body>', {"canonical_url": None}),
    ('<body><link rel="canonical" href="/c"><main>x</main></body>', {"canonical_url": "/c"}),
    # headings
    ("<body><h1> A <b>b</b>c </h1><div><h2>D</h2></div><h6>\n</h6></body>", {"headings": [("h1", "A bc"), ("h2", "D"), ("h6", "")]}),
    ("<body><nav><h2>gone</h2></nav><h3>stays</h3></body>", {"headings": [("h3", "stays")]}),
    # body text
    ("<body><div>lead-in</div><main><section>core <em>text</em></section></main><div>coda</div></body>", {"body_text_content": "core text"}),
    ("<body><ul><li>1<li>2</ul><table><tr><td>3</table></body>", {"body_text_content": "1 2 3"}),
    ("<p>no <i>body</i> tag</p>", {"body_text_content": "no body tag", "word_count": 3}),
    ("", {"body_text_content": None, "word_count": 0}),
    (None, {"body_text_content": None, "title": None}),
    ("<main><div><footer>f</footer>a<nav>n</nav></div><script>s()</script>b</main>", {"body_text_content": "a b"}),
    ('<body><p class="ad">x</p><div class="big sponsored"><div>y</div> z</div><p class="adverts">kept</p></body>', {"body_text_content": "kept"}),
    ('<body><p class="ad">gone<p>kept<div class="ads">gone</div></body>', {"body_text_content": "kept"}),
    ("<body><nav>open <div>never closed</div></body>", {"body_text_content": ""}),
    ("<body><div><nav>unclosed <b>x</b></div><p>after</p></body>", {"body_text_content": "after"}),
    ("<body><nav>a<nav>b</nav>c</nav>d</body>", {"body_text_content": "d"}),
    ("<body>foo<b>bar</b><!-- <p>no</p> -->baz  </body>", {"body_text_content": "foo bar baz"}),
    ('<body><img alt="a > b"><a title=\'x>y\' href="/q">t</a> 1 < 2</body>', {"body_text_content": "t 1 < 2", "internal_links": ["https://site.example/q"]}),
    ("<body><script>if (a<b) '</p>'</script><style>p{}</style>x</body>", {"body_text_content": "x"}),
    ("<body><template>t</template>u<br/>v</body>", {"body_text_content": "u v"}),
    ("<body><p>cut off", {"body_text_content": "cut off"}),
    # links
    ('<body><a href="/a">1</a><a href="b?x#y">2</a><a href="">3</a><a href>4</a><a>5</a><a href="/a">6</a></body>',
     {"internal_links": ["https://site.example/a", "https://site.example/dir/b", URL, URL, "https://site.example/a"]}),
    ('<body><nav><a href="/a">1</a></nav><a href="https://other.example/">2</a><a href="mailto:a@b.c">3</a></body>', {"internal_links": []}),
    ("<body><a href=/unquoted/>1</a></body>", {"internal_links": ["https://site.example/unquoted"]}),
    # images
    ('<body><img><img alt=""><img alt=" &nbsp;"><img alt="x"><img alt></body>', {"images_without_alt": 4}),
    ("<body><header><img></header></body>", {"images_without_alt": 0}),
    # JSON-LD
    (f"<head>{LD.format('[1, ')}{LD.format('{}')}</head>", {"json_ld_schema": ["{}"], "has_schema": True, "schema_types": []}),
    (f"<body>{LD.format('{}')}</body>", {"has_schema": False}),
    (f"<head>{LD.format(chr(123) + chr(125) + ' trailing')}</head>", {"has_schema": False}),
    ('<head><script type="application/ld+json">{"@type":["A","B"],"x":[{"@type":"C","y":{"@type":"A"}}]}</script></head>', {"schema_types": ["A", "B", "C"]}),
    # sections
    ("<body><h3>T</h3>free<ul><li>1<li>2</ul></body>", {"sections": [("T", "free 1 2")]}),
    ("<body><h2>A</h2><p>1</p><h4>B <i>b</i></h4>tail<p>2</p></body>", {"sections": [("A", "1"), ("B b", "tail 2")]}),
    ("<body><h1>A</h1><div><h2>B</h2><p>1</p></div><p>2</p><h2>C</h2></body>", {"sections": [("A", "B 1 2"), ("B", "1"), ("C", "")]}),
    ("<body><a><h2>in a link</h2></a><p>out</p></body>", {"sections": [("in a link", "")]}),
    ("<body><h1>A</h1>text<p>1<p>2<h2>B</h2></body>", {"sections": [("A", "text 1 2"), ("B", "")]}),
    ("<body><div><h2>A</h2><p>1</p></div><p>2</p></body>", {"sections": [("A", "1")]}),
    ("<body><h1>O</h1><script>js()</script><div><script>no()</script></div><main>m</main></body>", {"sections": [("O", "js() m")]}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, URL, html, 200) for i, (html, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status_code int")
    out = {r.page_id: r.asDict(True) for r in parse_pages(pages).collect()}
    assert len(out) == len(CASES)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_signal(parsed, i):
    html, expected = CASES[i]
    row = parsed[i]
    for name, want in expected.items():
        got = row[name]
        if name == "headings":
            got = [(h["tag"], h["text"]) for h in got]
        elif name == "sections":
            got = [(s["heading"], s["content"]) for s in got]
        assert got == want, (html, name)


def test_one_exchange(spark):
    """Parsing shuffles the captured pages once and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = parse_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bucketed_source_needs_no_exchange(spark, tmp_path):
    from auditloom.operators.extract import parse_pages as parse
    from auditloom.sources.captures import write_captures

    spark.conf.set("spark.sql.sources.bucketing.enabled", "true")
    pages = spark.createDataFrame([(i, URL, "<p>x") for i in range(20)], "page_id long, url string, html string")
    name = f"captures_{tmp_path.name.replace('-', '_')}"
    write_captures(pages, name, 4)
    try:
        df = parse(spark.table(name), clustered=True)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 20
    finally:
        spark.sql(f"drop table {name}")
