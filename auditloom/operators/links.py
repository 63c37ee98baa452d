"""Link graph: crawl links, robots rules, new links and the bounded crawl replay."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions.urls import host, normalize, url_path
from auditloom.operators.tokens import html_tokens
from auditloom.session import checkpoint

DEFAULT_AGENT = "page-audit-bot/1.0"
# Line breaks of a robots file.
LINE_BREAK_RE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def crawl_links(pages: DataFrame) -> DataFrame:
    """Same-host links of each page in document order, navigation included. No exchange."""
    tokens = html_tokens(pages).where("tag = 'a' AND kind IN ('open', 'void')")
    target = normalize(H.attr("href"), F.col("url"))
    return tokens.select(*[c for c in tokens.columns if c not in ("raw", "kind", "tag")], _each(target, "target"))


def _each(value: Column, name: str) -> Column:
    """The value as rows: one, or none when it is NULL. Unlike a filter on it, evaluated once."""
    return F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name)


def _unquote(col: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def _robots_entries(robots: DataFrame) -> DataFrame:
    """One row per host and group of user-agent lines with its rules in order; group 0 is empty."""
    lines = robots.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), LINE_BREAK_RE)).alias("line", "text"))
    content = T.strip(F.regexp_replace("text", "(?s)#.*$", ""))
    key = F.lower(T.strip(F.regexp_extract(content, r"(?s)^([^:]*):", 1)))
    value = _unquote(T.strip(F.regexp_extract(content, r"(?s)^[^:]*:(.*)$", 1)))
    kind = (
        F.when(F.col("text") == "", "blank")
        .when(key == "user-agent", "agent")
        .when(key.isin("allow", "disallow"), "rule")
        .when(key.isin("crawl-delay", "request-rate"), "delay")
    )
    marked = lines.select("host", "line", kind.alias("kind"), key.alias("key"), value.alias("value"))
    # a first line of no interest stays, so that its host does
    marked = marked.where("kind IS NOT NULL OR line = 0").fillna("other", ["kind"])
    by_line = Window.partitionBy("host").orderBy("line")
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(by_line), F.lit("")) != "agent")
    grouped = marked.withColumns(
        {"_start": starts.cast("int"), "_blank": (F.col("kind") == "blank").cast("int")}
    ).withColumns({"entry": F.sum("_start").over(by_line).cast("int"), "_blanks": F.sum("_blank").over(by_line)})
    # a blank line ends a group, so later rules of the same group number are void
    opening = F.min("_blanks").over(Window.partitionBy("host", "entry"))
    live = grouped.withColumn("_live", (F.col("_blanks") == opening) & (F.col("entry") > 0))
    is_rule = F.col("_live") & (F.col("kind") == "rule")
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    return live.groupBy("host", "entry").agg(
        F.collect_set(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"),
        F.sort_array(
            F.collect_list(F.when(is_rule, F.struct(F.col("line"), allow.alias("allow"), F.col("value").alias("path"))))
        ).alias("rules"),
        F.coalesce(F.bool_or(F.col("_live") & F.col("kind").isin("rule", "delay")), F.lit(False)).alias("complete"),
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots.txt bodies (`host`, `body`) to ordered rules per host and user-agent group."""
    entries = _robots_entries(robots).where("complete")
    return entries.select(
        "host", "entry", F.array_join(F.sort_array("agents"), ",").alias("agents"), F.inline("rules")
    )


def agent_rules(robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """One row per host with the rules that bind `agent`: the first group that names it, else the first
    '*' group, else none."""
    name = agent.split("/")[0].lower()
    entries = _robots_entries(robots)
    is_default = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.contains(F.lit(name), a)) & ~is_default
    pick = F.struct("entry", "rules")
    live = F.col("complete")
    return entries.groupBy("host").agg(
        F.coalesce(F.min(F.when(live & named, pick)), F.min(F.when(live & is_default, pick))).alias("_pick")
    ).select("host", F.coalesce(F.col("_pick.rules"), F.array().cast("array<struct<line:int,allow:boolean,path:string>>")).alias("rules"))


def is_allowed(target: Column, rules: Column, missing_robots: str) -> Column:
    """First rule whose path is a prefix decides; NULL rules mean the host has no robots file."""
    path = _unquote(url_path(target))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    first = F.get(F.filter(rules, lambda r: F.startswith(path, r.path)), F.lit(0))
    return F.when(rules.isNull(), F.lit(missing_robots == "allow")).otherwise(
        F.coalesce(first.allow, F.lit(True))
    )


def prefix_rules(robots: DataFrame, agent: str = DEFAULT_AGENT) -> tuple[DataFrame, DataFrame]:
    """The rules that bind `agent` as an index: (host, path, line, allow), the first rule of each path; and (host, lengths),
    a row for each host with a file: the lengths that its paths have."""
    hosts = agent_rules(robots, agent)
    rules = hosts.select("host", F.inline("rules")).groupBy("host", "path").agg(F.min(F.struct("line", "allow")).alias("first"))
    lengths = hosts.select("host", F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.length(r.path)))).alias("lengths"))
    return rules.select("host", "path", "first.line", "first.allow"), lengths


def robots_filter(
    links: DataFrame, robots: DataFrame, agent: str = DEFAULT_AGENT, missing_robots: str = "deny"
) -> DataFrame:
    """Keep the links that robots rules allow: of the rules whose path is a prefix, the first decides.

    Each distinct path of a host is judged once. It explodes to its prefixes, of the lengths that occur among the host's
    rules, and these meet the rules in an equi-join on (host, prefix): the work for a path grows with the lengths, not with the
    rules of its host. Neither side is bounded, so no broadcast is forced; Spark splits skewed hosts of the link side.
    """
    rules, lengths = prefix_rules(robots, agent)
    path = _unquote(url_path(F.col("target")))
    asked = links.withColumns({"_host": host(F.col("target")), "_path": F.when(path == "", F.lit("/")).otherwise(path)})
    distinct = asked.select("_host", "_path").distinct().join(lengths.withColumnRenamed("host", "_host"), "_host", "left")
    fitting = F.filter("lengths", lambda n: n <= F.length("_path"))
    prefixes = distinct.select("_host", "_path", F.explode(fitting).alias("_n")).withColumn("_prefix", F.expr("left(_path, _n)"))
    hits = prefixes.join(rules.select(F.col("host").alias("_host"), F.col("path").alias("_prefix"), "line", "allow"), ["_host", "_prefix"])
    first = hits.groupBy("_host", "_path").agg(F.min_by("allow", "line").alias("_allow"))
    without_file = F.when(F.col("lengths").isNull(), F.lit(missing_robots == "allow")).otherwise(F.lit(True))
    judged = distinct.join(first, ["_host", "_path"], "left").select("_host", "_path", F.coalesce("_allow", without_file).alias("_allow"))
    return asked.join(judged.where("_allow").drop("_allow"), ["_host", "_path"], "left_semi").drop("_host", "_path")


def new_links(links: DataFrame, visited: DataFrame) -> DataFrame:
    """First discovery of every link not visited yet: (site_id, url, found_at, found_pos).

    `links` carries site_id, crawl_pos, pos and target. The minimum combines before the shuffle, so a
    target linked from a third of all pages costs one row per task.
    """
    first = links.groupBy("site_id", F.col("target").alias("url")).agg(
        F.min(F.struct("crawl_pos", "pos")).alias("_at")
    )
    return first.join(visited.select("site_id", "url"), ["site_id", "url"], "left_anti").select(
        "site_id", "url", F.col("_at.crawl_pos").alias("found_at"), F.col("_at.pos").alias("found_pos")
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Captures with status 200 as edges (url, page_id, fetched_at, pos, target); one NULL target row per page."""
    fetched = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    ok = pages.where("status_code = 200").select("page_id", F.col("url").alias("_own"), "html", fetched.alias("fetched_at"))
    ok = ok.select("page_id", "html", "fetched_at", _each(normalize(F.col("_own"), F.col("_own")), "url"))
    tokens = html_tokens(ok)
    is_link = F.coalesce((F.col("tag") == "a") & F.col("kind").isin("open", "void"), F.lit(False))
    tokens = tokens.withColumn("pos", F.coalesce("pos", F.lit(0))).where(is_link | (F.col("pos") == 0))
    target = F.when(is_link, normalize(H.attr("href"), F.col("url")))
    wanted = F.filter(F.array(target), lambda x: x.isNotNull() | (F.col("pos") == 0))
    return tokens.select("page_id", "url", "fetched_at", "pos", F.explode(wanted).alias("target"))


def crawl_replay(
    pages: DataFrame,
    seeds: DataFrame,
    robots: DataFrame | None = None,
    limit: int = 20,
    agent: str = DEFAULT_AGENT,
    missing_robots: str = "deny",
) -> DataFrame:
    """Bounded breadth-first crawl of captured pages, all sites at once.

    `seeds` holds (site_id, seed_url). Returns (site_id, crawl_pos, page_id, url). Without `robots`
    nothing is filtered. Links stay on their host, so only captures of the seeds' hosts are looked into; where captures
    are stored by `host` (see `write_captures`) they are found without an exchange. Of the captures of a URL the newest
    counts (of equals, or without `fetched_at`, that of the least page_id).

    Fetch order is a plain queue, so a whole breadth-first level is one round. A round that finds no
    page ends its site, and `limit + 2` pages end it too, so there are at most `limit + 2` rounds. Pages
    are read once, to build the edge table; rounds join the small frontier with it. The batches of three
    fetches, which decide by how much the limit is overshot, are replayed afterwards on the short list
    of each site.
    """
    need = limit + 2
    sites = seeds.select("site_id", _each(normalize(F.col("seed_url"), F.col("seed_url")), "url"))
    sites = sites.withColumn("_host", host(F.col("url")))
    if robots is None:
        sites = sites.withColumn("rules", F.array().cast("array<struct<line:int,allow:boolean,path:string>>"))
    else:
        sites = sites.join(agent_rules(robots, agent).withColumnRenamed("host", "_host"), "_host", "left")
    sites = checkpoint(sites)
    if "host" not in pages.columns:
        pages = pages.withColumn("host", host(F.col("url")))
    pages = pages.join(sites.select(F.col("_host").alias("host")).distinct(), "host", "left_semi")
    sites = sites.drop("_host")
    edges = checkpoint(link_edges(pages).repartition("url"))

    frontier = sites.select("site_id", F.lit(0).alias("k"), "url", F.lit(None).cast("int").alias("parent"))
    tally = sites.select("site_id", F.lit(1).alias("known"), F.lit(0).alias("found"))
    frontier = checkpoint(frontier)
    seen, fetched = [frontier], []
    per_site = Window.partitionBy("site_id").orderBy("k")
    same_url = Window.partitionBy("site_id", "k")

    while not frontier.isEmpty():
        newest = F.max_by("page_id", F.struct("fetched_at", -F.col("page_id"))).over(same_url)
        hits = frontier.join(edges, "url", "left").withColumn("_page", newest)
        hits = checkpoint(hits.where("_page IS NULL OR page_id = _page"))
        level = hits.groupBy("site_id", "k").agg(F.max("_page").alias("page_id"), F.max("url").alias("url"))
        level = level.join(tally, "site_id").withColumn("ok", F.col("page_id").isNotNull().cast("int"))
        level = level.withColumn("_total", F.col("found") + F.sum("ok").over(per_site))
        level = checkpoint(level.where(F.col("_total") - F.col("ok") < need))
        fetched.append(level.select("site_id", "k", "url", "page_id", "ok"))
        after = level.groupBy("site_id").agg(
            F.max("known").alias("known"), F.max("_total").cast("int").alias("found")
        )
        going = after.where(F.col("found") < need)
        found = (
            hits.where("target IS NOT NULL")
            .join(going.select("site_id"), "site_id", "left_semi")
            .join(sites.select("site_id", "rules"), "site_id")
            .where(is_allowed(F.col("target"), F.col("rules"), missing_robots))
            .select("site_id", F.col("k").alias("crawl_pos"), "pos", "target")
        )
        visited = reduce(DataFrame.unionByName, [s.select("site_id", "url") for s in seen])
        fresh = new_links(found, visited).join(going, "site_id")
        order = Window.partitionBy("site_id").orderBy("found_at", "found_pos")
        frontier = checkpoint(
            fresh.select(
                "site_id",
                (F.col("known") + F.row_number().over(order) - 1).cast("int").alias("k"),
                "url",
                F.col("found_at").alias("parent"),
            )
        )
        grown = frontier.groupBy("site_id").agg(F.count("*").cast("int").alias("_new"))
        tally = going.join(grown, "site_id").select(
            "site_id", (F.col("known") + F.col("_new")).alias("known"), "found"
        )
        seen.append(frontier)

    children = (
        reduce(DataFrame.unionByName, seen)
        .where("parent IS NOT NULL")
        .groupBy("site_id", F.col("parent").alias("k"))
        .agg(F.count("*").cast("int").alias("born"))
    )
    queue = reduce(DataFrame.unionByName, fetched).join(children, ["site_id", "k"], "left")
    return _replay_batches(queue, limit)


def _replay_batches(queue: DataFrame, limit: int) -> DataFrame:
    """Cut each site's fetch queue where the limit test, made before every batch of three, ends it."""
    entry = F.struct("k", "ok", F.coalesce("born", F.lit(0)).alias("born"), "page_id", "url")
    lists = queue.groupBy("site_id").agg(F.sort_array(F.collect_list(entry)).alias("queue"))

    def step(acc: Column, x: Column) -> Column:
        starts = x.k == acc.batch_end
        stops = starts & (acc.found >= limit) & (acc.stop < 0)
        return F.struct(
            F.when(starts, F.least(x.k + 3, acc.tail)).otherwise(acc.batch_end).alias("batch_end"),
            (acc.tail + x.born).alias("tail"),
            (acc.found + x.ok).alias("found"),
            F.when(stops, x.k).otherwise(acc.stop).alias("stop"),
        )

    start = F.struct(
        F.lit(0).alias("batch_end"), F.lit(1).alias("tail"), F.lit(0).alias("found"), F.lit(-1).alias("stop")
    )
    stop = F.aggregate("queue", start, step, lambda acc: acc.stop)
    lists = lists.withColumn("_stop", stop)
    crawled = F.filter("queue", lambda x: (x.ok == 1) & ((F.col("_stop") < 0) | (x.k < F.col("_stop"))))
    rows = lists.select("site_id", F.posexplode(crawled).alias("crawl_pos", "page"))
    return rows.select("site_id", "crawl_pos", "page.page_id", "page.url")
