"""The crawl frontier as a dataflow over stored pages: urls, expansion level by level, robots rules.

The live crawl (network, pacing) is out of scope; the pages table stands for what a fetch would bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.shared import materialize


def normalize_url(url: Column) -> Column:
    """Without fragment, with a scheme, lower-case."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.lower(F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(F.concat(F.lit("http://"), bare)))


def netloc(url: Column) -> Column:
    """Host with port."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """A link of a page as a full url: absolute, from the scheme, from the root or from the page's folder."""
    scheme, root = F.regexp_extract(base, "^([a-z][a-z0-9+.-]*):", 1), F.regexp_extract(base, "^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([a-z][a-z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(folder.rlike("^[a-z][a-z0-9+.-]*://$") | (folder == ""), F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def seeds(urls: DataFrame) -> DataFrame:
    """(url, depth) of distinct seeds."""
    return urls.where("url is not null").select(normalize_url(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0))


def queue(frontier: DataFrame) -> DataFrame:
    """Waiting urls in the order they leave: shallow first, then first come; a url queued twice leaves once."""
    waiting = frontier.where("state in ('pending', 'queued')").select(normalize_url(F.col("url")).alias("url"), "depth", "seq")
    return waiting.groupBy("url").agg(F.min(F.struct("depth", "seq")).alias("f")).select("url", "f.depth", "f.seq").orderBy("depth", "seq")


def expand(level: DataFrame, pages: DataFrame, seen: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): the links of one level's pages that haven't been seen; none from pages at max_depth."""
    stored = pages.select(normalize_url(F.col("url")).alias("url"), "links")
    links = level.where(F.col("depth") < max_depth).join(stored, "url").select("url", "depth", F.explode("links").alias("link"))
    found = links.where(F.length("link") > 0).select(normalize_url(resolve(F.col("url"), F.col("link"))).alias("to"), (F.col("depth") + 1).alias("depth"))
    return found.groupBy("to").agg(F.min("depth").alias("depth")).withColumnRenamed("to", "url").join(seen.select("url"), "url", "left_anti")


def crawl(pages: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """(url, depth): breadth first from the seeds over the stored links. Each level is written to the shared folder, so the
    plan stays short and lost executors repeat one level at most; the number of jobs is max_depth."""
    level = seen = materialize(seeds(start), "frontier-0")
    for depth in range(1, max_depth + 1):
        level = materialize(expand(level, pages, seen, max_depth), f"frontier-{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def frontier_statistics(frontier: DataFrame) -> DataFrame:
    """(state, urls, min_depth, max_depth); null states are ``unknown``."""
    state = F.coalesce("state", F.lit("unknown")).alias("state")
    return frontier.groupBy(state).agg(F.countDistinct(normalize_url(F.col("url"))).alias("urls"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def mark_failed(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """The frontier with the named urls in state ``failed``."""
    gone = urls.select(normalize_url(F.col("url")).alias("gone")).distinct()
    joined = frontier.join(gone, normalize_url(frontier["url"]) == gone["gone"], "left")
    return joined.withColumn("state", F.when(F.col("gone").isNotNull(), "failed").otherwise(F.col("state"))).drop("gone")


def parse_robots(files: DataFrame) -> DataFrame:
    """(domain, agent, prefix) from robots files (domain, text); grouped agents share the rules that follow them."""
    lines = files.select("domain", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    lines = lines.select("domain", "i", F.trim(F.regexp_replace("line", "#.*", "")).alias("line")).where("line <> ''")
    pairs = lines.select("domain", "i", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("v"))
    # a group begins where an agent line follows a line that is none
    def fold(acc, x):  # noqa: ANN001, ANN202
        agent = x["k"] == "user-agent"
        agents = F.when(agent & acc["open"], F.concat(acc["agents"], F.array(x["v"]))).when(agent, F.array(x["v"])).otherwise(acc["agents"])
        rule = (x["k"] == "disallow") & (x["v"] != "")
        rules = F.when(rule, F.concat(acc["rules"], F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), x["v"].alias("prefix"))))).otherwise(acc["rules"])
        return F.struct(agents.alias("agents"), agent.alias("open"), rules.alias("rules"))

    listed = pairs.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("i", "k", "v"))).alias("xs"))  # one small file
    zero = F.struct(
        F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,prefix:string>>").alias("rules")
    )
    rules = listed.select("domain", F.explode(F.aggregate("xs", zero, fold, lambda acc: acc["rules"])).alias("r"))
    return rules.select("domain", "r.agent", "r.prefix")


def allowed(urls: DataFrame, rules: DataFrame, agent: str, *, strict: bool = False) -> DataFrame:
    """Urls that no rule of ``*`` or of exactly this agent forbids. A rule of ``/`` alone counts only if strict; null and
    empty prefixes forbid nothing."""
    own = rules.where(F.col("agent").isin("*", agent) & (F.length("prefix") > 0)).select(F.lower("domain").alias("host"), "prefix").distinct()
    own = own if strict else own.where("prefix <> '/'")
    left = urls.withColumn("_host", F.lower(netloc(F.col("url")))).withColumn("_path", path_of(F.col("url")))
    return left.join(own, (F.col("_host") == F.col("host")) & F.col("_path").startswith(F.col("prefix")), "left_anti").drop("_host", "_path")
