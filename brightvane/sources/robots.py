"""Robots rules (A-10): parsed from stored robots.txt files, matched to URLs by host and longest pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain_of
from ..shared import settle

#: A group for every agent.
ANY = "*"
#: The longest path that is looked at, as in common limits on URLs; longer patterns match nothing.
LONGEST = 2048


def robots_lines(robots: DataFrame) -> DataFrame:
    """The directives (host, at, key, value) of robots(host, status, body) in order; files that were not found have none."""
    lines = robots.where("status = 200 and body is not null").select(F.lower("host").alias("host"), F.posexplode(F.split("body", r"\r\n?|\n")).alias("at", "line"))
    bare = F.trim(F.regexp_replace("line", r"#.*$", ""))
    pair = lines.select("host", "at", F.lower(F.trim(F.regexp_extract(bare, r"^([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_extract(bare, r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value"))
    return pair.where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))


def robots_rules(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, groups) of robots(host, status, body).

    Successive user-agent lines open a group; the lines after them belong to it.
    rules(host, agent, allow, pattern, head, size, shape): a pattern with its part
    before the first wildcard, its length and its form as a regular expression. An
    empty pattern rules nothing. groups(host, agent, crawl_delay): the agents that a
    host names, and the first valid delay of each.
    """
    order = Window.partitionBy("host").orderBy("at")
    named = F.col("key") == "user-agent"
    opens = named & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = robots_lines(robots).withColumn("opens", opens.cast("int")).withColumn("block", F.sum("opens").over(order))
    agents = lines.where(named & (F.col("value") != "")).select("host", "block", F.lower("value").alias("agent")).distinct()
    given = agents.join(lines.where(~named).select("host", "block", "at", "key", "value"), ["host", "block"], "left")
    groups = given.groupBy("host", "agent").agg(F.min_by(F.when(F.col("key") == "crawl-delay", F.expr("try_cast(value as double)")), F.when((F.col("key") == "crawl-delay") & (F.expr("try_cast(value as double)") > 0), F.col("at"))).alias("crawl_delay"))
    wild = given.where(F.col("key").isin("allow", "disallow") & F.col("value").rlike(r"^[/*]") & (F.length("value") <= LONGEST))
    rules = wild.select("host", "agent", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern")).distinct()
    return rules.withColumns({"head": F.regexp_extract("pattern", r"^([^*$]*)", 1), "size": F.length("pattern"), "shape": _shape(F.col("pattern"))}), groups


def _shape(pattern: Column) -> Column:
    """A pattern as a regular expression: `*` is any run, a final `$` the end, all else itself."""
    quoted = F.regexp_replace(pattern, r"([\\.+?()\[\]{}|^$])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*+", ".*"), r"\\\$$", r"\$"))


def _agent_of(groups: DataFrame, agent: str) -> DataFrame:
    """(host, agent) of the group that rules an agent: the longest name that is part of its own, or that for every agent."""
    own = groups.where((F.col("agent") == ANY) | F.contains(F.lit(agent.lower()), F.col("agent")))
    return own.groupBy("host").agg(F.max_by(F.struct("agent", "crawl_delay"), F.when(F.col("agent") == ANY, 0).otherwise(F.length("agent"))).alias("g")).select("host", "g.agent", "g.crawl_delay")


def _verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each path(host, path) may be fetched: of the patterns that match, the longest decides, and of equal ones an allowing one; without any it may.

    Patterns are an index of their literal heads: a path is looked up by its
    prefixes of the lengths that occur as heads for its host, then held against the
    few patterns found. A host with very many pages is thereby dealt over as many
    keys as it has prefixes, and its lengths are a narrow row that skewed joins copy.
    """
    sizes = settle(rules.groupBy("host").agg(F.collect_set(F.length("head")).alias("sizes")))  # at most LONGEST numbers
    tried = paths.join(sizes, "host").select("host", "path", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: F.left(F.col("path"), n))).alias("head"))
    found = tried.join(rules.select("host", "head", "allow", "size", "shape"), ["host", "head"]).where(F.expr("rlike(path, shape)"))
    best = found.groupBy("host", "path").agg(F.max(F.struct("size", "allow")).alias("best"))
    return best.select("host", "path", F.col("best.allow").alias("allow"))


def permitted(urls: DataFrame, robots: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """urls with robots_allowed, robots_reason and crawl_delay, from stored robots(host, status, body).

    A URL is allowed if the group for `agent` allows it, or that for every agent
    does. Without a file or a group all is allowed; a URL without a host is not. The
    delay is that of the agent's own group, or else of the one for every agent.
    """
    rules, groups = robots_rules(robots)
    rules, groups = settle(rules), settle(groups)
    known = robots.where("status = 200 and body is not null").select(F.lower("host").alias("_host")).distinct()
    base = urls.withColumn("_url", F.col(url_col)).withColumn("_host", domain_of(F.col(url_col)))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("_url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"#.*$", ""), r"^(?=\?|$)", "/")
    base = base.withColumn("_path", F.left(path, F.lit(LONGEST)))
    paths = settle(base.select(F.col("_host").alias("host"), F.col("_path").alias("path")).where("host <> ''").distinct())
    own, every = _agent_of(groups, agent), groups.where(F.col("agent") == ANY)
    verdict = lambda who: _verdicts(paths, rules.join(who.select("host", "agent"), ["host", "agent"]))
    answers = paths.join(verdict(own).withColumnRenamed("allow", "_own"), ["host", "path"], "left").join(verdict(every).withColumnRenamed("allow", "_every"), ["host", "path"], "left")
    answers = answers.select(F.col("host").alias("_host"), F.col("path").alias("_path"), (F.coalesce("_own", F.lit(True)) | F.coalesce("_every", F.lit(True))).alias("_allowed"))
    delay = own.select("host", F.col("crawl_delay").alias("_own")).join(every.select("host", F.col("crawl_delay").alias("_every")), "host", "full").select(F.col("host").alias("_host"), F.coalesce("_own", "_every").alias("crawl_delay"))
    rows = base.join(answers, ["_host", "_path"], "left").join(known.withColumn("_known", F.lit(True)), "_host", "left").join(delay, "_host", "left")
    some = F.coalesce("_allowed", F.lit(True))
    allowed = F.when(F.coalesce("_host", F.lit("")) == "", False).otherwise(F.when(F.col("_known"), some).otherwise(True))
    reason = (
        F.when(F.coalesce("_host", F.lit("")) == "", "unparseable host").when(F.col("_known").isNull(), "no robots.txt published")
        .when(some, "allowed by robots.txt").otherwise("disallowed by robots.txt")
    )
    return rows.select(*[rows[c] for c in urls.columns], allowed.alias("robots_allowed"), reason.alias("robots_reason"), "crawl_delay")
