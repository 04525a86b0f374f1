"""Robots rules as rows, and which urls an agent may fetch.

Files become lines, lines become groups of agents with their rules, all with SQL functions; a file is one site's and small by
contract (500 KiB are read of one at most elsewhere), so windows over its lines are bounded. Rules meet urls like a trie of
path prefixes: a rule's literal start (all before its first `*` or final `$`) is looked up among the url path's prefixes of the lengths
that rules have, by an equi-join on site and prefix; only then are wildcards tested.

order="first": the first rule of the group whose path begins the url's decides, wildcards are plain characters, a blank line ends a
group, and an agent gets the first group one of whose names is part of its own, else the first for `*`.
order="longest": the longest pattern decides, an allowing one among equals; `*` and a final `$` are wildcards, blank lines are nothing,
and an agent gets all groups of its name, else all for `*`.

Paths are compared decoded, with query and fragment; an empty one is `/`. A rule with an empty path allows everything, or says nothing
if it allows. A site without a file may be fetched, one whose file could not be read may not, nor an url that is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_URL = r"^\s*([A-Za-z]+)://([^/?#\s]*)([^\s]*)\s*$"
_AUTHORITY = r"^(\[[0-9A-Fa-f:.]+\]|[^:@\[\]]+)(?::(\d*))?$"


def origin(url: Column) -> Column:
    """scheme://host:port in lower case, the port always there; null for what is no such url or names a user."""
    scheme, authority = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, _AUTHORITY, 1)), r"\.+$", "")
    told = F.regexp_extract(authority, _AUTHORITY, 2)
    port = F.when(told == "", F.when(scheme == "https", 443).otherwise(80)).otherwise(told.try_cast("int"))
    return F.when(scheme.isin("http", "https") & (host != "") & port.between(0, 65535), F.concat(scheme, F.lit("://"), host, F.lit(":"), port.cast("string")))


def decoded(text: Column) -> Column:
    """Per-cent escapes as what they stand for; as it is, if one is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def path(url: Column) -> Column:
    """All behind the authority, decoded."""
    rest = decoded(F.regexp_extract(url, _URL, 3))
    return F.when(rest == "", "/").when(rest.rlike("^[?#]"), F.concat(F.lit("/"), rest)).otherwise(rest)


def groups(files: DataFrame, site: str, text: str, blanks_end: bool) -> DataFrame:
    """(site, grp, agents, pos, allow, path) of every rule of files (site, text)."""
    lines = files.select(F.col(site).alias("site"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#[\\s\\S]*$", ""))
    key = F.lower(F.trim(F.substring_index(line, ":", 1)))
    value = decoded(F.trim(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1)))
    kind = F.when(F.trim("raw") == "", "blank").when(~line.contains(":"), None).when(key == "user-agent", "agent").when(key.isin("allow", "disallow"), key).when(key.isin("crawl-delay", "request-rate"), "rate")
    told = lines.select("site", "pos", kind.alias("kind"), value.alias("value")).where("kind IS NOT NULL" if blanks_end else "kind IS NOT NULL AND kind <> 'blank'")
    so_far = Window.partitionBy("site").orderBy("pos")
    told = told.withColumn("before", F.lag("kind").over(so_far))
    starts = (F.col("kind") == "agent") & (F.coalesce("before", F.lit("")) != "agent")
    told = told.withColumn("grp", F.max(F.when(starts, F.col("pos"))).over(so_far)).withColumn("ended", F.max(F.when(F.col("kind") == "blank", F.col("pos"))).over(so_far))
    told = told.where(F.col("grp").isNotNull() & (F.coalesce("ended", F.lit(-1)) < F.col("grp")))
    agents = told.where("kind = 'agent'").groupBy("site", "grp").agg(F.collect_set(F.lower("value")).alias("agents"))
    rules = told.where("kind IN ('allow', 'disallow') AND NOT (kind = 'allow' AND value = '')")
    rules = rules.select("site", "grp", "pos", ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))
    if blanks_end:  # a group that a blank line ends before its first rule is none
        agents = agents.join(told.where("kind <> 'agent'").select("site", "grp").distinct(), ["site", "grp"], "left_semi")
    return agents.join(rules, ["site", "grp"], "left")


def for_agent(rules: DataFrame, agent: str, order: str) -> DataFrame:
    """(site, pos, allow, path): the rules that count for one agent."""
    name = agent.split("/")[0].strip().lower()
    star = F.array_contains("agents", "*")
    if order == "first":
        own = ~star & F.exists("agents", lambda a: (a != "") & F.lit(name).contains(a))
        ranked = rules.select("site", "grp", own.alias("own"), star.alias("star")).distinct().where("own OR star")
        chosen = ranked.groupBy("site").agg(F.min_by("grp", F.struct(~F.col("own"), "grp")).alias("grp"))
        return rules.join(chosen, ["site", "grp"], "left_semi").where("pos IS NOT NULL").select("site", "pos", "allow", "path")
    marked = rules.withColumn("own", F.array_contains("agents", name))
    named = marked.where("own").select("site").distinct().withColumn("named", F.lit(True))
    return marked.join(named, "site", "left").where((F.col("own") | (F.col("named").isNull() & star)) & F.col("pos").isNotNull()).select("site", "pos", "allow", "path")


def verdicts(urls: DataFrame, url: str, files: DataFrame, agent: str, order: str = "longest") -> DataFrame:
    """urls with `site`, `rule` (the line of the rule that decides, from 0) and `may_fetch`. files: (site as `origin` gives it, status, text), one a site;
    status is `ok`, `absent` or `failed`, and a site that isn't listed counts as absent."""
    if order not in ("first", "longest"):
        raise ValueError(order)
    rules = for_agent(groups(files.where("status = 'ok'"), "site", "text", order == "first"), agent, order)
    if order == "first":
        literal, regex = F.when(F.col("path") == "*", "").otherwise(F.col("path")), F.lit(None).cast("string")
    else:
        ended = F.col("path").endswith("$")
        pattern = F.when(ended, F.expr("substr(path, 1, length(path) - 1)")).otherwise(F.col("path"))
        parts = F.transform(F.split(pattern, r"\*"), lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        literal = F.substring_index(pattern, "*", 1)
        regex = F.when(ended | pattern.contains("*"), F.concat(F.lit("(?s)^"), F.array_join(parts, ".*"), F.when(ended, "\\z").otherwise("")))
    rules = rules.select("site", "pos", "allow", literal.alias("prefix"), regex.alias("regex"), F.length("path").alias("weight"))
    lengths = sorted(r[0] for r in rules.select(F.length("prefix")).distinct().collect())  # as many as a path is long, at most
    keyed = urls.select(F.col(url).alias("_url")).distinct().select("_url", origin(F.col("_url")).alias("site"), path(F.col("_url")).alias("_path"))
    each = keyed.withColumn("_length", F.explode(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("_path"))))
    met = each.withColumn("prefix", F.expr("substr(_path, 1, _length)")).join(rules, ["site", "prefix"])
    met = met.where(F.col("regex").isNull() | F.rlike("_path", F.col("regex")))
    first = F.struct(-F.col("pos")) if order == "first" else F.struct("weight", "allow", -F.col("pos"))
    decided = met.groupBy("_url").agg(F.max_by(F.struct("pos", "allow"), first).alias("_rule"))
    status = files.select("site", F.col("status").alias("_status"))
    out = urls.withColumn("site", origin(F.col(url))).join(decided, F.col(url) == F.col("_url"), "left").join(status, "site", "left")
    allowed = F.when(F.col("site").isNull() | (F.coalesce("_status", F.lit("absent")) == "failed"), False).otherwise(F.coalesce("_rule.allow", F.lit(True)))
    return out.select(*[c for c in urls.columns], "site", F.col("_rule.pos").alias("rule"), allowed.alias("may_fetch"))
