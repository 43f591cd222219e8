"""URL filters as a sort-merge range join.

A host becomes its labels in reverse, each followed by a dot (example.org -> org.example.), so that a rule's host and all its
subdomains are one interval of keys, and a rule (host, path) becomes the key of its host followed by its path, of which all
paths that start with it are one interval. Intervals of prefixes nest or are disjoint. So two sweeps do:

1. Hosts. The distinct hosts of the urls and the starts and ends of the rules' hosts are sorted by key. A start pushes a host
   on the stack of those that enclose it, an end pops it; a url's host sees the whole stack, that is all rule hosts it is under.
2. Paths. The paths of urls under a rule's host are swept with that host's rules in the same way; a url sees the rule on top of the
   stack, the longest that fits. Over its hosts the longest rule wins.

Only urls under some rule's host are shuffled. A host's urls are dealt over as many salts as their count asks for, and its rules
are repeated for each salt; the distinct hosts of one top-level label likewise. So one very common host is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted, written

#: Hosts or urls that a salt of a sweep takes, at least.
SALT_ROWS = 1_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no `://`."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(whole, URL, 1), UPPER, LOWER), F.regexp_extract(whole, URL, 2)


def host_key(host) -> Column:
    """The labels of a host in reverse, a dot behind each: a host's subdomains are what its key is a prefix of."""
    return F.encode(F.concat_ws("", F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(x, F.lit(".")))), "UTF-8")


def _after(key: Column) -> Column:
    """What lies behind all keys that start with this one: UTF-8 has no byte FF."""
    return F.concat(key, F.unhex(F.lit("FF")))


def _top(host) -> Column:
    """The top-level label, within which the intervals of hosts lie."""
    return F.element_at(F.split(host, r"\."), -1)


def _host_events(hosts: DataFrame) -> DataFrame:
    """host -> top, key, stack: the rule hosts that are open from this key on, for the start and the end of each."""
    above = F.expr("transform(sequence(1, size(labels)), k -> array_join(slice(labels, -k, k), '.'))")
    up = hosts.select("host", F.split("host", r"\.").alias("labels")).select("host", F.posexplode(above).alias("depth", "outer"))
    # the rule hosts around each, itself last: as many as it has labels at most
    known = hosts.select(F.col("host").alias("outer"))
    stacks = up.join(known, "outer").groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "outer"))), lambda x: x["outer"]).alias("stack"))
    one = stacks.select("host", "stack", _top("host").alias("top"), host_key("host").alias("key"))
    popped = F.slice("stack", 1, F.size("stack") - 1)
    return one.select("top", "key", "stack").unionByName(one.select("top", _after(F.col("key")).alias("key"), popped.alias("stack")))


def _path_events(rules: DataFrame) -> DataFrame:
    """host, key, state: what is on top of the stack from this path on, for the start and the end of each rule."""
    top = F.struct(F.concat("host", "path").alias("rule"), "verdict")
    outer = rules.select("host", F.col("path").alias("p"), top.alias("outer"))
    # the enclosing rule: the longest proper prefix of the path that is a rule of the same host
    parts = rules.where(F.length("path") > 0).select(
        "host", "path", F.explode(F.expr("transform(sequence(0, length(path) - 1), k -> substring(path, 1, k))")).alias("p")
    )
    parent = parts.join(outer, ["host", "p"]).groupBy("host", "path").agg(F.max_by("outer", F.length("p")).alias("outer"))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    nested = rules.join(parent, ["host", "path"], "left").withColumn("key", F.concat(host_key("host"), F.encode("path", "UTF-8")))
    return nested.select("host", "key", top.alias("state")).unionByName(nested.select("host", _after(F.col("key")).alias("key"), F.coalesce("outer", none).alias("state")))


def _swept(probes: DataFrame, events: DataFrame, by: str, state: str) -> DataFrame:
    """probes (by, key and others) with the state of the last event at or before their key; events: by, key, state.

    Both are dealt over salts by the number of probes of each value of `by`, then sorted together by key.
    """
    n = probes.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(events.groupBy(by).agg(F.count(F.lit(1)).alias("n_events")), by)
    salts = n.select(by, F.ceil(F.col("n") / F.greatest(F.lit(SALT_ROWS), 2 * F.col("n_events"))).cast("int").alias("salts"))
    own = [c for c in probes.columns if c not in (by, "key")]
    dealt = probes.join(salts, by).select(by, "key", F.pmod(F.xxhash64(*own), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast(events.schema[state].dataType).alias(state), *own)
    each = events.join(salts, by).select(by, "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), state, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in own])
    sweep = Window.partitionBy(by, "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.unionByName(each).withColumn(state, F.last(state, ignorenulls=True).over(sweep)).where("kind = 1").drop("kind", "salt")


def url_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's path;
    of several the longest rule string wins, then the longer host; of one rule given twice, block wins over allow.
    Rules with a null host, path or verdict are ignored. Urls that no rule fits (null and empty ones and those
    without `://` too) get a null rule and the verdict `default`. Repeated rows each get their row; an empty table
    gives an empty result; other columns are ignored. A url of any length is judged whole.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
    rules = rules.agg(F.max("verdict").alias("verdict"))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("full"), path.alias("path"))

    # the rule hosts that each host of the urls is under; a host counts once, however many urls it has
    hosts = rows.where("full <> ''").groupBy("full").agg(F.count(F.lit(1)).alias("urls")).select("full", _top("full").alias("top"), host_key("full").alias("key"))
    under = _swept(hosts, _host_events(rules.select("host").distinct()), "top", "stack").where(F.size("stack") > 0).select(F.col("full").alias("of"), F.explode("stack").alias("host"))
    under = written(under, "url-hosts")
    met, under = salted(rows.select("page_id", "url", "full", "path"), under.select(F.col("of").alias("full"), "host"), "full", "url")
    probes = met.join(under, ["full", "salt"]).select("page_id", "url", "host", F.concat(host_key("host"), F.encode("path", "UTF-8")).alias("key"))
    found = _swept(probes, _path_events(rules), "host", "state").where("state.rule is not null").select(
        "page_id", "url", F.lit(0).alias("n"), F.struct(F.length("state.rule").alias("len"), F.length("host").alias("of_host"), "state.rule", "state.verdict").alias("best")
    )
    own = F.lit(None).cast("struct<len:int,of_host:int,rule:string,verdict:string>")
    every = rows.select("page_id", F.col("url").cast("string").alias("url"), F.lit(1).alias("n"), own.alias("best"))
    out = every.unionByName(found).groupBy("page_id", "url").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    host, path = host_and_path(F.col("url"))
    return out.select(
        "page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("array_repeat(0, int(n))")).alias("i"),
    ).drop("i")
