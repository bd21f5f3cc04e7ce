"""URL filter: reversed-host keys with a sorted sweep of paths against nested rule intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from prunescan.llm.common import cut, fresh, stored


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by U+0001: a domain's subdomains are exactly the keys that start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def path_key(path: Column) -> Column:
    """The path's bytes in hexadecimal: they sort alike, and ``G`` put after a prefix sorts behind all that starts with it."""
    return F.hex(path)


def _above(host: Column, deepest: int) -> Column:
    """The keys of a host and of all domains above it, those of at most ``deepest`` labels."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "\x01"), F.lit("\x01")))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, verdict)."""
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _events(rules: DataFrame) -> DataFrame:
    """Interval ends of the rules' paths within their host: ``domain, key, top`` (the innermost active rule from there).

    A rule's interval holds the paths that start with its own, so the intervals of a host nest or are apart. At
    its start the rule is pushed; at its end it is popped, and the top of the stack is the rule of the longest
    proper prefix, which is looked up by the prefixes of the rule's path.
    """
    own = F.struct(F.length("rule").alias("n"), "rule", "verdict")
    r = rules.select("domain", "rule_path", own.alias("top"))
    up = r.filter("rule_path <> ''").select("domain", "rule_path", F.explode(F.expr("sequence(0, length(rule_path) - 1)")).alias("k"))
    up = up.select("domain", F.expr("left(rule_path, k)").alias("rule_path"), F.col("rule_path").alias("inner"))
    outer = up.join(r, ["domain", "rule_path"]).groupBy("domain", "inner").agg(F.max_by("top", F.length("rule_path")).alias("outer"))
    none = F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    both = r.join(outer.withColumnRenamed("inner", "rule_path"), ["domain", "rule_path"], "left")
    ends = F.array(
        F.struct(path_key(F.col("rule_path")).alias("key"), F.col("top").alias("top")),
        F.struct(F.concat(path_key(F.col("rule_path")), F.lit("G")).alias("key"), F.coalesce("outer", none).alias("top")),
    )
    return both.select("domain", F.inline(ends))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sweep_rows: int = 1 << 20, sent_hosts: int = 100_000, salts: int = 16) -> DataFrame:
    """Judge every row's url by the longest rule that fits: the input columns and ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``rule_host``, ``rule_path``, ``verdict``. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest rule (host and path as written) wins, the smaller text at a tie;
    equal rules count once, ``block`` before ``allow``. Rules with a null host, path or verdict are ignored;
    a rule's host is lower-cased.

    Each different url stands once under the reversed-host key of every domain above it that has rules. Under one key
    the rules are intervals of paths: urls and interval ends are merged in the order of their paths, and one sweep
    carries the top of the stack of active nested rules to every url. A key's urls are dealt into sweeps of at most
    ``sweep_rows`` urls, or as many as the key has rules; its rules go to its own sweeps only, so there are never
    more interval ends than urls and rules, and a hot domain is many tasks. The table of keys is sent to all tasks up
    to ``sent_hosts`` rule hosts, beyond it is joined by a shuffle. What is found goes back to the rows by a join
    over ``salts`` copies of it, so that one url may hold any share of the rows.

    A null url, one without ``://`` or an empty one has host and path empty and fits no rule but one of an empty
    host and path: ``default``. Repeated rows stay. Input columns named like an output column are replaced. No
    rules or no rows: the same columns, ``default`` throughout, or no rows.
    """
    out = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    salt, best = fresh([*pages.columns, "host", "path", "rule", "verdict"], "salt", "best")
    rules = rules.filter("rule_host is not null and rule_path is not null and verdict is not null").select(F.lower("rule_host").alias("rule_host"), "rule_path", "verdict")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.concat("rule_host", "rule_path"))
    rules = cut(rules.select(host_key(F.col("rule_host")).alias("domain"), "rule_path", "rule", "verdict"))
    domains = rules.groupBy("domain").agg(F.count("*").alias("rules"))
    size = domains.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("domain", "\x01")) - 1), F.lit(1)).alias("deepest")).first()
    sent = F.broadcast if size.n <= sent_hosts else lambda side: side

    judged = pages.select(*out, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = judged.select("host", "path").distinct().select("host", "path", F.explode(_above(F.col("host"), size.deepest)).alias("domain"))
    urls = stored(urls.join(sent(domains.select("domain")), "domain"))
    many = urls.groupBy("domain").agg(F.count("*").alias("urls")).join(domains, "domain")
    many = many.select("domain", F.ceil(F.col("urls") / F.greatest(F.lit(sweep_rows), "rules")).alias("sweeps"))
    part, end = F.pmod(F.xxhash64("host", "path"), F.col("sweeps")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sweeps") - 1))
    rows = urls.join(sent(many), "domain").select("domain", part.alias("sweep"), path_key(F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path")
    events = _events(rules).join(sent(many), "domain").select("domain", end.alias("sweep"), "key", F.lit(0).alias("kind"), "top")
    sweep = Window.partitionBy("domain", "sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(events, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).filter("kind = 1 and top.rule is not null")
    found = swept.groupBy("host", "path").agg(F.min(F.struct((-F.col("top.n")).alias("n"), "top.rule", "top.verdict")).alias(best))
    found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    judged = judged.withColumn(salt, (F.monotonically_increasing_id() % salts).cast("int")).join(found, ["host", "path", salt], "left")
    return judged.select(*out, "host", "path", F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))
