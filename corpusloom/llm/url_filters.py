"""URL filters as a sort-merge range join of pages and nested rules.

A host becomes a canonical key, its labels reversed and each ended by a dot (``en.example.net`` is
``net.example.en.``), so that a rule's host and all its subdomains are the interval of keys from
``net.example.`` up to ``net.example/`` (the next byte). Intervals nest or are disjoint. Interval
bounds and pages are sorted together by range partitions; a sweep through each partition carries
the stack of rules that are open at the key, and what is open at a partition's start comes from
the partitions before it. A page then takes the longest rule on its stack whose path fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shield, unshield

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)  # neither host nor path holds ? or #
    return F.translate(F.regexp_extract(before, "(?s)^([^/]*)", 1), UPPER, LOWER), F.regexp_extract(before, "(?s)^[^/]*(.*)$", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def bounds(rules: DataFrame) -> DataFrame:
    """(_key, _stack): where an interval begins or ends, and the rules that are open from there on.

    The stack at a beginning holds the rules of the host and of every host above it, found by an
    equi-join on the key's prefixes; at an end, those above it. Rules without a host are left out;
    a rule that is given twice counts once, and block wins over allow for the same host and path.
    """
    r = rules.where(F.col("host").isNotNull()).groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    r = r.withColumn("_own", host_key(F.col("host")))
    entry = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("depth"), F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict"))
    entries = r.groupBy(F.col("_own").alias("_up")).agg(F.collect_list(entry).alias("_entries"))
    labels = F.split(F.expr("left(_own, length(_own) - 1)"), r"\.", -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    chain = r.select("_own").distinct().select("_own", F.explode(ups).alias("_up")).join(entries, "_up")
    above = F.when(F.col("_up") != F.col("_own"), F.col("_entries"))
    stacks = chain.groupBy("_own").agg(F.flatten(F.collect_list("_entries")).alias("_all"), F.flatten(F.collect_list(above)).alias("_above"))
    begins = stacks.select(F.col("_own").alias("_key"), F.col("_all").alias("_stack"))
    return begins.union(stacks.select(F.concat(F.expr("left(_own, length(_own) - 1)"), F.lit("/")), "_above"))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    ``rule`` is the longest fitting rule (its host and path, counted together; at equal length the
    longer host), else null; ``verdict`` is the rule's, else ``default``. Null urls and urls
    without ``://`` have an empty host and path and fit no rule. Columns with the names of the new
    ones are replaced; all others, and repeated rows, stay.
    """
    scratch = Scratch(df.sparkSession, "sweep")
    if url in ADDED:
        raise ValueError(f"column {url} would be replaced; rename it first")
    df, new = shield(df.drop(*ADDED))
    url = new.get(url, url)
    host, path = host_and_path(F.col(f"`{url}`"))
    pages = df.withColumns({"_host": host, "_path": path})
    pages = pages.withColumns({"_key": host_key(F.col("_host")), "_page": F.lit(True), "_tie": F.xxhash64(*(f"`{c}`" for c in df.columns))})
    edges = bounds(rules).withColumn("_page", F.lit(False))
    both = pages.unionByName(edges, allowMissingColumns=True)
    # whole rows take part in the order, so that a host with many pages spreads over partitions
    dealt = both.repartitionByRange("_key", "_page", "_path", "_tie").withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt)
    last = dealt.groupBy("_part").agg(F.max_by("_stack", F.when(~F.col("_page"), F.col("_key"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    sweep = Window.partitionBy("_part").orderBy("_key", "_page").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("_open", F.last("_stack", ignorenulls=True).over(sweep)).where("_page")
    swept = swept.join(F.broadcast(carried), "_part")
    fits = F.filter(F.coalesce("_open", "_carried"), lambda r: F.col("_path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["depth"], r["rule"], r["verdict"])))
    out = swept.withColumn("_best", best).select(
        *(f"`{c}`" for c in df.columns),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
    return unshield(out, new)
