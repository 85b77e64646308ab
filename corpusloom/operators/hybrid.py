"""Hybrid retrieval with validity in time, candidate pools, reranking, expansion and typed walks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import expand
from .ranking import in_force, reciprocal_rank_fusion, top_per_query

MODES = ("skip_without_date", "strict_today_default", "always_skip")


def hybrid_retrieve(dense: DataFrame, sparse: DataFrame, items: DataFrame, laws: DataFrame, repeals: DataFrame, dates: DataFrame, ident: str, k: int = 50, mode: str = "skip_without_date", constant: int = 60) -> tuple[DataFrame, DataFrame]:
    """(fused, audit): two ranked channels kept to laws in force, ranked again and fused.

    ``items`` gives each candidate's law and article, ``dates`` (query_id, date) each query's date,
    null if it names none: then no law is left out, or those not in force today under
    ``strict_today_default``. ``always_skip`` leaves none out ever. The audit has, for each query,
    the sizes of all steps and the articles of each in order, each article once.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    when = {"skip_without_date": F.col("date"), "strict_today_default": F.coalesce("date", F.current_date()), "always_skip": F.lit(None).cast("date")}[mode]
    asked = dates.select("query_id", when.alias("date"))
    channels = {"dense": dense, "sparse": sparse}
    told = {n: c.select("query_id", ident, "score", "rank").join(items.select(ident, "law", "article"), ident) for n, c in channels.items()}
    kept = {n: in_force(c, laws, repeals, asked) for n, c in told.items()}
    again = [top_per_query(c.drop("rank"), ident, 2**31 - 1) for c in kept.values()]
    fused = reciprocal_rank_fusion(again, ident, k, constant)
    step = lambda df, name, order: df.select("query_id", F.lit(name).alias("step"), ident, "article", order.alias("order"))
    steps = step(told["dense"], "dense", F.col("rank")).unionByName(step(told["sparse"], "sparse", F.col("rank")))
    steps = steps.unionByName(step(kept["dense"], "post_temporal", F.col("rank"))).unionByName(step(kept["sparse"], "post_temporal", F.col("rank") + 1_000_000))
    steps = steps.unionByName(step(fused.join(items.select(ident, "article"), ident), "fused", F.col("rank")))
    # a query's candidates are bounded by the channels' sizes
    listed = lambda n: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("step") == n, F.struct("order", "article")))), lambda x: x["article"])).alias(f"{n}_articles")
    count = lambda n: F.count_distinct(F.when(F.col("step") == n, F.col(ident))).alias(f"n_{n}")
    names = ("dense", "sparse", "post_temporal", "fused")
    audit = steps.groupBy("query_id").agg(*(count(n) for n in names), *(listed(n) for n in names), F.count_distinct(ident).alias("_all"))
    audit = audit.withColumn("n_dropped_by_temporal", F.col("_all") - F.col("n_post_temporal")).drop("_all")
    return fused, audit.join(asked.withColumnRenamed("date", "event_date"), "query_id", "left")


def candidate_pool(seeds: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(query_id, id, article, text, source): seeds, and neighbours with a text whose article no seed has."""
    new = neighbours.where(F.coalesce(F.trim("text"), F.lit("")) != "").join(seeds.select("query_id", "article").distinct(), ["query_id", "article"], "left_anti")
    columns = ["query_id", "id", "article", "text"]
    return seeds.select(*columns, F.lit("seed").alias("source")).unionByName(new.select(*columns, F.lit("neighbour").alias("source")).dropDuplicates(["query_id", "id"]))


def rerank(pool: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The ``k`` best of each query by the logistic of ``scorer``'s ``logit``; any model that adds that column will do."""
    scored = scorer(pool).withColumn("score", F.round(1 / (1 + F.exp(-F.col("logit"))), 6)).drop("logit")
    return top_per_query(scored, "id", k)


def expand_hits(hits: DataFrame, edges: DataFrame, types: list[str], hops: int = 1, per_seed: int | None = None, undirected: bool = False) -> DataFrame:
    """(query_id, seed, node, hop): what hits (query_id, id) reach over edges of ``types``; nearest first, then by id, if ``per_seed``."""
    seeds = hits.select(F.col("id").alias("seed")).distinct()
    found = expand(seeds, edges.where(F.col("type").isin(types)), hops, undirected)
    if per_seed:
        place = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "node"))
        found = found.withColumn("_p", place).where(F.col("_p") <= per_seed).drop("_p")
    return hits.select("query_id", F.col("id").alias("seed")).distinct().join(found, "seed").select("query_id", "seed", "node", "hop")


# What walks may use and how far they may go.
WALK_TYPES = ("REFERENCES", "REFERS_TO", "HAS_CLAUSE", "HAS_POINT", "HAS_ARTICLE", "IN_SECTION", "NEXT", "DEFINES", "AMENDS", "REPEALS", "REPLACES", "CITES_EXTERNAL")
WALK_HOPS, WALK_LIMIT = 3, 30


@dataclass(frozen=True)
class Step:
    """Along an edge of ``type``, with it or against it."""

    type: str
    reverse: bool = False


@dataclass(frozen=True)
class Walk:
    """A path of steps from seeds, and how many ends to keep for each query."""

    steps: tuple[Step, ...]
    limit: int = WALK_LIMIT

    def problems(self) -> list[str]:
        """Why the walk may not run; empty if it may."""
        out = [f"unknown edge type {s.type}" for s in self.steps if s.type not in WALK_TYPES]
        if not 1 <= len(self.steps) <= WALK_HOPS:
            out.append(f"a walk has 1 to {WALK_HOPS} steps")
        if not 1 <= self.limit <= WALK_LIMIT:
            out.append(f"a walk keeps 1 to {WALK_LIMIT} ends")
        if all(s.reverse for s in self.steps):
            out.append("a walk must lead outwards")
        return out


def walk(seeds: DataFrame, edges: DataFrame, path: Walk) -> DataFrame:
    """(query_id, node): ends of ``path`` from seeds (query_id, id) that are no seeds of the query; an invalid walk raises."""
    if wrong := path.problems():
        raise ValueError("; ".join(wrong))
    front = seeds.select("query_id", F.col("id").alias("node"))
    for s in path.steps:
        ways = edges.where(F.col("type") == s.type).select(F.col("dst" if s.reverse else "src").alias("node"), F.col("src" if s.reverse else "dst").alias("_to"))
        front = front.join(ways, "node").select("query_id", F.col("_to").alias("node")).distinct()
    ends = front.join(seeds.select("query_id", F.col("id").alias("node")), ["query_id", "node"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("node"))
    return ends.withColumn("_p", place).where(F.col("_p") <= path.limit).drop("_p")


def walk_retrieve(hits: DataFrame, edges: DataFrame, path: Walk, k: int = 12, fallback: Walk | None = None) -> DataFrame:
    """Ranked seeds (query_id, id, rank) fused with the ends of a walk, tagged ``seed``, ``walk`` or ``both``.

    A walk that isn't valid, and for each query one that ends nowhere, gives way to ``fallback``.
    """
    seeds = hits.select("query_id", "id")
    second = walk(seeds, edges, fallback) if fallback else None
    if path.problems():
        ends = second if second is not None else seeds.limit(0).withColumnRenamed("id", "node")
    else:
        ends = walk(seeds, edges, path)
        if second is not None:
            ends = ends.unionByName(second.join(ends.select("query_id").distinct(), "query_id", "left_anti"))
    order = Window.partitionBy("query_id").orderBy("node")
    found = ends.select("query_id", F.col("node").alias("id"), F.row_number().over(order).alias("rank"))
    fused = reciprocal_rank_fusion([hits.select("query_id", "id", "rank"), found], "id", k)
    tags = hits.select("query_id", "id", F.lit(1).alias("_s")).join(found.select("query_id", "id", F.lit(1).alias("_w")), ["query_id", "id"], "full_outer")
    tag: Column = F.when(F.col("_s").isNotNull() & F.col("_w").isNotNull(), "both").when(F.col("_s").isNotNull(), "seed").otherwise("walk")
    return fused.join(tags.select("query_id", "id", tag.alias("source")), ["query_id", "id"])


def logic_search(rules: DataFrame, predicate: str | None = None, topic: str | None = None) -> DataFrame:
    """Rules (id, predicate, text) of a predicate and/or whose text holds a topic, in any case."""
    out = rules
    if predicate:
        out = out.where(F.col("predicate") == predicate)
    return out.where(F.contains(F.lower("text"), F.lower(F.lit(topic)))) if topic else out


def optional_details(rules: DataFrame, conditions: DataFrame, entities: DataFrame) -> DataFrame:
    """Each rule (id, ...) with the sorted distinct (id, text) of its conditions and of its entities, empty lists without any."""
    sets = lambda df, name: df.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("id", "text"))).alias(name)).withColumnRenamed("rule_id", "_r")
    out = rules
    for df, name in ((conditions, "conditions"), (entities, "entities")):
        side = sets(df, name)
        out = out.join(side, out["id"] == side["_r"], "left").drop("_r")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return out


def offset_limit(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
