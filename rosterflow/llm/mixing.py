"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are summed by membership pattern; a flow routes the words of
patterns to the quotas of their sources, where the k-th use of a word costs k - 1, so nothing is used twice while unused
words could be routed instead; then each pattern's share is taken from its documents in an order drawn by seed.

Only patterns, never documents, meet in a task: those of one component of sources that share documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow.llm.common import measured, numbered, word_count
from rosterflow.llm.ngram_join import components
from rosterflow.operators.joins import join_back
from rosterflow.session import written

REPEATS = 3


def sizes_of(docs: DataFrame, sources: Column, seed: int = 0) -> DataFrame:
    """Rows (doc_id, pattern, size, draw, row): the sources of each document in order, its words, its place in the lot.

    ``draw`` depends on id, text and seed alone, so that reruns agree; rows that repeat in both are interchangeable.
    """
    rows = docs.select(
        "doc_id", F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("pattern"),
        word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")


def named_sources(patterns: DataFrame) -> DataFrame:
    """Rows (source, source_size, place): all sources by code point, null last, and the words of their documents."""
    each = patterns.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    each = written(each.withColumn("unnamed", F.col("source").isNull()), "sources")
    return written(numbered(each, [], ["unnamed", "source"], "place").drop("unnamed"), "places")


def with_targets(sources: DataFrame, total: int, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target``: shares of ``total`` by ``weight``, none above ``repeats`` times ``source_size``.

    The excess of sources at their limit is shared by the others, until none is above.  The driver sees three sums
    a round.
    """
    limit, level, held = F.col("source_size") * repeats, 0.0, -1
    while True:
        full = F.col("weight") * level > limit
        said = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("full")).first()
        if said.full == held or not said.open:
            break
        held, level = said.full, max(total - said.spent, 0) / float(said.open)
    target = F.least(F.col("weight") * level, limit.cast("double")) if said.open else limit.cast("double")
    return sources.withColumn("target", target.cast("double"))


def route(sizes: list[int], members: list[list[int]], quotas: dict[int, int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources: quotas are met as far as can be, with fewest repetitions.

    Repetition is the only cost and rises with each use, so the cheapest paths are those that start at the lowest
    level: flows of level 1, 2, ... are made as large as they can be, one after the other.
    """
    need, flows = dict(quotas), [dict.fromkeys(m, 0) for m in members]
    givers: dict[int, list[int]] = {}
    for p, own in enumerate(members):
        for j in own:
            givers.setdefault(j, []).append(p)
    free = [0] * len(sizes)
    for _ in range(repeats):
        for p, own in enumerate(members):
            free[p] += sizes[p]
            for j in own:
                got = min(free[p], need[j])
                flows[p][j] += got
                free[p] -= got
                need[j] -= got
        while True:
            # Shortest way from a pattern with free words over sources and what others give them to an open quota.
            came: dict[int, tuple[int, int]] = {}
            ends, seen = None, {p for p in range(len(sizes)) if free[p]}
            wave = sorted(seen)
            while wave and ends is None:
                later = []
                for p in wave:
                    for j in members[p]:
                        if j in came:
                            continue
                        came[j] = p
                        if need[j]:
                            ends = j
                            break
                        for q in givers[j]:
                            if flows[q][j] and q not in seen:
                                seen.add(q)
                                came[-1 - q] = j
                                later.append(q)
                    if ends is not None:
                        break
                wave = later
            if ends is None:
                break
            way, j = [], ends
            while True:
                p = came[j]
                way.append((p, j))
                if -1 - p not in came:
                    break
                j = came[-1 - p]
            got = min(free[p], need[ends], *[flows[q][before] for (q, _), (_, before) in zip(way, way[1:])])
            for (q, to), after in zip(way, [*way[1:], None]):
                flows[q][to] += got
                if after is not None:
                    flows[q][after[1]] -= got
            free[p] -= got
            need[ends] -= got
    return flows


def routed(patterns: DataFrame, sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Rows (pattern, use): the words that the flow takes from each pattern, repeats counted.

    ``sources``: rows (source, place, target).  Sources that share documents form components, each its own flow.
    """
    member = join_back(patterns.select("pattern", F.explode("pattern").alias("source")), sources, ["source"])
    edges = patterns.where(F.size("pattern") > 1).groupBy("pattern").agg(F.first("size").alias("size"))
    ends = join_back(edges.select("pattern", F.explode("pattern").alias("source")), sources, ["source"])
    ends = ends.groupBy("pattern").agg(F.sort_array(F.collect_list("place")).alias("p"))
    pairs = ends.select(F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("x"),
                                               F.slice("p", F.lit(2), F.size("p") - 1).alias("y"))).alias("e")).select("e.x", "e.y")
    tied = components(pairs).withColumnRenamed("doc_id", "place")
    member = member.join(tied, "place", "left").withColumn("component", F.coalesce("component_id", "place"))
    own = member.groupBy("pattern").agg(
        F.min("component").alias("component"),
        F.sort_array(F.collect_list(F.struct("place", F.round("target").cast("long").alias("quota")))).alias("own"))
    flow = join_back(own, patterns.select("pattern", "size"), ["pattern"]).select(
        "component", "pattern", "size", F.col("own.place").alias("places"), F.col("own.quota").alias("quotas"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=[tuple(x) for x in rows["places"]]).sort_values("order")
        quotas = {int(j): int(q) for own, some in zip(rows["places"], rows["quotas"]) for j, q in zip(own, some)}
        flows = route([int(s) for s in rows["size"]], [[int(j) for j in own] for own in rows["places"]], quotas, repeats)
        return pd.DataFrame({"pattern": rows["pattern"], "use": [sum(f.values()) for f in flows]})

    return written(flow.groupBy("component").applyInPandas(solve, "pattern array<string>, use long"), "routed")


def selected(rows: DataFrame, patterns: DataFrame, use: DataFrame) -> DataFrame:
    """``rows`` of :func:`sizes_of` with ``taken``: whole uses of all documents of the pattern, then words of some.

    Documents are drawn in buckets, as many as the root of their number; only that bucket in which the words run
    out is put in order, and its last document gives as many words as are still missing.
    """
    plan = join_back(patterns, use, ["pattern"]).withColumn("use", F.coalesce("use", F.lit(0)))
    plan = plan.select("pattern", F.when(F.col("size") > 0, F.expr("use div size")).otherwise(F.lit(0)).alias("whole"),
                       F.when(F.col("size") > 0, F.expr("use % size")).otherwise(F.lit(0)).alias("rest"),
                       F.ceil(F.sqrt("docs")).cast("long").alias("buckets"))
    dealt = join_back(rows, measured(written(plan, "plan")), ["pattern"]).withColumn("bucket", F.pmod("draw", "buckets"))
    before = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum")).select(
        "pattern", "bucket", "sum", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    dealt = written(join_back(dealt, sums, ["pattern", "bucket"]), "dealt")
    cut = (F.col("base") < F.col("rest")) & (F.col("base") + F.col("sum") > F.col("rest"))
    plain = dealt.where(~cut).withColumn("extra", F.when(F.col("base") + F.col("sum") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    edge = numbered(dealt.where(cut), ["pattern"], ["draw", "size", "row"], "at")
    alike = edge.groupBy("pattern", "draw", "size").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("pattern").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    alike = alike.select("pattern", "draw", "size", "first", F.coalesce(F.sum(F.col("n") * F.col("size")).over(earlier), F.lit(0)).alias("inner"))
    left = F.col("rest") - F.col("base") - F.col("inner") - (F.col("at") - F.col("first")) * F.col("size")
    edge = join_back(edge, alike, ["pattern", "draw", "size"]).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    kept = ["doc_id", "pattern", "size", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")]
    return plain.select(*kept).unionByName(edge.select(*kept))


def mix(docs: DataFrame, sources: Column, weigh, seed: int = 0, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """Mixes documents (doc_id, text) into as many words as they hold, with sources near their targets.

    ``sources``: array of source names of a document, null being a source of its own; a document of no source is not
    taken.  ``weigh(places)`` gives a table (source, source_size, place) the column ``weight``.

    Returns rows (doc_id, pattern, size, taken) and the table (source, source_size, place, weight, target).  No document
    is taken more than ``repeats`` times.  A null text has no words.  Repeated rows are documents of their own, all of
    which are taken alike but for those in which the words run out.
    """
    rows = sizes_of(docs, sources, seed)
    patterns = written(rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), "patterns")
    places = weigh(named_sources(patterns))
    total = patterns.where(F.size("pattern") > 0).agg(F.sum("size")).first()[0] or 0
    aims = written(with_targets(places, total, repeats), "targets")
    return selected(rows, patterns, routed(patterns, aims.select("source", "place", "target"), repeats)), aims


def mixed(docs: DataFrame, seed: int = 0, repeats: int = REPEATS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for documents of one ``source`` each, weighted 5, 2, 1, 5, ..."""
    places = F.element_at(F.array(*map(F.lit, (5, 2, 1))), (F.pmod(F.col("place") - 1, F.lit(3)) + 1).cast("int"))
    rows, aims = mix(docs, F.array("source"), lambda found: found.withColumn("weight", places), seed, repeats)
    rows = rows.withColumn("source", F.element_at("pattern", 1))
    return join_back(rows, measured(aims), ["source"]).select("doc_id", "size", "source_size", "target", "taken")
