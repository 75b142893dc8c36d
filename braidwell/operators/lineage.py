"""Evidence lineage: locators, parent edges, the root walk and independence. All joins are by key; nothing loops over rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwell.shared import saved

MAX_DEPTH = 4


def split_locator(locator: Column) -> tuple[Column, Column]:
    """(source, local) of ``source:local``; only the first colon separates."""
    at = F.instr(locator, ":")
    return F.when(at > 1, F.substring(locator, F.lit(1), at - 1)), F.when(at > 1, F.substring(locator, at + 1, F.length(locator)))


def self_root(uid: Column, local: Column) -> Column:
    return F.concat(uid, F.lit(":"), local)


def resolve(locators: DataFrame, sources: DataFrame, column: str = "locator") -> DataFrame:
    """Adds uid, root and reason: a locator may name its source by id or uid; unknown ones get a reason."""
    source, local = split_locator(F.col(column))
    names = sources.select(F.explode(F.array_distinct(F.array("source_id", "source_uid"))).alias("__name"), F.col("source_uid").alias("uid"))
    out = locators.withColumn("__source", source).withColumn("__local", local).join(names, F.col("__source") == F.col("__name"), "left")
    out = out.withColumn("root", self_root(F.col("uid"), F.col("__local"))).withColumn("reason", F.when(F.col("uid").isNull(), F.lit("source_not_configured")))
    return out.drop("__source", "__local", "__name")


def parent_edges(candidates: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, child, parent, ord) of the edges that resolve, and (query_id, child, locator) of those dropped."""
    edges = candidates.select("query_id", self_root(F.col("source_uid"), F.col("local")).alias("child"), F.posexplode("derived_from").alias("ord", "locator"))
    resolved = resolve(edges, sources)
    return resolved.where("root IS NOT NULL").select("query_id", "child", F.col("root").alias("parent"), "ord"), resolved.where("root IS NULL").select("query_id", "child", "locator")


def parents_of(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., __at, __parents): every child's distinct parents in order."""
    return edges.groupBy(*by, F.col("child").alias("__at")).agg(F.array_sort(F.collect_set("parent")).alias("__parents"))


def roots(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """Adds root, depth, reason and ancestors to nodes (by..., node)."""
    by = by or []
    return walked(nodes, nodes.select(*by, F.col("node").alias("__at")).distinct().join(parents_of(edges, by), [*by, "__at"]), by, depth)


def walked(nodes: DataFrame, pool: DataFrame, by: list[str], depth: int = MAX_DEPTH) -> DataFrame:
    """``roots`` of nodes (with any further columns) over ``pool``: ``parents_of`` those of them that have parents.

    A single parent is followed while it is in the pool; several make the record composite: the walk stops there
    and they are its ancestors. A walk that returns to a node ends at the smallest node seen, past ``depth`` steps
    it is cut. One join per step. What a step may look up is written before it: first the nodes that have parents, then those
    of them that were parents of the last. These tables shrink upwards and their size is known, so few hubs that many nodes lead
    to are broadcast; without a node to look up the walk is over. A node that has stopped looks for a key of its own: stopped
    nodes don't gather in one task.
    """
    reached = saved(pool)
    walk = nodes.withColumn("root", F.col("node")).withColumn("depth", F.lit(0)).withColumn("reason", F.lit(None).cast("string"))
    walk = walk.withColumn("ancestors", F.array().cast("array<string>")).withColumn("__path", F.array("node")).withColumn("__on", F.lit(True))
    for step in range(1, depth + 2):
        if reached.isEmpty():
            break
        at = walk.withColumn("__at", F.when(F.col("__on"), F.col("root")).otherwise(F.concat(F.lit("\0"), "node")))
        at = at.join(reached, [*by, "__at"], "left")
        n = F.coalesce(F.size("__parents"), F.lit(0))
        one = F.col("__on") & (n == 1)
        parent = F.get("__parents", F.lit(0))
        cycle = one & F.array_contains("__path", parent)
        cut = one & ~cycle & F.lit(step > depth)
        go = one & ~cycle & ~cut
        many = F.col("__on") & (n > 1)
        walk = at.select(
            *[c for c in nodes.columns],
            F.when(cycle, F.array_min("__path")).when(go, parent).otherwise(F.col("root")).alias("root"),
            F.when(go, step).otherwise(F.col("depth")).alias("depth"),
            F.when(cycle, F.lit("cycle")).when(cut, F.lit("max_depth")).otherwise(F.col("reason")).alias("reason"),
            F.when(many, F.col("__parents")).otherwise(F.col("ancestors")).alias("ancestors"),
            F.when(go, F.concat("__path", F.array(parent))).otherwise(F.col("__path")).alias("__path"),
            go.alias("__on"),
        )
        if step <= depth:
            up = reached.where(F.size("__parents") == 1).select(*by, F.get("__parents", F.lit(0)).alias("__at")).distinct()
            reached = saved(reached.join(up, [*by, "__at"], "left_semi"))
    return walk.drop("__path", "__on")


def source_derivation(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_derives_from: the uid of the source that a record's source derives from, if the record has no edges."""
    names = sources.select(F.col("source_uid").alias("__uid"), F.col("derives_from").alias("__from"))
    up = sources.select(F.explode(F.array_distinct(F.array("source_id", "source_uid"))).alias("__from"), F.col("source_uid").alias("source_derives_from")).distinct()
    joined = nodes.join(names, F.col("source_uid") == F.col("__uid"), "left").join(up, "__from", "left")
    none = F.coalesce(F.size("derived_from"), F.lit(0)) <= 0
    return joined.withColumn("source_derives_from", F.when(none, F.col("source_derives_from"))).drop("__uid", "__from")


def independent(lineages: list[dict]) -> int:
    """How many roots stand on their own: no ancestor among the roots, no upstream source among their sources.

    A lineage is root, depth, ancestors and source_derives_from; of equal roots the least deep one counts.
    """
    best: dict[str, dict] = {}
    for one in lineages:
        if one["root"] not in best or one["depth"] < best[one["root"]]["depth"]:
            best[one["root"]] = one
    present = {one["root"].split(":", 1)[0] for one in lineages}
    return sum(not any(a in best for a in one["ancestors"]) and not (one["source_derives_from"] and one["source_derives_from"] in present) for one in best.values())


def derivation_cycles(derives: Mapping[str, str]) -> list[list[str]]:
    """Cycles among configured source derivations, each once, from its smallest member on."""
    found = set()
    for start in derives:
        path, at = [], start
        while at in derives and at not in path:
            path.append(at)
            at = derives[at]
        if at in path:
            loop = path[path.index(at) :]
            k = loop.index(min(loop))
            found.add(tuple(loop[k:] + loop[:k]))
    return [list(c) for c in sorted(found)]
