"""Which entities are the same: by name, by alias, by similar vectors. The result is rows of a merge log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.operators.lineage import cut
from siftwell.operators.merge_log import higher

LOG = ["merge_id", "survivor", "merged", "method"]


def rank(entity_id: str = "entity_id") -> Column:
    """Who survives: the measured, more confident one, with more sources, with the least id."""
    return F.struct(*higher(), F.coalesce("n_sources", F.lit(0)), -F.col(entity_id))


def measured(sources: DataFrame, entity_id: str = "entity_id") -> DataFrame:
    """Confidence and number of source chunks of each entity."""
    return sources.groupBy(entity_id).agg(F.max("confidence").alias("confidence"), F.countDistinct("chunk_id").alias("n_sources"))


def keys(entities: DataFrame) -> DataFrame:
    """entity_id, type, key, is_name: what an entity (entity_id, type, name, aliases) answers to. Empty keys are left out."""
    each = F.explode(F.concat(F.array(F.struct(F.col("name").alias("text"), F.lit(True).alias("is_name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("text"), F.lit(False).alias("is_name")))))
    rows = entities.select("entity_id", "type", each.alias("k")).select("entity_id", "type", name_key(F.col("k.text")).alias("key"), "k.is_name")
    return rows.where("key <> ''").groupBy("entity_id", "type", "key").agg(F.max("is_name").alias("is_name"))


def components(links: DataFrame, *via: str) -> DataFrame:
    """entity_id, root: the least entity that can be reached through shared values of the `via` columns of `links` (entity_id, via).

    Rounds of least labels, with a jump to the label's label after each, so their number grows with the logarithm of the longest way.
    """
    links = cut(links.select("entity_id", *via).distinct())
    found = cut(links.groupBy("entity_id").agg(F.col("entity_id").alias("root")))
    while True:
        least = links.join(found, "entity_id").groupBy(*via).agg(F.min("root").alias("least"))
        near = links.join(least, list(via)).groupBy("entity_id").agg(F.min("least").alias("least"))
        step = found.join(near, "entity_id").select("entity_id", "root", F.least("root", "least").alias("next"))
        up = step.select(F.col("entity_id").alias("next"), F.col("next").alias("up"))
        step = cut(step.join(up, "next", "left").select("entity_id", F.coalesce("up", "next").alias("root"), (F.coalesce("up", "next") != F.col("root")).alias("moved")))
        found = step.select("entity_id", "root")
        if step.where("moved").isEmpty():
            return found


def numbered(merges: DataFrame, after: int = 0) -> DataFrame:
    """merge_id, survivor, merged, method: ids after `after`, in order of survivor and merged."""
    rows = cut(merges.orderBy("survivor", "merged").withColumn("merge_id", F.monotonically_increasing_id() + after + 1))
    return rows.select(*LOG)


def last_id(log: DataFrame) -> int:
    return log.agg(F.max("merge_id").alias("n")).first()["n"] or 0


def _stage(units: DataFrame, stats: DataFrame, group: list[str], method: str) -> DataFrame:
    """survivor, merged, method within groups of units (entity_id, group)."""
    ranked = units.join(stats, "entity_id", "left")
    best = ranked.groupBy(*group).agg(F.max_by("entity_id", rank()).alias("survivor"), F.count("*").alias("n")).where("n > 1")
    return units.join(best, group).where("entity_id <> survivor").select("survivor", F.col("entity_id").alias("merged"), F.lit(method).alias("method"))


def by_name(entities: DataFrame, sources: DataFrame, after: int = 0) -> DataFrame:
    """The log of merges of entities of one type with equal names, then of those that share an alias with a name or an alias, until no two do.

    entities (entity_id, type, name, aliases), sources (entity_id, chunk_id, confidence). After a merge its survivor answers to all that either did, so
    what is merged in the end are components of entities and keys. The survivor of a component is the best by what its parts have before that stage.
    """
    known = cut(keys(entities))
    exact = numbered(_stage(known.where("is_name").select("entity_id", "type", "key"), measured(sources), ["type", "key"], "exact"), after)
    unit = exact.select(F.col("merged").alias("entity_id"), "survivor")
    to_units = lambda t: t.join(unit, "entity_id", "left").withColumn("entity_id", F.coalesce("survivor", "entity_id")).drop("survivor")
    found = components(to_units(known), "type", "key")
    alias = _stage(found, measured(to_units(sources)), ["root"], "alias")
    return exact.unionByName(numbered(alias, last_id(exact) or after))


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs (a, b, similarity) that are taken by falling similarity, then least smaller id, then least larger id, each entity at most
    once: what one would get going through the sorted list.

    In each round every pair is taken that comes first for both of its entities; what is left of them goes. The first pair of all is always
    among them, so it ends. A pair counts once, with its highest similarity, in either order; pairs of an entity with itself don't count.
    """
    both = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    left, taken = cut(both), []
    while not left.isEmpty():
        place = F.struct(-F.col("similarity"), "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("entity"), place.alias("place"))
        first = ends.groupBy("entity").agg(F.min("place").alias("first"))
        mutual = first.groupBy("first").count().where("count = 2").select(F.col("first.a").alias("a"), F.col("first.b").alias("b"), (-F.col("first.col1")).alias("similarity"))
        taken.append(cut(mutual))
        gone = cut(taken[-1].select(F.explode(F.array("a", "b")).alias("entity")))
        for end in ("a", "b"):
            left = left.join(gone.select(F.col("entity").alias(end)), end, "left_anti")
        left = cut(left.select("a", "b", "similarity"))
    return reduce(DataFrame.unionByName, taken) if taken else both


def by_similarity(pairs: DataFrame, stats: DataFrame, after: int = 0) -> DataFrame:
    """The log of merges of matched pairs (a, b, similarity): one for each entity at most, so that two are never joined through a third. stats: `measured`."""
    matched = greedy_matching(pairs)
    units = matched.select(F.struct("a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("entity_id"))
    return numbered(_stage(units, stats, ["pair"], "embedding"), after)
