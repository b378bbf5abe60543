"""What can be used of replies that list entities and relations: every item is judged by itself.

replies (reply_id, text). Only finding the JSON object is Python; items are judged as columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.json_text import json_object
from siftwell.functions.names import name_key
from siftwell.operators.lineage import cut, folder

# Types and relations; the type that an end of a relation must have where there can be no other; words of a name at most.
ENTITY_TYPES = ["person", "team", "organisation", "project", "product", "document", "policy", "location"]
RELATIONS = ["REPORTS_TO", "MEMBER_OF", "BELONGS_TO", "OWNS", "WORKS_ON", "LOCATED_IN", "AUTHORED", "MENTIONS", "RELATED_TO"]
ENDS = {
    "REPORTS_TO source": "person", "REPORTS_TO target": "person", "MEMBER_OF source": "person", "MEMBER_OF target": "team", "WORKS_ON source": "person", "WORKS_ON target": "project", "LOCATED_IN target": "location",
}
NAME_WORDS = 6


@dataclass
class Salvaged:
    """entities (reply_id, name, key, entity_type, description, confidence, adopted), relations (reply_id, source, source_key, target, target_key, relation_type, description,
    confidence), and counts (reply_id, error, entities_dropped, relations_dropped, entities_adopted): a row a reply, null counts with an error."""

    entities: DataFrame
    relations: DataFrame
    counts: DataFrame


def _kind(item: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(item, path, "variant"))


def _text(item: Column, field: str) -> Column:
    """The field if it is a string."""
    return F.when(_kind(item, f"$.{field}") == "STRING", F.variant_get(item, f"$.{field}", "string"))


def _described(item: Column) -> tuple[Column, Column, Column]:
    """Description (empty if missing), confidence, and whether both are as they must be: a string, and a number from 0 to 1."""
    kind = _kind(item, "$.confidence")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.variant_get(item, "$.confidence", "double"))
    described = F.variant_get(item, "$.description", "variant").isNull() | (_kind(item, "$.description") == "STRING")
    return F.coalesce(_text(item, "description"), F.lit("")), number, described & number.between(0, 1)


def salvage(replies: DataFrame) -> Salvaged:
    """The valid items of each reply.

    An item needs strings that are names, a known type or relation, a confidence from 0 to 1, and a string as description if it has one. An end of a relation
    that isn't listed is adopted as an entity where the relation tells its type, all relations that name it agree, and it has at most NAME_WORDS words; it is
    spelt as first named and as sure as the least sure of them. A relation goes if an end isn't listed or adopted, is listed under several types, or is
    the other end. Null texts and texts without an object have an error, as have lists that aren't lists; missing relations are none.
    """
    path = folder(replies.sparkSession, "objects")  # found once, and compressed: the objects are read several times below
    replies.select("reply_id", json_object(F.col("text")).alias("object")).write.parquet(path)
    found = replies.sparkSession.read.parquet(path).select("reply_id", F.try_parse_json("object").alias("v"))
    kinds = found.select("reply_id", "v", _kind(F.col("v"), "$.entities").alias("e"), F.coalesce(_kind(F.col("v"), "$.relationships"), F.lit("ARRAY<VOID>")).alias("r"))
    listed = F.coalesce(F.startswith("e", F.lit("ARRAY")), F.lit(False)) & F.startswith("r", F.lit("ARRAY"))
    error = F.when(F.col("v").isNull(), "no JSON object found in the response").when(~listed, "entities and relationships must be lists")
    each = lambda path: F.coalesce(F.when(F.col("error").isNull(), F.variant_get(F.col("v"), path, "array<variant>")), F.array().cast("array<variant>"))
    rows = kinds.select("reply_id", "v", error.alias("error")).select("reply_id", "error", each("$.entities").alias("entities"), each("$.relationships").alias("relations"))

    item = F.col("item")
    description, confidence, fine = _described(item)
    entities = rows.select("reply_id", F.posexplode("entities").alias("pos", "item")).select("reply_id", "pos", _text(item, "name").alias("name"), _text(item, "entity_type").alias("entity_type"), description.alias("description"), confidence.alias("confidence"), fine.alias("fine"))
    entities = entities.where("fine").withColumn("key", name_key(F.col("name"))).where((F.col("key") != "") & F.col("entity_type").isin(ENTITY_TYPES)).drop("fine")
    entities = cut(entities)  # read several times below
    relations = rows.select("reply_id", F.posexplode("relations").alias("pos", "item")).select(
        "reply_id", "pos", *[_text(item, c).alias(c) for c in ("source", "target", "relation_type")], description.alias("description"), confidence.alias("confidence"), fine.alias("fine")
    )
    relations = relations.where("fine").withColumns({"source_key": name_key(F.col("source")), "target_key": name_key(F.col("target"))})
    relations = relations.where((F.col("source_key") != "") & (F.col("target_key") != "") & F.col("relation_type").isin(RELATIONS)).drop("fine")
    relations = cut(relations)

    types = entities.groupBy("reply_id", "key").agg(F.countDistinct("entity_type").alias("n_types"))
    end = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("name"), F.col(f"{role}_key").alias("key"))
    ends = relations.select("reply_id", "pos", "relation_type", "confidence", F.explode(F.array(end("source"), end("target"))).alias("end")).select("reply_id", F.struct("pos", "end.role").alias("place"), "relation_type", "confidence", "end.*")
    must = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])[F.concat_ws(" ", "relation_type", "role")]
    ends = ends.withColumn("must", must).where(F.col("must").isNotNull() & (F.size(F.split("key", " ")) <= NAME_WORDS)).join(types, ["reply_id", "key"], "left_anti")
    adopted = ends.groupBy("reply_id", "key").agg(F.min_by("name", "place").alias("name"), F.collect_set("must").alias("musts"), F.min("confidence").alias("confidence")).where(F.size("musts") == 1)
    adopted = adopted.select("reply_id", F.regexp_replace("name", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("name"), "key", F.col("musts")[0].alias("entity_type"), F.lit("").alias("description"), "confidence", F.lit(True).alias("adopted"))

    known = types.where("n_types = 1").select("reply_id", "key").unionByName(adopted.select("reply_id", "key"))
    kept = relations.where("source_key <> target_key")
    for role in ("source", "target"):
        kept = kept.join(known.select("reply_id", F.col("key").alias(f"{role}_key")), ["reply_id", f"{role}_key"], "left_semi")

    count = lambda t, name: t.groupBy("reply_id").agg(F.count("*").alias(name))
    counts = rows.select("reply_id", "error", F.size("entities").alias("n_e"), F.size("relations").alias("n_r"))
    for part in (count(entities, "k_e"), count(kept, "k_r"), count(adopted, "k_a")):
        counts = counts.join(part, "reply_id", "left")
    number = lambda c: F.when(F.col("error").isNull(), c.cast("long"))
    have = lambda c: F.coalesce(c, F.lit(0))
    counts = counts.select("reply_id", "error", number(F.col("n_e") - have("k_e")).alias("entities_dropped"), number(F.col("n_r") - have("k_r")).alias("relations_dropped"), number(have("k_a")).alias("entities_adopted"))
    names = ["reply_id", "name", "key", "entity_type", "description", "confidence"]
    return Salvaged(
        entities.select(*names, F.lit(False).alias("adopted")).unionByName(adopted.select(*names, "adopted")),
        kept.select("reply_id", "source", "source_key", "target", "target_key", "relation_type", "description", "confidence"), counts,
    )
