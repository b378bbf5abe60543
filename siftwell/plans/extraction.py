"""Queries of salvage: each event is a reply that lists entities and relations, some fenced, prefaced, cut off or of another shape, with the event's props as their object."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftwell.operators import extraction as X
from siftwell.plans.registry import query, table

#: {user}, {type}, {value} and {k} stand for the event's own.
_BODY = (
    '{"entities": [{"name": "User {user}", "entity_type": "person", "confidence": {value}}, {"name": "{type} tool", "entity_type": "{kind}", "confidence": 0.7, "description": "of {type}"}, {"name": "...", "entity_type": "team", "confidence": 1}],'
    ' "props": {props}, "relationships": [{"source": "user {user}.", "target": "Lead {lead}", "relation_type": "REPORTS_TO", "confidence": 0.6}, {"source": "Lead {lead}", "target": "{type} tool", "relation_type": "OWNS", "confidence": 0.8},'
    ' {"source": "USER {user}", "target": "(User {user})", "relation_type": "RELATED_TO", "confidence": 0.5}, {"source": "User {user}", "target": "Place", "relation_type": "LOCATED_IN", "confidence": "0.5"}]'
)
_SHAPES = ["{b}}", "Sure! {b}} That is all.", "```json\n{b}}\n``` as asked", "I can say nothing about that.", "{b}", '{"entities": {k}}']
_VALUES = {"user": "CAST(user_id AS VARCHAR)", "type": "event_type", "value": "CAST(floor(value) / 100 AS VARCHAR)", "kind": "CASE WHEN event_id % 4 = 0 THEN 'gadget' ELSE 'product' END", "props": "props", "lead": "CAST(user_id % 10 AS VARCHAR)", "k": "CAST(event_id AS VARCHAR)"}


def _filled(text: str, value, b) -> list:
    """The text in pieces, with the values in their places."""
    out = []
    for piece in re.split(r"(\{b\}|\{(?:" + "|".join(_VALUES) + r")\})", text):
        if piece == "{b}":
            out += b
        elif piece[1:-1] in _VALUES:
            out.append(value(piece[1:-1]))
        elif piece:
            out.append(piece)
    return out


def _sql_text() -> str:
    quote = lambda p: p[0] if isinstance(p, tuple) else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    join = lambda parts: " || ".join(map(quote, parts))
    value = lambda name: (_VALUES[name],)
    body = _filled(_BODY, value, [])
    return "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {join(_filled(shape, value, body))}" for i, shape in enumerate(_SHAPES)) + " END"


def _replies(spark, sf_dir):
    column = {"user": F.col("user_id").cast("string"), "type": F.col("event_type"), "value": (F.floor("value") / 100).cast("string"), "kind": F.when(F.col("event_id") % 4 == 0, "gadget").otherwise("product"), "props": F.col("props"), "lead": (F.col("user_id") % 10).cast("string"), "k": F.col("event_id").cast("string")}
    join = lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = _filled(_BODY, column.__getitem__, [])
    text = F.lit(None)
    for i, shape in enumerate(_SHAPES):
        text = F.when(F.col("event_id") % 6 == i, join(_filled(shape, column.__getitem__, body))).otherwise(text)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("reply_id"), text.alias("text"))


_KEYS = r"trim(regexp_replace(regexp_replace(lower({c}), '[.,;:!? ]+$', ''), '^\((.*)\)$', '\1'))"
_ITEMS = f"""t AS (SELECT event_id AS reply_id, {_sql_text()} AS text FROM events),
 o AS (SELECT reply_id, CASE WHEN json_valid(regexp_extract(text, '\\{{.*\\}}', 0, 's')) THEN regexp_extract(text, '\\{{.*\\}}', 0, 's') END AS o FROM t),
 ok AS (SELECT * FROM o WHERE json_type(o, '$.entities') = 'ARRAY'),
 ei AS (SELECT reply_id, unnest(from_json(json_extract(o, '$.entities'), '["JSON"]')) AS i FROM ok),
 en AS (SELECT reply_id, i->>'$.name' AS name, {_KEYS.format(c="i->>'$.name'")} AS key, i->>'$.entity_type' AS entity_type, CAST(i->>'$.confidence' AS DOUBLE) AS confidence FROM ei WHERE CAST(i->>'$.confidence' AS DOUBLE) BETWEEN 0 AND 1 AND i->>'$.entity_type' IN ('person', 'team', 'product') AND {_KEYS.format(c="i->>'$.name'")} <> ''),
 ri AS (SELECT reply_id, unnest(from_json(json_extract(o, '$.relationships'), '["JSON"]')) AS i FROM ok),
 re AS (SELECT reply_id, i->>'$.source' AS source, i->>'$.target' AS target, {_KEYS.format(c="i->>'$.source'")} AS sk, {_KEYS.format(c="i->>'$.target'")} AS tk, i->>'$.relation_type' AS rel, CAST(i->>'$.confidence' AS DOUBLE) AS confidence FROM ri WHERE json_type(i, '$.confidence') <> 'VARCHAR'),
 ad AS (SELECT reply_id, u.k AS key, any_value(u.n) AS name, min(confidence) AS confidence FROM re, unnest([{{'k': sk, 'n': source}}, {{'k': tk, 'n': target}}]) AS x(u) WHERE rel = 'REPORTS_TO' AND (reply_id, u.k) NOT IN (SELECT (reply_id, key) FROM en) GROUP BY 1, 2),
 kn AS (SELECT DISTINCT reply_id, key FROM en UNION SELECT reply_id, key FROM ad),
 kr AS (SELECT * FROM re WHERE sk <> tk AND (reply_id, sk) IN (SELECT (reply_id, key) FROM kn) AND (reply_id, tk) IN (SELECT (reply_id, key) FROM kn))"""


@query(
    "gr01_salvage_counts",
    f"""WITH {_ITEMS}, n AS (SELECT reply_id, (SELECT count(*) FROM ei WHERE ei.reply_id = ok.reply_id) - (SELECT count(*) FROM en WHERE en.reply_id = ok.reply_id) AS entities_dropped,
      (SELECT count(*) FROM ri WHERE ri.reply_id = ok.reply_id) - (SELECT count(*) FROM kr WHERE kr.reply_id = ok.reply_id) AS relations_dropped, (SELECT count(*) FROM ad WHERE ad.reply_id = ok.reply_id) AS entities_adopted FROM ok)
    SELECT reply_id, CASE WHEN o IS NULL THEN 'no JSON object found in the response' WHEN entities_dropped IS NULL THEN 'entities and relationships must be lists' END AS error, coalesce(entities_dropped, -1) AS entities_dropped, coalesce(relations_dropped, -1) AS relations_dropped, coalesce(entities_adopted, -1) AS entities_adopted FROM o LEFT JOIN n USING (reply_id)""",
)
def salvage_counts(spark, sf_dir):
    """Counts of replies with an error are -1."""
    return X.salvage(_replies(spark, sf_dir)).counts.na.fill(-1)


@query("gr01_salvaged_entities", f"WITH {_ITEMS} SELECT reply_id, name, key, entity_type, confidence, false AS adopted FROM en UNION ALL SELECT reply_id, trim(name), key, 'person', confidence, true FROM ad")
def salvaged_entities(spark, sf_dir):
    return X.salvage(_replies(spark, sf_dir)).entities.drop("description")


@query("gr01_salvaged_relations", f"WITH {_ITEMS} SELECT reply_id, source, target, rel AS relation_type, confidence FROM kr")
def salvaged_relations(spark, sf_dir):
    return X.salvage(_replies(spark, sf_dir)).relations.select("reply_id", "source", "target", "relation_type", "confidence")
