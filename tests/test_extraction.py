import json
import math
import random
import re

from siftwell.functions.json_text import json_object
from siftwell.operators import extraction as X
from tests.test_resolution import key


def objects(text):
    """All candidates by counting braces one character at a time."""
    found = [b.strip() for b in re.findall(r"```(?:json)?\s*(.*?)```", text or "", re.DOTALL)]
    depth, begun = 0, None
    for i, c in enumerate(text or ""):
        if c == "{":
            begun = i if depth == 0 else begun
            depth += 1
        if c == "}":
            depth -= 1
            if depth == 0 and begun is not None:
                found.append(text[begun : i + 1])
                begun = None
    for f in found:
        try:
            x = json.loads(f)
        except ValueError:
            continue
        if isinstance(x, dict):
            return x
    return None


def brute(text):
    """entities and relations as sets, and error or counts."""
    x = objects(text)
    if x is None:
        return None, None, "no JSON object found in the response"
    es, rs = x.get("entities"), x.get("relationships", [])
    if not isinstance(es, list) or not isinstance(rs, list):
        return None, None, "entities and relationships must be lists"
    name = lambda v: isinstance(v, str) and key(v) != ""
    sure = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and 0 <= v <= 1
    fine = lambda i: isinstance(i, dict) and sure(i.get("confidence")) and isinstance(i.get("description", ""), str)
    good = [e for e in es if fine(e) and name(e.get("name")) and e.get("entity_type") in X.ENTITY_TYPES]
    rels = [r for r in rs if fine(r) and name(r.get("source")) and name(r.get("target")) and r.get("relation_type") in X.RELATIONS]
    types = {}
    for e in good:
        types.setdefault(key(e["name"]), set()).add(e["entity_type"])
    listed, asked = set(types), {}
    for r in rels:
        for role in ("source", "target"):
            k, must = key(r[role]), X.ENDS.get(f"{r['relation_type']} {role}")
            if k not in listed and must and len(k.split()) <= 6:
                asked.setdefault(k, []).append((r[role].strip(), must, r["confidence"]))
    taken = {k: v for k, v in asked.items() if len({m for _, m, _ in v}) == 1}
    for k, v in taken.items():
        types[k] = {v[0][1]}
    kept = [r for r in rels if key(r["source"]) != key(r["target"]) and all(len(types.get(key(r[e]), ())) == 1 for e in ("source", "target"))]
    entities = sorted([(e["name"], e["entity_type"], e.get("description", ""), float(e["confidence"]), False) for e in good] + [(v[0][0], v[0][1], "", float(min(c for *_, c in v)), True) for v in taken.values()])
    return entities, sorted((r["source"], r["target"], r["relation_type"], float(r["confidence"])) for r in kept), (len(es) - len(good), len(rs) - len(kept), len(taken))


def e(name, kind="person", confidence=0.5, **more):
    return {"name": name, "entity_type": kind, "confidence": confidence, **more}


def r(source, relation, target, confidence=0.5, **more):
    return {"source": source, "target": target, "relation_type": relation, "confidence": confidence, **more}


def replies():
    good = {"entities": [e("Ada"), e("Ada"), e("Grace", description="x")], "relationships": [r("ada.", "REPORTS_TO", " the CTO "), r("Ada", "OWNS", "nobody"), r("Ada", "RELATED_TO", "(ADA)"), r("x", "REPORTS_TO", "the CTO", 0.2)]}
    odd = {"entities": [e("..."), e(5), e("A", "robot"), e("B", confidence="0.5"), e("C", confidence=True), e("D", confidence=1.5), e("E", description=None), e("F", confidence=1), "text", None, [], e("F", "team", 0)], "relationships": [r("F", "REPORTS_TO", "G"), r("G", "MEMBER_OF", "H"), r("K", "MEMBER_OF", "K2"), r("K2", "WORKS_ON", "z"), {"source": "a"}, 7, r("one two three four five six seven", "REPORTS_TO", "F")]}
    texts = [
        None, "", "nothing", "{", "}{", "}} {\"entities\": []} x", json.dumps(good), f"Sure!\n```json\n{json.dumps(good)}\n```\nDone.", f"x {json.dumps(odd)} y", '{"entities": 5}', '{"entities": [], "relationships": null}', '{"entities": []}', "[1]", '```\n[1]\n``` {"entities": [], "a": {"b": 1}}',
        '{"entities": [{"name": "N", "entity_type": "person", "confidence": NaN}], "relationships": []}', '{"entities": [{"name": "N", "entity_type": "person", "confidence": 1e999}]}', '{"entities": [{"name": "N", "name": "M", "entity_type": "team", "confidence": 0.25}]}', '{"a": "}"} {"entities": []}', "{bad} {\"entities\": []}", '{"entities": [{"name": "\\u00c5 {", "entity_type": "team", "confidence": 0}]}',
    ]
    rng = random.Random(6)
    names = ["Ada", "ada", "Grace", "CTO", "the team", "", "x y z", "Pune"]
    for _ in range(40):
        x = {"entities": [e(rng.choice(names), rng.choice(["person", "team", "robot"]), rng.choice([0.1, 0.9, 2])) for _ in range(rng.randrange(4))], "relationships": [r(rng.choice(names), rng.choice(X.RELATIONS), rng.choice(names), rng.choice([0.3, 0.7])) for _ in range(rng.randrange(6))]}
        texts.append(rng.choice(["", "ok: "]) + json.dumps(x))
    return texts


def test_salvage(spark):
    texts = replies()
    found = X.salvage(spark.createDataFrame(list(enumerate(texts)), "reply_id long, text string"))
    entities, relations = {}, {}
    for x in found.entities.collect():
        entities.setdefault(x.reply_id, []).append((x.name, x.entity_type, x.description, x.confidence, x.adopted))
    for x in found.relations.collect():
        relations.setdefault(x.reply_id, []).append((x.source, x.target, x.relation_type, x.confidence))
    counts = {x.reply_id: x for x in found.counts.collect()}
    assert len(counts) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        if isinstance(want[2], str):
            assert counts[i].error == want[2] and counts[i].entities_dropped is None and i not in entities
        else:
            assert (sorted(entities.get(i, [])), sorted(relations.get(i, [])), tuple(counts[i])[2:]) == want, text


def test_json_objects(spark):
    texts = replies()
    found = {x.i: x.o for x in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", json_object("t").alias("o")).collect()}
    for i, text in enumerate(texts):
        want = objects(text)
        assert (found[i] is None) == (want is None)


def test_objects_are_found_once(spark):
    """Entities, relations and counts read the objects as they were found; the texts aren't gone through again."""
    found = X.salvage(spark.createDataFrame(list(enumerate(replies())), "reply_id long, text string"))
    for part in (found.entities, found.relations, found.counts):
        assert "_objects" not in part._jdf.queryExecution().optimizedPlan().toString()
