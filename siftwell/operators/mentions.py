"""Which entities a mention names: exactly, without leading small words, by words within, by initials. Every step is a key, so that all of them are one equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.names import name_key
from siftwell.functions.text import array_of

# Words that never name anything alone, and small words that have no initial; letters of a name at least that is looked for within others.
FILLER = """
the a an our their this that these those its his her my your of to for per in on at by is are was were be does do did who
whom whose what which how why when where it and or with from as
""".split()
GENERIC = """
person people team teams project projects product products policy policies document documents organisation organization
company error errors code codes limit rule rules manager managers lead employee employees user users customer customers
price prices leave day days year years allowance budget cost
""".split()
NO_INITIAL = ["of", "the", "and", "for", "a", "an"]
LEAST = 3
#: Words of a run that is a key; longer mentions are met by their first words and then compared whole.
RUN = 6
#: Ids of a list of entities that are named alike, and parts that the mentions of more of them are dealt to.
LISTED, SALTS = 4096, 16
#: Steps of the ladder.
TYPED, EXACT, BARE, WITHIN, ACRONYM = range(1, 6)


def words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def bare(tokens: Column) -> Column:
    """Without leading small words."""
    first = F.array_position(F.transform(tokens, lambda w: ~F.array_contains(array_of(FILLER), w)), F.lit(True))
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(tokens, first.cast("int"), F.size(tokens)))


def identifying(tokens: Column) -> Column:
    """Whether a word of it can single something out."""
    return (F.length(F.array_join(tokens, " ")) >= LEAST) & F.exists(tokens, lambda w: ~F.array_contains(array_of(FILLER + GENERIC), w))


def acronym(name: Column, capitals: bool = False) -> Column:
    """A written one, of two to six capitals, in lower case; else null. Leading small words and marks around it don't count. With `capitals` a name of one word in
    capitals may be spelt like a small word."""
    tokens = F.filter(F.split(name, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    small = F.array_position(F.transform(tokens, lambda w: ~F.array_contains(array_of(FILLER), F.lower(w))), F.lit(True))
    small = F.when((F.size(tokens) == 1) & F.lit(capitals), 1).otherwise(small)
    last = F.when((small > 0) & (small == F.size(tokens)), F.regexp_replace(F.get(tokens, (small - 1).cast("int")), r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", ""))
    return F.when(F.rlike(last, F.lit("^[A-Z]{2,6}$")), F.lower(last))


def initials(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda w: ~F.array_contains(array_of(NO_INITIAL), w) & F.rlike(w, F.lit(r"^[\p{L}\p{N}]")))
    return F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), "")


def runs(tokens: Column, most: int = RUN) -> Column:
    """Every run of up to `most` consecutive words, as text."""
    sizes = F.sequence(F.lit(1), F.least(F.size(tokens), F.lit(most)))
    starts = lambda n: F.sequence(F.lit(1), F.size(tokens) - n + 1)
    each = F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice(tokens, i, n), " "))))
    return F.when(F.size(tokens) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _of(kind: int, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def _keys(*parts: tuple[int, Column, Column]) -> Column:
    """kind and key of arrays of keys, each under a condition."""
    none = F.array().cast("array<struct<kind:int,key:string>>")
    return F.explode(F.array_distinct(F.concat(*[F.when(when, _of(kind, keys)).otherwise(none) for kind, keys, when in parts])))


def _alike(table: DataFrame, ident: str, what: list[str], by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of ids that have the same set of `what` are alike: groups (by, group: the least of its ids, n ids, of: the set) and members (by, ident, group, n)."""
    sets = table.groupBy(*by, ident).agg(F.array_sort(F.collect_set(F.struct(*what))).alias("of"))
    groups = sets.groupBy(*by, "of").agg(F.min(ident).alias("group"), F.count("*").alias("n"))
    return groups, sets.join(groups, [*by, "of"]).select(*by, ident, "group", "n")


def _spread(pairs: DataFrame, mentions: DataFrame, entities: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, mention_id, entity_id, step of pairs of groups (question, group, n, step) and their members. Of entities lists of ids are exchanged, and of mentions a row a group, so that the rows
    themselves are made where they go on from. Mentions of a large group are dealt to SALTS parts, each of which has its lists."""
    salts = F.when(F.col("n") > LISTED, SALTS).otherwise(1)
    place = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("n") / LISTED))
    lists = entities.groupBy(*by, "group", place.alias("place")).agg(F.collect_list("entity_id").alias("ids"), F.first("n").alias("n"))
    lists = lists.select(*by, "group", "ids", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    said = pairs.join(mentions.select(*by, "mention_id", F.col("group").alias("question")), [*by, "question"])
    said = said.select(*by, "group", F.pmod(F.xxhash64("mention_id"), salts).cast("int").alias("salt"), "mention_id", "step")
    # a stated number of parts: by the size of what is exchanged they would be too few for the rows that are made of it
    parts, key = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, "group", "salt"]
    return said.repartition(parts, *key).join(lists.repartition(parts, *key), key).select(*by, "mention_id", F.explode("ids").alias("entity_id"), "step")


def match_mentions(mentions: DataFrame, spellings: DataFrame, by: tuple[str, ...] = (), capitals: bool = False) -> DataFrame:
    """by, mention_id, entity_id, step of what each mention (by, mention_id, name, entity_type) names: the entities of the first step that finds any.

    spellings (by, entity_id, entity_type, surface_name) are those that the asker may read; `by` are columns that tell askers apart. In this order: the same key and type
    (or no type asked for), the same key, the same without leading small words, a spelling within the mention or the mention within a spelling, initials. Within, both need a word that singles
    something out, the mention in any case. Names of nothing but marks match nothing. `capitals`: as in `acronym`.

    The ladder is gone through once for mentions that are alike and entities that are named alike; their pairs are rows only of the result.
    """
    name = mentions.select(*by, "mention_id", F.col("entity_type").alias("want"), acronym(F.col("name"), capitals).alias("acronym"), name_key(F.col("name")).alias("key")).where("key <> ''")
    own = spellings.select(*by, "entity_id", "entity_type", name_key(F.col("surface_name")).alias("spelling")).where("spelling <> ''")
    questions, asking = _alike(name, "mention_id", ["want", "acronym", "key"], by)
    named, entities = _alike(own, "entity_id", ["entity_type", "spelling"], by)
    core = F.array_join("core", " ")
    yes = F.lit(True)
    name = questions.select(*by, F.col("group").alias("question"), F.inline("of")).withColumn("core", bare(words(F.col("key")))).withColumn("sure", identifying(F.col("core")))
    asked = name.select(*by, "question", "want", core.alias("whole"), _keys((EXACT, F.array("key"), yes), (BARE, F.array(core), F.col("sure")), (WITHIN, runs(F.col("core"), 1_000), F.col("sure")), (-WITHIN, F.array(F.array_join(F.slice("core", 1, RUN), " ")), F.col("sure")), (ACRONYM, F.array("acronym"), F.col("acronym").isNotNull())).alias("k"))
    own = named.select(*by, "group", "n", F.inline("of")).withColumn("tokens", words(F.col("spelling")))
    index = own.select(*by, "group", "n", "entity_type", "spelling", _keys((EXACT, F.array("spelling"), yes), (BARE, F.array("spelling"), yes), (WITHIN, F.array("spelling"), identifying(F.col("tokens"))), (-WITHIN, runs(F.col("tokens")), yes), (ACRONYM, F.array(initials(F.col("tokens"))), F.size("tokens") >= 2)).alias("k"))
    flat = lambda t: t.select("*", "k.kind", "k.key").drop("k")
    found = flat(asked).join(flat(index), [*by, "kind", "key"])
    found = found.where((F.col("kind") != -WITHIN) | F.contains(F.concat(F.lit(" "), "spelling", F.lit(" ")), F.concat(F.lit(" "), "whole", F.lit(" "))))
    step = F.when((F.col("kind") == EXACT) & (F.col("want").isNull() | (F.col("want") == F.col("entity_type"))), TYPED).otherwise(F.abs("kind"))
    each = found.groupBy(*by, "question", "group", "n").agg(F.min(step).alias("step"))
    first = each.groupBy(*by, "question").agg(F.min("step").alias("step"))
    return _spread(each.join(first, [*by, "question", "step"]), asking, entities, by)
