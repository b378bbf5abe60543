"""What a question's wording tells: identifiers, quoted phrases, comparison, counting, and the strategy that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of an identifier.
IDENTIFIER_TOKEN = r"[A-Za-z0-9_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_])?"
IDENTIFIER_FORMS = [
    r"^[A-Za-z0-9_]+_[A-Za-z0-9_]+$",  # with an underscore
    r"^([0-9]+[A-Za-z]|[A-Za-z]+[0-9])[A-Za-z0-9]*$",  # letters and digits
    r"^[A-Za-z]*[a-z][A-Z][A-Za-z0-9]*$",  # an inner capital
    r"^v?[0-9]+([.\-][0-9]+)+([.\-]?[A-Za-z0-9]+)*$",  # a version
    r"^[A-Z][A-Z0-9]{0,9}-[0-9]+$",  # a key
]
# Words that mark comparisons, and counts over several sources.
COMPARISON = ["compare", "compared", "comparison", "difference between", "differences between", "versus", "vs", "differ from"]
AGGREGATION = ["total", "sum of", "count of", "list all", "list every"]
MEASURES = "days weeks months years hours minutes seconds times percent dollars rupees".split()
# What a question says of a type of relation, and capitalised words that name nothing.
RELATIONS = {
    "REPORTS_TO": ["report to", "reports to", "reporting to", "manager of", "managed by"],
    "MEMBER_OF": ["member of", "members of", "part of the team", "on the team"],
    "BELONGS_TO": ["belong to", "belongs to"],
    "OWNS": ["owns", "owner of", "owned by"],
    "WORKS_ON": ["work on", "works on", "working on"],
    "LOCATED_IN": ["located in", "based in", "based out of"],
    "AUTHORED": ["wrote", "author of", "authored"],
}
NOT_ENTITIES = """
who what which when where why how does do did is are was were can could should would will the a an list compare show tell
give find i we our my
""".split()
# Strategies in the order in which they stand in for each other.
STRATEGIES = ["traditional", "vectorless", "graph", "agentic"]
#: Words up to which a question without signals counts as plain.
PLAIN_WORDS = 15


def is_identifier(token: Column) -> Column:
    out = F.lit(False)
    for form in IDENTIFIER_FORMS:
        out = out | token.rlike(form)
    return out


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER_TOKEN), F.lit(0)), is_identifier))


def phrases(text: Column) -> Column:
    """What stands in straight or typographic double quotes."""
    return F.transform(F.regexp_extract_all(text, F.lit('"[^"]+"|“[^”]+”'), F.lit(0)), lambda p: F.substring(p, F.lit(2), F.length(p) - 2))


def entities(text: Column) -> Column:
    """Runs of capitalised words that are neither question words nor identifiers."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9'\-]*"), F.lit(0))
    named = F.transform(words, lambda w: F.when(w.rlike("^[A-Z]") & ~F.lower(w).isin(NOT_ENTITIES) & ~is_identifier(w), w).otherwise("\n"))
    return F.filter(F.split(F.array_join(named, " "), r" ?\n[ \n]*"), lambda e: e != "")


def spoken(text: Column) -> Column:
    """Lower case words with a space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9']+", " ")), F.lit(" "))


def says(words: Column, marks: list[str]) -> Column:
    return words.rlike(" (" + "|".join(marks) + ") ")


def counts_things(words: Column) -> Column:
    """A total or list, or "how many" of what isn't a unit of measure (the first "how many" decides)."""
    what = F.regexp_extract(words, r" how many ([a-z0-9']+) ", 1)
    return says(words, AGGREGATION) | ((what != "") & ~what.isin(MEASURES))


def relations(words: Column, types: list[str] = tuple(RELATIONS)) -> Column:
    """Types of relation that the words speak of, in order of their names."""
    return F.array_compact(F.array(*[F.when(says(words, RELATIONS[t]), t) for t in sorted(types)]))


def signal_columns(text: Column, types: list[str] = tuple(RELATIONS)) -> dict[str, Column]:
    words = spoken(text)
    return {
        "n_identifiers": F.size(identifiers(text)).cast("long"),
        "n_phrases": F.size(phrases(text)).cast("long"),
        "relations": F.array_join(relations(words, types), ","),
        "entities": F.array_join(entities(text), ","),
        "comparison": says(words, COMPARISON),
        "aggregation": counts_things(words),
        "compound": (F.regexp_count(text, F.lit(r"\?")) > 1),
        "n_words": F.size(F.split(F.trim(text), r"\s+")).cast("long"),
    }


def route(available: list[str] = tuple(STRATEGIES)) -> dict[str, Column]:
    """strategy, decisive, from_rule, query_type, ranking and cost_level over the signal columns.

    One usable rule decides. If rules fired but none is usable, the first available strategy stands in, and so it does for a
    short question without rules. Several rules, or a long question, leave it open: the agent before what fired first.
    """
    usable_ones = [s for s in STRATEGIES if s in available]
    if not usable_ones:
        raise ValueError("at least one strategy has to be available")
    exact = (F.col("n_identifiers") > 0) | (F.col("n_phrases") > 0)
    related = (F.col("relations") != "") & (F.col("entities") != "")
    several = F.col("comparison") | F.col("aggregation") | F.col("compound")
    kind = F.when(F.col("comparison"), "comparison").when(F.col("aggregation"), "aggregation").otherwise("compound")
    rules = [(exact, "vectorless", F.lit("exact_match")), (related, "graph", F.lit("relationship")), (several, "agentic", kind)]
    fired = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("strategy"), k.alias("kind"))) for c, s, k in rules]))
    usable = F.filter(fired, lambda r: r["strategy"].isin(usable_ones))
    names = F.transform(usable, lambda r: r["strategy"])
    one, stood_in = F.size(usable) == 1, (F.size(usable) == 0) & (F.size(fired) > 0)
    plain = (F.size(fired) == 0) & (F.col("n_words") <= PLAIN_WORDS)
    strategy = F.when(F.size(usable) == 0, usable_ones[0]).when(F.array_contains(names, "agentic"), "agentic").otherwise(F.get(names, F.lit(0)))
    query_type = F.when(one, F.get(usable, F.lit(0))["kind"]).when(stood_in, F.get(fired, F.lit(0))["kind"]).when(plain, "simple_factual").otherwise("ambiguous")
    ranking = F.array_distinct(F.concat(F.array(strategy), names, F.array(*map(F.lit, usable_ones))))
    level = F.when(strategy == "agentic", "high").when(strategy == "graph", "medium").otherwise("low")
    return {"strategy": strategy, "decisive": one | stood_in | plain, "from_rule": one, "query_type": query_type, "ranking": F.array_join(ranking, ","), "cost_level": level}
