"""What to try next with a question whose evidence fell short, as column expressions; and the numbered list of a walk's edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
NOTHING_FOUND = ["broaden", "switch_strategy", "decompose", "fetch_document", "narrow"]
OFF_POINT = ["narrow", "switch_strategy", "fetch_document", "decompose", "broaden"]
QUALIFIERS = ["exact", "exactly", "precise", "precisely", "specific", "specifically", "current", "currently", "official", "actual", "actually"]
PREPOSITIONS = ["for", "in", "during", "under", "within", "when"]
SPLITTERS = [" compared to ", " versus ", " vs ", " and ", "; "]
STOPWORDS = ["a", "an", "the", "is", "are", "was", "were", "of", "to", "what", "which", "does", "do"]
PART_WORDS, MOST, NARROWED = 3, 100, 5


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def broadened(question: Column) -> Column:
    """Without qualifiers and from the first restricting preposition on; if that changes nothing, its words that aren't stop words."""
    plain = F.array_join(F.filter(words(question), lambda w: ~F.regexp_replace(F.lower(w), "^,+|,+$", "").isin(QUALIFIERS)), " ")
    plain = stripped(F.regexp_replace(plain, f"(?i) (?:{'|'.join(PREPOSITIONS)}) .*$", ""))
    content = F.array_join(F.filter(words(question), lambda w: ~F.lower(w).isin(STOPWORDS)), " ")
    return F.when((plain != "") & (plain != question), plain).when(content != "", content).otherwise(question)


def narrowed(question: Column, missing: Column) -> Column:
    """With what was missing, unless it is there."""
    own = stripped(F.coalesce(missing, F.lit("")))
    return F.when((own == "") | F.contains(F.lower(question), F.lower(own)), question).otherwise(F.concat_ws(" ", question, own))


def wider(top_k: Column) -> Column:
    return F.least(F.lit(MOST), F.greatest(top_k * 2, top_k + 5))


def narrower(top_k: Column) -> Column:
    return F.least(top_k, F.lit(NARROWED))


def parts(question: Column) -> Column:
    """Questions that a compound one holds, by the first splitter that leaves two or more of three words each; else itself."""
    split = [F.filter(F.transform(F.split(question, f"(?i){s}"), stripped), lambda p: p != "") for s in SPLITTERS]
    whole = [F.when((F.size(p) > 1) & F.forall(p, lambda x: F.size(words(x)) >= PART_WORDS), p) for p in split]
    return F.coalesce(*whole, F.array(stripped(question)))


def next_move(proposed: Column, tried: Column, has_evidence: Column, has_document: Column, compound: Column) -> Column:
    """The proposed move if it is usable, else the first usable one of the order for this kind of failure, else abandon. A move is
    usable once, a split only of compound questions, a fetch only with a document. Giving up takes an attempt before it."""

    def usable(move):
        return ~F.array_contains(tried, move) & ((move != "decompose") | compound) & ((move != "fetch_document") | has_document)

    order = F.when(has_evidence, F.array(*map(F.lit, OFF_POINT))).otherwise(F.array(*map(F.lit, NOTHING_FOUND)))
    return (
        F.when((proposed == "abandon") & (F.size(tried) > 0), "abandon")
        .when((proposed != "abandon") & usable(proposed), proposed)
        .otherwise(F.coalesce(F.get(F.filter(order, usable), F.lit(0)), F.lit("abandon")))
    )


def edge_lines(edges: DataFrame, sources: DataFrame, passages: DataFrame) -> DataFrame:
    """walk_id, k, line: each edge of a walk in the direction it was walked, with the numbers of the passages that state it.

    edges (walk_id, k, edge_id, source_name, target_name, walked_as, reversed), sources (edge_id, chunk_id), passages (walk_id, n,
    chunk_id). Edges that no passage states say so. An edge's passages are those of one prompt.
    """
    stated = edges.select("walk_id", "edge_id").join(sources, "edge_id").join(passages, ["walk_id", "chunk_id"])
    stated = stated.groupBy("walk_id", "edge_id").agg(F.sort_array(F.collect_set("n")).alias("marks"))
    marks = F.array_join(F.transform("marks", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    first, second = (F.when(F.col("reversed"), F.col(a)).otherwise(F.col(b)) for a, b in (("target_name", "source_name"), ("source_name", "target_name")))
    line = F.concat(F.lit("[E "), F.col("k").cast("string"), F.lit("] "), first, F.lit(" "), "walked_as", F.lit(" "), second, F.lit(" (source passages: "), F.coalesce(marks, F.lit("none provided")), F.lit(")"))
    return edges.join(stated, ["walk_id", "edge_id"], "left").select("walk_id", "k", line.alias("line"))
