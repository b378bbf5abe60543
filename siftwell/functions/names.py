"""The key under which names of any script are compared."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What doesn't belong to a name at its start, at its end, and around it.
QUOTES, MARKS, PAIRS = "\"'`\\p{Pi}\\p{Pf}", ".,;:!?", ["()", "[]", "{}"]
WHITE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Compatibility form with folded case, in compatibility form again."""
    return names.str.normalize("NFKC").str.casefold().str.normalize("NFKC")


def _balanced(text: Column, pair: str) -> Column:
    """Whether no bracket of the pair closes before it opens, and none stays open."""
    step = lambda c: (c == pair[0]).cast("int") - (c == pair[1]).cast("int")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    seen = F.aggregate(F.split(text, ""), start, lambda a, c: F.struct((a["depth"] + step(c)).alias("depth"), F.least(a["least"], a["depth"] + step(c)).alias("least")))
    return (seen["depth"] == 0) & (seen["least"] == 0)


def _peeled(text: Column) -> Column:
    """Without quotes at the ends and marks at the end, and then without one pair of brackets around all of it."""
    bare = F.regexp_replace(text, rf"(?U)^[\s{QUOTES}]+|[\s{MARKS}{QUOTES}]+$", "")
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    around = [F.startswith(bare, F.lit(p[0])) & F.endswith(bare, F.lit(p[1])) & (F.length(bare) > 1) & _balanced(inner, p) for p in PAIRS]
    return F.when(around[0] | around[1] | around[2], inner).otherwise(bare)


def name_key(name: Column) -> Column:
    """Folded, white space squeezed, without quotes and marks at the ends and without brackets around the whole name, as often as there are
    such layers. Null for null; a name of nothing else has an empty key. Only the folding is Python."""
    plain = F.trim(F.regexp_replace(folded(name), WHITE, " "))
    layers = F.length(plain) - F.length(F.translate(plain, "([{", "")) + 1
    return F.trim(F.regexp_replace(F.aggregate(F.sequence(F.lit(0), layers), plain, lambda x, _: _peeled(x)), r"^ +| +$", ""))
