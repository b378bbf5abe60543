"""Sets of row names as bitmaps of bounded size, so that only rows that may be in a set are shuffled to be joined with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import spare, stored

#: Bits of a bitmap at most, and for each member while there are few.
MOST_BITS, BITS_EACH = 1 << 27, 16


class Bitmap:
    """Which 64-bit names may be in a set (the only column of `members`): a bit for each, in at most MOST_BITS bits."""

    def __init__(self, members: DataFrame):
        name = members.columns[0]
        self.bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (BITS_EACH * members.count()).bit_length()))
        place = F.pmod(name, F.lit(self.bits))
        bit = F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) as int))")
        filled = members.select(F.floor(place / 64).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(self.bits // 64, np.int64)  # MOST_BITS / 8 bytes at most
        table[np.asarray(filled["at"])] = np.asarray(filled["bits"])
        self.shared = members.sparkSession.sparkContext.broadcast(table)

    def split(self, docs: DataFrame, inside: bool, column: str = "uid") -> DataFrame:
        """The rows whose name may be in the set, or those whose name isn't."""
        return docs.mapInArrow(self.filter(inside, column), docs.schema)

    def filter(self, inside: bool, column: str = "uid"):
        """What `split` does, as a function from batches to batches."""
        found = self.tester()

        def scan(batches):
            for batch in batches:
                flags = found(np.asarray(batch.column(batch.schema.get_field_index(column))))
                yield batch.filter(pa.array(flags if inside else ~flags))

        return scan

    def tester(self):
        """A function, for tasks, from an array of names to flags: whether each may be in the set."""
        shared, bits = self.shared, self.bits

        def found(names: np.ndarray) -> np.ndarray:
            place = names.view(np.int64) & (bits - 1)
            return (shared.value[place >> 6] >> (place & 63)) & 1 == 1

        return found


def row_name() -> Column:
    """A name of doc_id and text."""
    return F.xxhash64("doc_id", "text")


def decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs by `decisions` (doc_id, uid as of `row_name`, keep): those not named stay, of those named with keep one
    each stays, and all other named ones go. Rows that a bitmap clears aren't shuffled."""
    doc = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    uid, of = spare("uid", docs), spare("of_doc", docs)
    keep = spare("keep", docs)
    named = stored(decisions.select(F.col("uid").alias(uid), doc("doc_id").alias(of), F.col("keep").alias(keep)).distinct())
    touched = Bitmap(named.select(uid))
    rows = docs.withColumns({uid: row_name(), of: doc("doc_id")})
    met = touched.split(rows, True, uid).join(named, [uid, of], "left")
    out = touched.split(rows, False, uid).select(docs.columns).unionByName(met.where(F.col(keep).isNull()).select(docs.columns))
    return out.unionByName(met.where(F.col(keep)).dropDuplicates([uid, of]).select(docs.columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id and `row_name` (uid) are in `gone`."""
    return decided(docs, gone.select("doc_id", "uid", F.lit(False).alias("keep")))
