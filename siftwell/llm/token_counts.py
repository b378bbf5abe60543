"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so the state is a set of committed batches of signed
deltas, each summed to one row a key before it is written. Totals are the sum over the committed batches; a new version of a
tokenizer is a batch that takes the old counts out and puts the new ones in.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siftwell.llm import bpe, huffman
from siftwell.llm.shared import delete, move, names, shared_dir, small_batches, stored
from siftwell.llm.words import chunks

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions: files of public vocabularies, by kind, and an estimate from characters.
TOKENIZERS = {"chars4-1": None, "word_bpe_49k": huffman.VOCABULARY, "byte_bpe_multi_50k": bpe.VOCABULARY}
#: Bytes of text that are counted at once.
BYTES = 2 << 20


def _sources(tokenizers: dict) -> dict:
    """What a task needs of each tokenizer: nothing, the definition of a .json file, or tokens and pattern of a .tiktoken one."""
    import public_tokenizers

    out = {}
    for name, file in tokenizers.items():
        if file is None:
            out[name] = None
        elif file.endswith(".json"):
            with open(public_tokenizers.path(file)) as opened:
                out[name] = opened.read()
        else:
            out[name] = bpe.vocabulary(public_tokenizers.path(file))
    return out


def _counter(source):
    """A function from a column of texts to their numbers of tokens."""
    if source is None:
        return lambda column: (np.asarray(pc.utf8_length(column)) + 3) // 4
    if isinstance(source, str):
        encode = huffman.encoder(source)
        return lambda column: encode(column)[1] - 1  # without the end id
    tokens, pattern = source
    encoder = bpe.Encoder(bpe._merges(tokens), pattern)
    return lambda column: encoder(column)[1]


def counted(docs: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """One row a document without its text: doc_id, source, lang, digest of the text, counts by tokenizer version.

    Null texts count no tokens and share one digest of their own (null), empty ones have none either; null sources and languages
    stay keys. Repeated rows each count. Other columns are ignored. A long text is counted in parts by the byte-level tokenizer,
    and the others need some ten times its size.
    """
    versions = list(tokenizers)
    shared = docs.sparkSession.sparkContext.broadcast(_sources(tokenizers))
    small_batches(docs.sparkSession)

    def scan(batches):
        counters = None
        for part in chunks(batches, size=BYTES):
            counters = counters or [_counter(shared.value[v]) for v in versions]
            text = part.column(4).cast(pa.large_string()).fill_null("")
            each = np.stack([np.asarray(count(text)).astype(np.int64) for count in counters], axis=1)
            edges = pa.array(np.arange(len(text) + 1, dtype=np.int32) * len(versions))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(edges, pa.array(each.ravel()))], [*part.schema.names[:4], "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2("text", 256).alias("digest"), "text")
    schema = StructType([*rows.schema.fields[:4], StructField("n", ArrayType(LongType()))])
    return rows.mapInArrow(scan, schema).select("doc_id", "source", "lang", "digest", F.map_from_arrays(F.array(*map(F.lit, versions)), "n").alias("counts"))


def signed(rows: DataFrame, tokenizers: list[str], sign: int = 1) -> DataFrame:
    """Deltas that insert (1) or delete (-1) the rows' counts under the given tokenizer versions."""
    versions = F.explode(F.array(*map(F.lit, tokenizers))).alias("tokenizer")
    return rows.select("source", "lang", "counts", versions).select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.col("counts")[F.col("tokenizer")]).alias("n_tokens"))


class Rollup:
    """Totals in a folder of committed batches.

    A batch is written to a folder of its own and then renamed to its place under `batches`; that it is there means that it is
    whole. A batch id that is committed already is skipped, so a replay changes nothing, and what a failed attempt left is
    never read. `compact` sums all committed batches to a base, which names them. It needs a file system where a folder is
    renamed in one step, and one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark)

    def _base(self) -> tuple[str | None, set[str]]:
        """The folder of the last base and the batches it holds (a short name for each)."""
        bases = names(self.spark, f"{self.path}/bases")
        if not bases:
            return None, set()
        base = f"{self.path}/bases/{bases[-1]}"
        return base, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").collect()}

    def commit(self, batch_id: str, *deltas: DataFrame) -> bool:
        """Adds the deltas' sums under a batch id, any string; False if that batch is in already."""
        name = "batch-" + quote(batch_id, safe="")
        if name in names(self.spark, f"{self.path}/batches") or name in self._base()[1]:
            return False
        rows = deltas[0]
        for more in deltas[1:]:
            rows = rows.unionByName(more)
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(attempt)
        done = move(self.spark, attempt, f"{self.path}/batches/{name}")
        delete(self.spark, attempt)
        return done

    def totals(self) -> DataFrame:
        """Sums of all committed batches; keys whose documents and tokens have both gone to zero are left out."""
        base, held = self._base()
        paths = [f"{self.path}/batches/{name}" for name in names(self.spark, f"{self.path}/batches") if name not in held]
        paths += [f"{base}/sums"] if base else []
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*paths)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Makes a base of all committed batches. Folders of batches that the base before had are removed, so readers of that one's
        state can end."""
        base, held = self._base()
        there = names(self.spark, f"{self.path}/batches")
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{attempt}/sums")
        self.spark.createDataFrame([(n,) for n in sorted({*held, *there})], "batch string").coalesce(1).write.parquet(f"{attempt}/batches")
        number = int(base.rpartition("/")[2]) + 1 if base else 1
        move(self.spark, attempt, f"{self.path}/bases/{number:012d}")
        for name in held.intersection(there):
            delete(self.spark, f"{self.path}/batches/{name}")


def first_of_each_text(rows: DataFrame) -> DataFrame:
    """The row with the least doc_id (null last) of each digest."""
    key: Column = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("source"), F.col("lang"))
    kept = rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "lang", "counts"), key).alias("r"))
    return kept.select("r.doc_id", "r.source", "r.lang", "digest", "r.counts")


def op1_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, deletes repeats of a text, revises the estimate to a real vocabulary's counts, and replays the load."""
    rows = stored(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    firsts = stored(first_of_each_text(rows))
    rollup, old = Rollup(spark), ["chars4-1", "word_bpe_49k"]
    rollup.commit("load", signed(rows, old))
    rollup.commit("repeats", signed(rows, old, -1), signed(firsts, old))
    rollup.compact()
    rollup.commit("byte_bpe_multi_50k", signed(firsts, ["chars4-1"], -1), signed(firsts, ["byte_bpe_multi_50k"]))
    rollup.commit("load", signed(rows, old))
    return rollup.totals()
