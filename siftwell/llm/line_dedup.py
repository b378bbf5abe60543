"""Line deduplication: levelled sorted runs of line hashes. DataFrame functions only.

The lines met so far are a set of runs, each a table bucketed and sorted by hash. A batch is exchanged once, as its own
run is written, and meets every older run where that lies, by merge joins of equal buckets: the lines that no run has are new, and are added
as a run of their own. Runs of one level are merged to one of the next when there are enough of them, so a batch meets a number of
runs that grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.shared import delete, exists, names, shared_dir, stored
from siftwell.llm.url_rules import ASCII_LOWER, ASCII_UPPER, lower_ascii

#: Code points a line must have, and rows that must hold it, to be dropped from all but one.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that a whole table is dealt to, and runs of a level that are merged to one of the next.
BATCHES, FANOUT = 4, 4
#: Lines in at least one of so many occurrences are joined by broadcast: there are no more than so many of them.
HOT_SHARE = 10_000
SPACE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The text between line feeds; one empty line for nulls and empty texts."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_names(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """For each line two 64-bit hashes, of different seeds, of the line without white space at its ends and with A-Z lower-cased; null for
    lines that are shorter than `min_chars` code points then."""
    plain = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(lower_ascii(plain))
    keys = F.transform(F.split(low, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))


def doc_number() -> Column:
    """doc_id as a number that can be compared; nulls are the least."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def batch_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h, g, n (rows of the batch that hold the line) and last (the largest doc_id of them), a row a line."""
    each = docs.select(doc_number().alias("doc"), F.explode(F.array_distinct(line_names(F.col("text"), min_chars))).alias("k")).where("k IS NOT NULL")
    return each.groupBy("k.h", "k.g").agg(F.count("*").alias("n"), F.max("doc").alias("last"))


class LineRuns:
    """Runs of line hashes in a folder, of two kinds. `seen` has each line once: `last` is the largest doc_id of the first batch that held it.
    `counts` has how many rows held it, a row a run, to be summed.

    A run's name is the range of the batches in it. It counts when it is whole and no other run's range holds its own, so a merge
    that is broken off changes nothing, and one that has ended is in force before the runs it replaces are deleted. A batch that is
    in the runs already isn't added again. One writer at a time.
    """

    COLUMNS = {"seen": "h BIGINT, g BIGINT, last BIGINT", "counts": "h BIGINT, g BIGINT, n BIGINT, last BIGINT"}

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or shared_dir(spark), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"siftwell_lines_{uuid.uuid4().hex}"
        self.tables: set[str] = set()

    def runs(self, kind: str) -> list[tuple[int, int]]:
        """First and last batch of each run in force, in order."""
        whole = [tuple(map(int, n.split("-"))) for n in names(self.spark, f"{self.path}/{kind}") if exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS")]
        return [r for r in whole if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in whole)]

    def _place(self, kind: str, run: tuple[int, int]) -> tuple[str, str]:
        return f"{self.prefix}_{kind}_{run[0]}_{run[1]}", f"{self.path}/{kind}/{run[0]:09d}-{run[1]:09d}"

    def read(self, kind: str, run: tuple[int, int]) -> DataFrame:
        table, place = self._place(kind, run)
        if table not in self.tables:
            self.spark.sql(f"CREATE TABLE {table} ({self.COLUMNS[kind]}) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self.tables.add(table)
        return self.spark.table(table)

    def _write(self, kind: str, run: tuple[int, int], rows: DataFrame, placed: bool = False) -> None:
        """`placed`: the rows are bucketed alike already."""
        table, place = self._place(kind, run)
        rows = rows.select(*(c.split()[0] for c in self.COLUMNS[kind].split(", ")))
        rows = rows if placed else rows.repartition(self.buckets, "h", "g")
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        rows.write.mode("overwrite").bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", place).option("compression", "zstd").saveAsTable(table)
        self.tables.add(table)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The lines that no run has: one merge anti-join a run."""
        return reduce(lambda left, run: left.join(self.read("seen", run).hint("merge"), ["h", "g"], "left_anti"), self.runs("seen"), keys)

    def add(self, batch: int, keys: DataFrame) -> None:
        """Adds a batch as of `batch_lines`, numbered from 0 in order of arrival."""
        if not any(a <= batch <= b for a, b in self.runs("seen")):
            if not any(a <= batch <= b for a, b in self.runs("counts")):
                self._write("counts", (batch, batch), keys)
            self._write("seen", (batch, batch), self.unseen(self.read("counts", (batch, batch))), placed=True)
        self.compact()

    def compact(self) -> None:
        """Merges the last `fanout` runs while they are of one level, that is, of as many batches each."""
        for kind in self.COLUMNS:
            while len(runs := self.runs(kind)[-self.fanout :]) == self.fanout and len({b - a for a, b in runs}) == 1:
                both = reduce(DataFrame.unionByName, [self.read(kind, r) for r in runs])
                if kind == "counts":
                    both = both.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
                self._write(kind, (runs[0][0], runs[-1][1]), both)
                for run in runs:
                    self._drop(kind, run)
                    delete(self.spark, self._place(kind, run)[1])

    def _drop(self, kind: str, run: tuple[int, int]) -> None:
        table = self._place(kind, run)[0]
        if table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.tables.discard(table)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """h, g, n and keeper (`last` of the run that saw the line first) of the lines in at least `min_docs` rows."""
        if not self.runs("seen"):
            return self.spark.createDataFrame([], "h long, g long, n long, keeper long")
        counts = reduce(DataFrame.unionByName, [self.read("counts", r) for r in self.runs("counts")]).groupBy("h", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
        seen = reduce(DataFrame.unionByName, [self.read("seen", r) for r in self.runs("seen")])
        return counts.join(seen, ["h", "g"]).select("h", "g", "n", F.col("last").alias("keeper"))

    def forget(self) -> None:
        """Takes the runs' tables out of the session's catalogue; their files stay."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()


def descending_batches(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The rows in ranges of doc_id of about equal size, the largest ids first; rows of one doc_id stay together."""
    rows = docs.withColumn("doc", doc_number()) if "doc" not in docs.columns else docs
    bounds = rows.agg(F.percentile_approx(doc_number(), [k / batches for k in range(1, batches)], 1000).alias("b")).first()["b"] if batches > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)
    above = [None, *bounds]
    return [docs.where((F.lit(True) if hi is None else doc_number() <= hi) & (F.lit(True) if lo is None else doc_number() > lo)) for hi, lo in zip(above, [*bounds, None])]


def dropped_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, t (hash of the text) and cut (places of the lines to drop, from 0, ascending) of the rows that lose lines.

    Lines with at least 1 / HOT_SHARE of all occurrences meet the rows by broadcast, as there are HOT_SHARE of them at most; of each of the
    others fewer rows than that share meet in a key of the shuffle.
    """
    total = frequent.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot, cold = F.broadcast(frequent.where(F.col("n") * HOT_SHARE >= total)), frequent.where(F.col("n") * HOT_SHARE < total)
    each = docs.select(doc_number().alias("doc"), F.xxhash64("text").alias("t"), F.posexplode(line_names(F.col("text"), min_chars)).alias("pos", "k")).where("k IS NOT NULL").select("doc", "t", "pos", "k.h", "k.g")
    found = each.join(hot, ["h", "g"])
    if not cold.isEmpty():
        found = found.unionByName(each.join(hot, ["h", "g"], "left_anti").join(cold, ["h", "g"]))
    return found.where("doc < keeper").groupBy("doc", "t").agg(F.array_sort(F.collect_set("pos")).alias("cut"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Each row's doc_id, n_lines, n_dropped and kept text: long lines that `min_docs` rows or more hold are left in the rows of the largest
    doc_id among them.

    A null or empty text is one empty line. Each row counts as a document, repeated ones too, and all rows of the largest doc_id
    keep the line; a line repeated in a row goes or stays as a whole. Null doc_ids are less than all others. Other columns are ignored, and so may have any
    name. An empty table gives no rows. A very long text is one row of the exchange; its work grows with its length. Texts are exchanged
    once, to meet the places of the lines they lose.
    """
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    docs = docs.select("doc_id", "text")
    for number, batch in enumerate(descending_batches(docs, batches)):
        runs.add(number, batch_lines(batch, min_chars))
    frequent = stored(runs.frequent(min_docs))
    runs.forget()
    cut = dropped_lines(docs, frequent, min_chars)
    rows = docs.withColumns({"doc": doc_number(), "t": F.xxhash64("text")}).join(cut, ["doc", "t"], "left")
    rows = rows.select("doc_id", "text", "cut", lines(F.col("text")).alias("lines"))
    ends = F.concat("cut", F.array(F.size("lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda p: p + 1))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.slice(F.col("lines"), z["a"] + 1, z["b"] - z["a"]))
    kept = F.when(F.col("cut").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{ASCII_UPPER}', '{ASCII_LOWER}') AS key FROM each
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id < keeper, false) AS gone FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
