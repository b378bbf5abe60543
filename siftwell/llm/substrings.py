"""Substring deduplication by recompression.

A text is a sequence of symbols, its words at first. In the first round each run of equal words becomes one symbol, and in each
round so do pairs of neighbours: a bit of its name tells whether a symbol joins to the right or to the left, so equal
substrings are parsed alike but for `CONTEXT` words at either end. Each round is a Spark job that names the new symbols globally:
what stands for one name is gathered, two things of one name get names of their own, and a symbol that only one document
has is told from those that documents share. A lone symbol joins no more, and no window with one in its interior repeats, so
the next rounds name only what windows of shared symbols still hold. ROUNDS is the most for which a window of 50 words is sure
to keep whole symbols, of up to SYMBOL words, in its interior.

The windows left are found by their anchors: the symbol of least name among those that begin in a window's interior. Anchors
with equal words around them reveal what may repeat. It is verified by the names of the whole segments of words that an anchor's
windows span, and where segments of one anchor differ, window by window. Keys and names together are 128 bits.

Work that grows with the corpus is keyed aggregation and joins. Text is shuffled only for documents that a bitmap of
bounded size can't rule out; bitmaps of lone symbols fill up on very large corpora, and then only save less work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.bitmap import Bitmap, row_name
from siftwell.llm.exchange import SENT, buckets, received, sent, spread
from siftwell.llm.shared import give_back, small_batches, stored, tidy
from siftwell.llm.words import SPACE, Words, chunks, mix, ranges

WINDOW, ROUNDS = 50, 3
_U = np.uint64


def context(rounds: int = ROUNDS) -> tuple[int, int]:
    """Words at either end of a shared stretch without runs at its ends whose symbols may differ, and words of a symbol that
    is no run at most. A word at the end may be of a run outside, and each round may join the next symbol to what is outside."""
    edge, size = 1, 1
    for _ in range(rounds):
        edge, size = edge + size, 2 * size
    return edge, size


CONTEXT, SYMBOL = context()
#: Words in which a window's anchor may begin, counted from its start: CONTEXT .. CONTEXT + ZONE - 1; words that all windows
#: of one anchor have, from CONTEXT before it on.
ZONE = WINDOW - 2 * CONTEXT - SYMBOL + 1
AROUND = WINDOW - ZONE + 1


class Symbols:
    """The texts of a chunk as symbols: name, first word (at) and number of words (size) of each; `free` ones may join, `lone`
    ones are in one document only. `made` are those of the last round, `check` other names of what they stand for."""

    def __init__(self, words: Words, bits: int = 64):
        """With each run of equal words as one symbol, which joins no others. Names have their lowest `bits` alone."""
        self.words, self.mask, self.round = words, _U(2**bits - 1), 0
        new = np.ones(len(words), bool)
        new[1:] = (words.name[1:] != words.name[:-1]) | (words.row[1:] != words.row[:-1])
        self.at = np.flatnonzero(new)
        self.size = np.diff(np.append(self.at, len(words)))
        self.name, self.row = words.name[self.at], words.row[self.at]
        self.first_at, self.first_size = self.at, self.size
        self.free, self.lone = self.size == 1, np.zeros(len(self.at), bool)
        self.made = np.flatnonzero(self.size > 1)
        self.check = self._named(self.made, self.size[self.made].astype(np.uint64))

    def _named(self, places: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Names the symbols at `places` by what they were and a second part; returns their other names."""
        first, kind = self.name[places], _U(self.round + 1)
        with np.errstate(over="ignore"):
            self.name[places] = mix(first * _U(0xD6E8FEB86659FD93) + mix(second + kind)) & self.mask
            return mix(mix(first + kind) * _U(0x9FB21C651E98DF25) + second)

    def settle(self, shared, clashes: np.ndarray) -> None:
        """Ends a round: `shared` tells names that documents share, `clashes` are names of more than one thing."""
        names = self.name[self.made]
        clash = np.isin(names, clashes)
        lone = ~(shared(names) | clash)
        names[clash] = mix(names[clash] ^ self.check[clash])
        self.name[self.made], self.lone[self.made] = names, lone
        self.free[self.made] &= ~lone

    def join(self) -> None:
        """Begins a round: free neighbours of one text become one symbol if their names' bits tell them to."""
        self.round += 1
        side = (mix(self.name + _U(self.round * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> _U(40)) & _U(1) == 1
        first = np.flatnonzero(self.free[:-1] & self.free[1:] & ~side[:-1] & side[1:] & (self.row[1:] == self.row[:-1]))
        self.check = self._named(first, self.name[first + 1])
        self.size = self.size.copy()
        self.size[first] += self.size[first + 1]
        keep = np.ones(len(self.name), bool)
        keep[first + 1] = False
        self.made = (np.cumsum(keep) - 1)[first]
        self.name, self.row, self.at, self.size, self.free, self.lone = (x[keep] for x in (self.name, self.row, self.at, self.size, self.free, self.lone))

    def windows(self) -> np.ndarray:
        """For each word, whether a window begins there that may be another document's too. A window in a run at its start or end is
        parsed like others of its words in fewer places, so lone symbols don't rule it out."""
        words = self.words
        n = max(0, len(words) - WINDOW + 1)
        begin, end = self.at[self.lone], (self.at + self.size)[self.lone]
        low, high = np.maximum(end - (WINDOW - CONTEXT), 0), begin - CONTEXT + 1
        there = (low < high) & (low < n)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, low[there], 1)
        np.add.at(marks, np.minimum(high[there], n), -1)
        whole = words.row[:n] == words.row[WINDOW - 1 : WINDOW - 1 + n]
        starts_in_run, ends_in_run = self.runs(n)
        return whole & ((np.cumsum(marks[:-1]) == 0) | starts_in_run | ends_in_run)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first n windows: whether the first two words are equal, and the last two."""
        same = np.ones(len(self.words), bool)
        same[self.first_at + self.first_size - 1] = False  # as the next word
        return same[:n], same[WINDOW - 2 : WINDOW - 2 + n]

    def to_name(self) -> np.ndarray:
        """The made symbols that windows of `windows` reach into."""
        live = self.windows()
        marks = np.zeros(len(self.words) + 1, np.int64)
        marks[: len(live)] += live
        marks[WINDOW : WINDOW + len(live)] -= live
        covered = np.cumsum(marks[:-1]) > 0
        return self.made[covered[self.at[self.made]] | covered[(self.at + self.size)[self.made] - 1]]


def parsed(words: Words, rounds: list, bits: int = 64) -> Symbols:
    """The symbols after the rounds that are settled, each by its (shared, clashes), and the joins of the next."""
    symbols = Symbols(words, bits)
    for k, (shared, clashes) in enumerate(rounds):
        symbols.settle(shared, clashes)
        if k < ROUNDS:
            symbols.join()
    return symbols


def settled(docs: DataFrame, bits: int = 64) -> list:
    """The rounds: for each, a test of names that documents share and the names that stood for more than one thing. The
    round of runs comes first. Of the clashing names, some 2 ** -65 of the square of all, the driver and the tasks hold an array."""
    rounds: list = []
    n_buckets = buckets(docs)
    for _ in range(ROUNDS + 1):
        done = list(rounds)

        def send(batches, done=done):
            def columns(part):
                symbols = parsed(Words(part.column(1), SPACE), done, bits)
                at = symbols.to_name()
                check = symbols.check[np.searchsorted(symbols.made, at)]
                doc = np.asarray(part.column(0))[symbols.row[at]]
                return spread(mix(symbols.name[at]), n_buckets), symbols.name[at], check, doc, doc

            return sent(chunks(batches), columns, np.minimum, np.maximum)

        def gather(table):
            give_back()  # what the group before held
            name, check, least, most = received(table, ["<u8", "<u8", "<i8", "<i8"])
            order = np.lexsort((check, name))
            name, check, least, most = name[order], check[order], least[order], most[order]
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(name)) - 1
            clash = check[first] != check[last]
            keep = clash | (np.minimum.reduceat(least, first) < np.maximum.reduceat(most, first))
            return pa.table({"name": name[first][keep].view(np.int64), "clash": clash[keep]})

        named = docs.select("doc_id", "text").mapInArrow(tidy(send), SENT).groupBy("bucket").applyInArrow(gather, "name long, clash boolean")
        named = stored(named)
        clashes = np.asarray(named.where("clash").select("name").toArrow()["name"].combine_chunks()).astype(np.int64).view(np.uint64)
        rounds.append((Bitmap(named.where("NOT clash").select("name")).tester(), clashes))
    return rounds


def anchors(words: Words, symbols: Symbols) -> tuple[np.ndarray, ...]:
    """For each stretch of windows with one anchor: key (the words around the anchor), segment (all words of the stretch,
    with the anchor's place among them), first window (as a word of the chunk) and number of windows.

    A window that begins in a run of equal words has the run's end for its anchor, one that ends in a run the run's start, and
    windows within a run are one stretch.
    """
    n = max(0, len(words) - WINDOW + 1)
    none = np.zeros(0, np.int64)
    starts = np.flatnonzero(symbols.windows())
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    # names that order the symbols, at their first words; a word in the midst of a symbol is never least
    order = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    order[symbols.at] = mix(symbols.name ^ _U(0xA5A5A5A5DEADBEEF)) >> _U(1)
    anchor, best = starts + CONTEXT, order[starts + CONTEXT]
    for j in range(CONTEXT + 1, CONTEXT + ZONE):  # the first of the least
        other = order[starts + j]
        less = other < best
        best[less] = other[less]
        anchor[less] = starts[less] + j
    run_start, run_end = (np.repeat(x, symbols.first_size) for x in (symbols.first_at, symbols.first_at + symbols.first_size))
    starts_in_run, ends_in_run = (x[starts] for x in symbols.runs(n))
    kind = np.where(starts_in_run, 1, np.where(ends_in_run, 2, 0))
    anchor = np.where(kind == 1, run_end[starts], np.where(kind == 2, run_start[starts + WINDOW - 1], anchor))
    kind[(kind == 1) & (anchor - starts >= WINDOW)] = 3
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1]) | (np.diff(starts) > 1)
    first, anchor, kind = starts[new], anchor[new], kind[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    low = np.choose(kind, [anchor - CONTEXT, anchor - 2, anchor - 1, first])
    size = np.choose(kind, [np.full(len(kind), AROUND), np.full(len(kind), 3), np.full(len(kind), 3), np.full(len(kind), WINDOW)])
    head, tail = words.spans(first, first + WINDOW), words.spans(first + count - 1, first + count - 1 + WINDOW)
    with np.errstate(over="ignore"):
        key = mix(words.spans(low, low + size) + kind.astype(np.uint64))
        # the first and the last window tell all words between, as they overlap or touch for up to WINDOW windows
        segment = mix(head * _U(0x9FB21C651E98DF25) + mix(tail + (count * 4096 + anchor - first).astype(np.uint64)))
        segment[kind == 3] = mix(head[kind == 3])
    return key, segment, first, count


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, uid, which tells rows of one doc_id with different texts apart, and whole rows without their text."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_name().alias("uid"), F.struct(*others).alias("others"))


def stretches(docs: DataFrame, rounds: list, bits: int = 64) -> DataFrame:
    """key, segment, doc_id, uid, first (window within the text), n of every anchor."""

    def scan(batches):
        for part in chunks(batches):
            words = Words(part.column(1), SPACE)
            key, segment, first, count = anchors(words, parsed(words, rounds, bits))
            row = words.row[first]
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(segment.view(np.int64)), part.column(0).take(place), part.column(2).take(place), pa.array((first - words.first[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["key", "segment", "doc_id", "uid", "first", "n"],
            )

    return docs.mapInArrow(tidy(scan), "key long, segment long, doc_id long, uid long, first int, n int")


def window_names(docs: DataFrame) -> DataFrame:
    """key, name, doc_id, uid, first of the windows in `spans` (array of first, n and key) of each text."""

    def scan(batches):
        for part in chunks(batches):
            words = Words(part.column(1), SPACE)
            spans = part.column(3)
            row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
            each = spans.flatten()
            first, n, key = (np.asarray(each.field(k)).astype(np.int64) for k in ("first", "n", "key"))
            at = ranges(first, n)
            row = np.repeat(row, n)
            place, where = pa.array(row), words.first[row] + at
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, n)), pa.array(words.spans(where, where + WINDOW).view(np.int64)), part.column(0).take(place), part.column(2).take(place), pa.array(at.astype(np.int32))],
                ["key", "name", "doc_id", "uid", "first"],
            )

    return docs.mapInArrow(tidy(scan), "key long, name long, doc_id long, uid long, first int")


def removed(docs: DataFrame, original: bool = False, only=None) -> DataFrame:
    """doc_id, uid, others, n_words, n_removed, kept of texts (doc_id, text, uid, others, spans) with the `spans` of their
    windows to remove; `only` may filter the batches first."""

    def scan(batches):
        for part in chunks(only(batches) if only else batches):
            words = Words(part.column(1), SPACE)
            spans = part.column(4).fill_null([])
            row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)))
            each = spans.flatten()
            first, n = (np.asarray(each.field(k)).astype(np.int64) for k in ("first", "n"))
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, words.first[row] + first, 1)
            np.add.at(marks, words.first[row] + first + n - 1 + WINDOW, -1)
            keep = np.cumsum(marks[:-1]) == 0
            start, size = words.start[keep], (words.end - words.start)[keep]
            data = np.append(words.data, np.uint8(32))[ranges(start, size + 1)]
            ends = np.cumsum(size + 1)
            data[ends - 1] = 32
            left = np.bincount(words.row[keep], minlength=words.rows)
            upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(left)])]
            raw = data.tobytes()
            kept = pa.array([raw[a : max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary()).cast(pa.string())
            if original:
                kept = pc.if_else(pa.array(left == words.count), part.column(1).fill_null("").cast(pa.string()), kept)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array(words.count.astype(np.int64)), pa.array((words.count - left).astype(np.int64)), kept],
                ["doc_id", "uid", "others", "n_words", "n_removed", "kept"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(tidy(scan), f"doc_id long, uid long, others {kinds['others']}, n_words long, n_removed long, kept string")


def repeated_windows(docs: DataFrame, bits: int = 64) -> DataFrame:
    """uid, first, n: stretches of windows whose words also start in a document with a smaller doc_id. Written out."""
    docs = docs.where(F.col("doc_id").isNotNull())
    found = stored(stretches(docs, settled(docs, bits), bits))
    classes = stored(found.groupBy("key", "segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
    # keys around which segments differ: their windows may still repeat
    mixed = classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key", F.lit(True).alias("mixed"))
    telling = classes.join(mixed, "key", "left").where("least < most OR mixed").select("key", "segment", "least", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    met = stored(found.join(telling, ["key", "segment"]).where("doc_id > least OR mixed").select("uid", "key", "first", "n", (F.col("doc_id") > F.col("least")).alias("repeated")))
    open_ = met.where("NOT repeated").groupBy("uid").agg(F.collect_set(F.struct("first", "n", "key")).alias("spans"))
    open_docs = Bitmap(open_.select("uid")).split(docs, True).join(open_, "uid").select("doc_id", "text", "uid", "spans")
    names = stored(window_names(open_docs))
    owners = names.groupBy("key", "name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    single = names.join(owners, ["key", "name"]).where("doc_id > least").select("uid", "first", F.lit(1).alias("n"))
    return stored(met.where("repeated").select("uid", "first", "n").unionByName(single))


def deduplicate(docs: DataFrame, original: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, uid, others (the row's other columns), n_words, n_removed, kept (the words left, joined by one space) of every
    row of `docs`: each word is removed that a window of WINDOW words
    covers whose words, unchanged, also start in a document with a smaller doc_id. Windows are judged on the input.

    Null and empty texts have no words. Rows of one doc_id never remove each other's words, and equal rows get equal results.
    With `original`, `kept` is the text as it is where no word goes. A null doc_id is smaller than none and none is smaller than it.
    `bits` is for tests: symbols' names of few bits, which clash.
    """
    small_batches(docs.sparkSession)
    docs = identified(docs)
    spans = repeated_windows(docs.select("doc_id", "text", "uid"), bits).groupBy("uid").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    spans = stored(spans)
    touched = Bitmap(spans.select("uid"))
    none = F.lit(None).cast("array<struct<first:int,n:int>>").alias("spans")
    rest = docs.select("doc_id", "text", "uid", "others", none)
    return removed(touched.split(docs, True).join(spans, "uid", "left").select("doc_id", "text", "uid", "others", "spans"), original).unionByName(removed(rest, original, touched.filter(False)))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
