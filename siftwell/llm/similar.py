"""N-gram Jaccard join with grouped prefixes.

A document's set is its distinct word shingles. Sets are ordered rare shingles first, so that two similar sets share one in
their prefixes. Documents of equal prefix and size are one group; groups that share a prefix shingle are candidate pairs if
size and position allow the overlap; candidates are expanded to their members and verified.

Components come first: groups are chained, what stands beside a large component meets a few of its members, and only what is
still apart is paired in full. Shingles of a few groups are paired where their groups meet; those of more are dealt to blocks
of BLOCK rows of one component or of several, and blocks that are not of one component meet each other in a task of their own.
Verified pairs are dealt to blocks likewise, so that a set is sent once a block and not once a pair.

All links are within components. Where they are counted, a component's sets are dealt to parts, and each two parts meet in a
task as two sides of a matrix: pairs are no rows, and a set is sent once a part. The comparisons grow with the square of a
component's number of different sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.bitmap import Bitmap, row_name
from siftwell.llm.exchange import SEND_BYTES, SENT, buckets, received, sent, spread
from siftwell.llm.shared import give_back, small_batches, stored, tidy
from siftwell.llm.words import SPACE, Words, chunks, mix, ranges

SHINGLE = 5
#: A shingle in this many documents at least is common; the commonest MOST_COMMON at most are known to all tasks.
COMMON, MOST_COMMON = 16, 4_000_000
#: Shingles of more groups are paired in blocks of about BLOCK groups.
FEW, BLOCK = 16, 64
#: Sets, and shingles of them, that a part of a component has, about, when its links are counted.
SETS, SHINGLES = 256, 1 << 20
#: Orders in which a shingle's groups are chained for components, and members of a large component that others meet first.
CHAINS, PICKS = 8, 16
#: Binary logarithm of the count from which a shingle's groups don't meet in one bucket first.
HOT = 12
#: First shingles of a prefix that are looked through for one that gives the same pair before. Fewer only repeat pairs.
HEAD = 64
#: 64-bit words of the parity bitmap by which groups of a common shingle are told apart before they are paired.
PARITY = 8
_U = np.uint64


class Sets:
    """Distinct shingle names of each text of a chunk, in order of text and name, and where each text's begin."""

    def __init__(self, column: pa.Array, size: int = SHINGLE):
        words = Words(column, SPACE, lower=True)
        names, whole = words.windows(size)
        rows, values = [words.row[: len(names)][whole]], [names[whole]]
        for m in range(1, size):
            short = np.flatnonzero(words.count == m)
            if len(short):
                rows.append(short)
                values.append(words.windows(m)[0][words.first[short]])
        row, value = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        self.row, self.value = row[new], value[new]
        self.n = np.bincount(self.row, minlength=words.rows)
        self.first = np.cumsum(self.n) - self.n

    def digests(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One name for each text's values, given in a fixed order."""
        n = np.bincount(rows, minlength=len(self.n))
        first = np.cumsum(n) - n
        out = mix(n.astype(np.uint64) + _U(1))
        with np.errstate(over="ignore"):
            spread = mix(values + mix((np.arange(len(values)) - first[rows]).astype(np.uint64)))
            full = n > 0
            if full.any():
                out[full] += np.add.reduceat(spread, first[full])
        return mix(out)


def common_shingles(docs: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (the upper 32 bits of a name) of common shingles, sorted, and the binary logarithms of their counts.

    Counts are over all documents, added up before they are sent. Two names may share a cell: this only moves a shingle in the
    order.
    """

    def send(batches):
        def cells(part):
            value = Sets(part.column(0)).value
            return spread(value, n_buckets), (value >> _U(32)).astype(np.uint32), np.ones(len(value), np.uint32)

        return sent(chunks(batches), cells, np.add)

    def count(table):
        give_back()  # what the group before held
        cells, n = received(table, ["<u4", "<u4"])
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.diff(cells.astype(np.int64), prepend=-1))
        n = np.add.reduceat(n, first)
        often = n >= COMMON
        return pa.table({"cell": cells[first[often]].astype(np.int64), "level": np.log2(n[often]).astype(np.int32)})

    found = stored(docs.select("text").mapInArrow(tidy(send), SENT).groupBy("bucket").applyInArrow(count, "cell long, level int"))
    least, total = 0, 0
    for r in found.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row a power of two
        total += r["count"]
        if total > MOST_COMMON:
            least = r.level + 1
            break
    table = found.where(F.col("level") >= least).toArrow().sort_by("cell")
    return np.asarray(table["cell"]).astype(np.uint32), np.asarray(table["level"]).astype(np.uint8)


def level_of(values: np.ndarray, cells: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The binary logarithm of each shingle's count, 0 for those that aren't common."""
    cell = (values >> _U(32)).astype(np.uint32)
    level = np.zeros(len(cell), np.uint8)
    if len(cells):
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        known = cells[at] == cell
        level[known] = levels[at[known]]
    return level


class Prefixes:
    """Of a chunk: each set's prefix in the common order, with the place of each shingle, and its group's name."""

    def __init__(self, sets: Sets, cells: np.ndarray, levels: np.ndarray):
        level = level_of(sets.value, cells, levels)
        order = np.lexsort((level, sets.row))  # stable: names stay in order within a level
        size = np.where(sets.n > 0, sets.n - (3 * sets.n + 3) // 4 + 1, 0)
        place = np.arange(len(order)) - sets.first[sets.row]
        inside = place < size[sets.row]
        self.row, self.place, self.value = sets.row[inside], place[inside], sets.value[order][inside]
        self.group = mix(sets.digests(self.value, self.row) + sets.n.astype(np.uint64))


def parity(sets: Sets) -> list[bytes]:
    """For each set a bitmap of twice its size at least: how often each place is taken, modulo 2. Places of a smaller bitmap
    are those of a larger one modulo its size, so two bitmaps can be folded to one size."""
    out = []
    for n, first in zip(sets.n.tolist(), sets.first.tolist()):
        bits = 1 << max(6, (2 * n - 1).bit_length() if n else 6)
        place = (sets.value[first : first + n] & _U(bits - 1)).astype(np.int64)
        out.append(np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes())
    return out


def described(docs: DataFrame, common) -> DataFrame:
    """doc_id, uid, n, class (name of the set), group and parity of every row."""

    def scan(batches):
        cells, levels = common.value
        for part in chunks(batches):
            sets = Sets(part.column(1))
            own = sets.digests(sets.value, sets.row)
            group = Prefixes(sets, cells, levels).group
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(sets.n.astype(np.int64)), pa.array(own.view(np.int64)), pa.array(group.view(np.int64)), pa.array(parity(sets), pa.binary())],
                ["doc_id", "uid", "n", "class", "group", "parity"],
            )

    return docs.select("doc_id", "text", "uid").mapInArrow(tidy(scan), "doc_id long, uid long, n long, class long, group long, parity binary")


def fits(na, pa_, nb, pb):
    """Whether sets of these sizes whose first common shingle has these places may be similar. Arrays or columns."""
    return (4 * na >= 3 * nb) & (4 * nb >= 3 * na) & (7 * (na - pa_) >= 3 * (na + nb)) & (7 * (nb - pb) >= 3 * (na + nb))


def prefix_groups(docs: DataFrame, common) -> DataFrame:
    """group, n, data (the prefix's shingles in order) and bits (the parity bitmap, null if not the same for all its sets) of
    each group: a row a group, however many documents it has."""

    def scan(batches):
        cells, levels = common.value
        for part in chunks(batches):
            sets = Sets(part.column(0))
            p = Prefixes(sets, cells, levels)
            bits = np.bincount(sets.row * 64 * PARITY + (sets.value % _U(64 * PARITY)).astype(np.int64), minlength=len(sets.n) * 64 * PARITY).astype(np.uint8) & 1
            bits = np.packbits(bits.reshape(len(sets.n), -1), axis=1)
            at = np.unique(mix(p.group + mix(sets.digests(sets.value, sets.row))), return_index=True)[1]  # equal sets once
            at = at[sets.n[at] > 0]
            first, last = np.searchsorted(p.row, at), np.searchsorted(p.row, at, "right")
            data = [p.value[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.group[at].view(np.int64)), pa.array(sets.n[at].astype(np.int64)), pa.array(data, pa.binary()), pa.array([bits[k].tobytes() for k in at.tolist()], pa.binary())],
                ["group", "n", "data", "bits"],
            )

    found = docs.select("text").mapInArrow(tidy(scan), "group long, n long, data binary, bits binary")
    found = found.groupBy("group").agg(F.min(F.struct("n", "data")).alias("x"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    return found.select("group", "x.n", "x.data", F.when(F.col("low") == F.col("high"), F.col("low")).alias("bits"))


CANDIDATES = "token long, a long, b long, n long, place long"


def candidates(groups: DataFrame, common, n_buckets: int, chained: bool = False) -> DataFrame:
    """Rows with token null are pairs of groups (a, b), repeated at times. The others are the groups (a) of shingles that more
    than FEW groups have in their prefixes, still to be paired; of these, neighbours in CHAINS orders are pairs if `chained`."""

    def send(batches):
        cells, levels = common.value

        def entries(part):
            data = part.column(2).to_pylist()
            size = np.array([len(d) // 8 for d in data], np.int64)
            value = np.frombuffer(b"".join(data), np.uint64)
            group, n = (np.repeat(np.asarray(part.column(k)), size) for k in (0, 1))
            place = ranges(np.zeros(len(size), np.int64), size)
            token, group = mix(value), group.view(np.uint64)
            # what many documents have doesn't meet in one bucket: these buckets only pass it on
            hot = level_of(value, cells, levels) >= HOT
            bucket = np.where(hot, _U(n_buckets) + mix(group) % _U(n_buckets), token % _U(n_buckets))
            return bucket.astype(np.int32), (token >> _U(32)).astype(np.uint32), group, n.astype(np.uint32), place.astype(np.uint32)

        return sent(batches, entries)

    def meet(key, table):
        give_back()  # what the group before held
        token, group, n, place = received(table, ["<u4", "<u8", "<u4", "<u4"])
        order = np.lexsort((group, token))
        token, group, n, place = token[order].astype(np.int64), group[order].view(np.int64), n[order].astype(np.int64), place[order].astype(np.int64)
        bucket = key[0].as_py()
        index = np.cumsum(np.diff(token, prepend=-1) != 0) - 1
        few, left, right = np.zeros(len(token), bool), [], []
        if bucket < n_buckets:
            few = np.bincount(index)[index] <= FEW
            for d in range(1, min(FEW, len(token))):
                at = np.flatnonzero(few[:-d] & (token[d:] == token[:-d]))
                left.append(at)
                right.append(at + d)
        more = np.flatnonzero(~few)
        for order in range(CHAINS if chained else 0):
            at = more[np.lexsort((mix(group[more].view(np.uint64) + _U(order)), index[more]))]
            next_ = np.flatnonzero(index[at][1:] == index[at][:-1])
            left.append(at[next_])
            right.append(at[next_ + 1])
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        ok = (group[left] != group[right]) & fits(n[left], place[left], n[right], place[right])
        a, b = group[left[ok]], group[right[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        own = token[more] * n_buckets + bucket if bucket < n_buckets else -1 - token[more]
        none = pa.nulls(len(pairs), pa.int64())
        return pa.table(
            {
                "token": pa.chunked_array([none, pa.array(own)]),
                "a": pa.chunked_array([pa.array(pairs[:, 0]), pa.array(group[more])]),
                "b": pa.chunked_array([pa.array(pairs[:, 1]), pa.nulls(len(more), pa.int64())]),
                "n": pa.chunked_array([none, pa.array(n[more])]),
                "place": pa.chunked_array([none, pa.array(place[more])]),
            }
        )

    return groups.select("group", "n", "data").mapInArrow(tidy(send), SENT).groupBy("bucket").applyInArrow(meet, CANDIDATES)


def heads(groups: DataFrame) -> DataFrame:
    """group, the first HEAD shingles of its prefix, and its parity bitmap as integers."""

    def scan(batches):
        for batch in batches:
            head = [np.frombuffer(d.as_buffer(), np.int64)[:HEAD] for d in batch.column(1)]
            bits = [None if d is None else np.frombuffer(d, np.int64) for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(head, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["group", "head", "bits"])

    return groups.select("group", "data", "bits").mapInArrow(tidy(scan), "group long, head array<long>, bits array<long>")


def dealt(entry: DataFrame) -> DataFrame:
    """Adds to `entry` (token, node, root) the row's part, the last part up to its own and the first from its own that it meets,
    and the number of the token's parts. Parts of a root with more than BLOCK rows don't meet each other."""
    sizes = entry.groupBy("token", "root").agg(F.count("*").alias("k"))
    own = F.ceil(F.col("k") / BLOCK)
    large = sizes.where(F.col("k") > BLOCK).select("token", "root", own.alias("own"), (F.sum(own).over(Window.partitionBy("token").orderBy("root")) - own).alias("first"))
    is_large = F.col("k") > BLOCK
    totals = sizes.groupBy("token").agg(F.sum(F.when(is_large, own).otherwise(0)).alias("of_large"), F.ceil(F.sum(F.when(is_large, 0).otherwise(F.col("k"))) / BLOCK).alias("mixed"))
    rows = entry.join(totals, "token").join(large, ["token", "root"], "left")
    part = F.coalesce("first", "of_large") + F.pmod(F.xxhash64("node"), F.coalesce("own", "mixed"))
    rows = rows.withColumns({"part": part, "parts": F.col("of_large") + F.col("mixed")})
    return rows.withColumns({"before": F.coalesce(F.col("first") - 1, "part"), "after": F.coalesce(F.col("first") + F.col("own"), "part")}).drop("of_large", "mixed", "own", "first")


def paired(entry: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different roots that share a shingle (token) of `entry` (token, group, node, root, n,
    place) and fit. A node is a group or one of its classes.

    A shingle's rows are dealt to parts, those of a root with more than BLOCK rows to parts of its own, and each two parts that
    aren't of one such root meet under a key of their own. A pair is left to the first shingle that both have, as far as heads
    tell, and left out if more places of their bitmaps differ than shingles may.
    """
    rows = dealt(entry).join(heads(groups.join(entry.select("group").distinct(), "group", "left_semi")), "group")
    rows = stored(rows.select("token", "node", "root", "n", "place", "part", "before", "after", "parts", F.slice("head", F.lit(1), F.least(F.col("place"), F.lit(HEAD)).cast("int")).alias("head"), "bits"))
    side = lambda s, i, j: rows.select("token", i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "place", "head", "bits")])
    span = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)))
    own = F.col("part")
    a, b = side("a", own, span(F.col("after"), F.col("parts") - 1)), side("b", span(F.lit(0).cast("long"), F.col("before")), own)
    other = (F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b"))
    fit = fits(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"))
    apart = sum((F.bit_count(F.get(F.col("bits_a"), F.lit(k)).bitwiseXOR(F.get(F.col("bits_b"), F.lit(k)))) for k in range(PARITY)), F.lit(0))
    fit = fit & F.coalesce(7 * apart <= F.col("n_a") + F.col("n_b"), F.lit(True))
    met = a.join(b, ["token", "i", "j"]).where(other & (F.col("root_a") != F.col("root_b")) & fit & ~F.arrays_overlap("head_a", "head_b"))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _folded(data: np.ndarray, size: int) -> np.ndarray:
    while len(data) > size:
        data = data[: len(data) // 2] ^ data[len(data) // 2 :]
    return data


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose parity bitmaps and sizes don't rule similarity out."""
    side = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"p_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * n_a >= 3 * n_b AND 4 * n_b >= 3 * n_a")

    def scan(batches):
        for batch in batches:
            keep = []
            for p, q, total in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                size = min(len(p), len(q))
                apart = _folded(np.frombuffer(p, np.uint8), size) ^ _folded(np.frombuffer(q, np.uint8), size)
                keep.append(7 * int(np.bitwise_count(apart).sum(dtype=np.int64)) <= total)  # no less than this many differ
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "p_a", "p_b", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(tidy(scan), "a long, b long")


def full_sets(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """class and its sorted shingle names, for the rows whose uid is in `firsts` (and few others)."""

    wanted = Bitmap(firsts).filter(True)

    def scan(batches):
        for part in chunks(wanted(batches)):
            sets = Sets(part.column(1))
            own = sets.digests(sets.value, sets.row)
            data = [sets.value[f : f + n].tobytes() for f, n in zip(sets.first.tolist(), sets.n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(data, pa.binary())], ["class", "data"])

    return docs.mapInArrow(tidy(scan), "class long, data binary")


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose Jaccard similarity is 0.75 or more. Written out.

    Classes are dealt to cells of about BLOCK that have a neighbour in common; a block is what is between two cells.
    """
    pairs = stored(possible(pairs, classes))
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    near = stored(ends.groupBy("class").agg(F.least(F.min("other"), F.col("class")).alias("label")))
    parts = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cells = near.join(parts, "label").select("class", F.xxhash64("label", F.pmod(F.xxhash64("class"), "parts")).alias("cell"))
    of = lambda s: cells.select(F.col("class").alias(s), F.col("cell").alias(f"c_{s}"))
    placed = stored(pairs.join(of("a"), "a").join(of("b"), "b").select(F.xxhash64(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")).alias("block"), "a", "b"))
    sets = full_sets(docs, classes.join(near, "class", "left_semi").select("uid")).groupBy("class").agg(F.min("data").alias("data"))
    needed = placed.select("block", F.col("a").alias("class")).unionByName(placed.select("block", F.col("b").alias("class"))).distinct()
    none = F.lit(None)
    rows = needed.join(sets, "class").select("block", F.col("class").alias("a"), none.cast("long").alias("b"), "data").unionByName(placed.select("block", "a", "b", none.cast("binary").alias("data")))

    def scan(batches):
        own, known = None, {}
        for batch in batches:  # of each block first the sets, then the pairs
            keep = []
            for block, a, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if block != own:
                    own, known = block, {}
                if b is None:
                    known[a] = np.frombuffer(data, np.uint64)
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([known[a], known[b]]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 75 * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first()).mapInArrow(tidy(scan), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it is linked with) of all nodes of (a, b), by alternating large and small stars."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = stored(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds to `class` its component's root, itself if it has no link."""
    return nodes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def links_between(key, table):
    """class and n_links (similar sets of the other part) of the sets (class, part, data) of two parts, or of one."""
    _, i, j = (k.as_py() for k in key)
    part = np.asarray(table["part"])
    sets = [np.frombuffer(d, np.uint64) for d in table["data"].to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(n) - n
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    held = np.concatenate([place[begin[b] : begin[b] + n[b]] for b in right.tolist()] or [place[:0]])
    starts = np.cumsum(n[right]) - n[right]
    links, known = np.zeros(len(n), np.int64), np.zeros(len(names), np.int32)
    for a in left.tolist() if len(right) else []:
        own = place[begin[a] : begin[a] + n[a]]
        known[own] = 1
        common = np.add.reduceat(known[held], starts).astype(np.int64)
        known[own] = 0
        similar = (100 * common >= 75 * (n[a] + n[right] - common)) & (right != a)
        links[a] += similar.sum()
        if i < j:
            links[right] += similar
    some = links > 0
    out = pa.table({"class": table["class"].filter(pa.array(some)), "n_links": pa.array(links[some])})
    if table.nbytes > SEND_BYTES:
        del sets, names, place, held, known
        give_back()
    return out


def link_counts(docs: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """class and n_links (other classes of a similarity of 0.75 or more) of the classes that have any, of their components' roots."""
    placed = rooted(classes.select("class", "uid", "n"), roots)
    sizes = placed.groupBy("root").agg(F.count("*").alias("k"), F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / SHINGLES)).alias("parts")).where("k > 1")
    placed = stored(placed.join(sizes, "root").select("class", "uid", "root", "k", "parts", F.pmod(F.xxhash64("class"), "parts").alias("part")))
    several = placed.where("k > 2")
    sets = full_sets(docs, several.select("uid")).groupBy("class").agg(F.min("data").alias("data"))
    rows = several.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(sets, "class")
    rows = rows.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "class", "part", "data")
    found = rows.groupBy("root", "i", "j").applyInArrow(links_between, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))
    return found.unionByName(placed.where("k = 2").select("class", F.lit(1).cast("long").alias("n_links")))  # two that make a component are linked


def still_apart(entry: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of `entry` (token, group, class, n, place) with the class's root, of tokens with two roots at least. Written out."""
    entry = stored(rooted(entry.select("token", "group", "class", "n", "place"), roots))
    apart = entry.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    return stored(entry.join(apart, "token"))


def with_picked(entry: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with about PICKS members of the largest component under their token, where it has more."""
    sizes = entry.groupBy("token", "root").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("k", "root")).alias("top")).where(f"top.k > {PICKS}").select("token", "top.k", "top.root")
    picked = entry.join(largest, ["token", "root"]).where(F.pmod(F.xxhash64("class", "token"), F.col("k")) < PICKS)
    a, b = (side.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "root", "n", "place")]) for side, s in ((entry, "a"), (picked, "b")))
    met = a.join(b, "token").where((F.col("root_a") != F.col("root_b")) & fits(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b")))
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def spanning_links(docs: DataFrame, classes: DataFrame, common, n_buckets: int) -> DataFrame:
    """Pairs (a, b) of similar classes, enough to connect what all of them connect.

    Each group stands for its least class first, which is paired with the others of its group and with those of the groups it
    is chained with. Then classes that share a token (a common shingle, a group, or a pair of groups of several classes) and are
    of different components are paired, with a few of the largest first.
    """
    groups = stored(prefix_groups(docs, common))
    found = stored(candidates(groups, common, n_buckets, chained=True))
    met = stored(found.where("token IS NULL").select("a", "b").distinct())
    several = stored(classes.groupBy("group").agg(F.min("class").alias("least"), F.count("*").alias("k")))
    side = lambda s: several.select(F.col("group").alias(s), F.col("least").alias(f"l_{s}"), F.col("k").alias(f"k_{s}"))
    both = stored(met.join(side("a"), "a").join(side("b"), "b"))
    within = classes.join(several.where("k > 1"), "group").where("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b"))
    links = linked(both.select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).unionByName(within), docs, classes)
    roots = stored(components(links))
    none, member = F.lit(0).cast("long").alias("place"), classes.select("class", "group", "n")
    entry = found.where("token IS NOT NULL").select("token", F.col("a").alias("group"), "n", "place").join(member.drop("n"), "group")
    entry = entry.unionByName(member.join(several.where("k > 1").select("group"), "group").select(F.xxhash64("group").alias("token"), "group", "class", "n", none))
    wide = both.where("k_a > 1 OR k_b > 1").select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("group"))
    entry = entry.unionByName(wide.join(member, "group").select("token", "group", "class", "n", none))
    entry = still_apart(entry, roots)
    links = links.unionByName(linked(with_picked(entry), docs, classes))
    entry = still_apart(entry.drop("root"), stored(components(links)))
    rest = paired(entry.select("token", "group", F.col("class").alias("node"), "root", "n", "place"), groups)
    return links.unionByName(linked(rest, docs, classes))


def similar_documents(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, uid, n_shingles (distinct shingles), component_id (smallest doc_id reachable by links of similarity 0.75
    or more) and root (a name of the component, null without words) of every row, and with `count_links` n_links (other texts,
    different as sets of shingles, whose similarity is 0.75 or more).

    A text with fewer words than a shingle is one shingle; null, empty and blank texts have none and are linked with
    nothing, so each is its own component. Equal texts are linked. Rows without doc_id take part, but a null is never the
    smallest unless there is no other. Every row gives a row, repeated ones too; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_name().alias("uid"))
    n_buckets = buckets(docs)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n_buckets))  # MOST_COMMON at most
    rows = stored(described(docs, common))
    full = rows.where("n > 0")
    classes = stored(full.groupBy("class").agg(F.min("uid").alias("uid"), F.min("n").alias("n"), F.min("group").alias("group"), F.min("parity").alias("parity")))
    roots = stored(components(spanning_links(docs, classes, common, n_buckets)))
    known = rooted(rows.where("n > 0").select("doc_id", "uid", "n", "class"), roots)
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = known.join(least, "root").select("doc_id", "uid", F.col("n").alias("n_shingles"), "component_id", "root", "class")
    empty = rows.where("n = 0").select("doc_id", "uid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), "class")
    out = out.unionByName(empty)
    if count_links:
        out = out.join(link_counts(docs, classes, roots), "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return out.drop("class")


def op6_grouped_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
