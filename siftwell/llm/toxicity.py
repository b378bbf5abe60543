"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the sum of hashed embeddings of its character n-grams beside a hashed embedding of the word. Windows of
`span` words, a new one every `step` words, go through a forward and a backward GRU; attention pools their states to one
logit a window. A document's score follows from its highest window, so training is by windows drawn from labelled
documents, ever closer to each document's highest ones.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftwell.llm.shared import tidy
from siftwell.llm.words import NON_WORD, Words, chunks, mix, ranges


@dataclass(frozen=True)
class Settings:
    #: Labelled documents of each class that the model is fitted to, at most, and words of all of them together. Three
    #: of four documents are for the weights, the rest for the curve from logits to scores.
    sample: int = 3000
    sample_words: int = 1_000_000
    #: Characters of a labelled text; longer ones aren't learned from, so that no text takes more than its share.
    text_chars: int = 100_000
    span: int = 32
    step: int = 16
    hidden: int = 12
    grams: tuple[int, ...] = (3, 4)
    gram_slots: int = 1 << 14
    word_slots: int = 1 << 14
    gram_size: int = 16
    word_size: int = 8
    attention: int = 8
    epochs: int = 7
    #: Updates of the weights at least.
    updates: int = 240
    windows_per_text: int = 3
    batch: int = 128
    rate: float = 0.01
    decay: float = 0.1
    seed: int = 7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def summed(lines: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """n lines, each the sum of those with its place."""
    out = np.zeros((n, lines.shape[1]), lines.dtype)
    if len(places):
        order = np.argsort(places, kind="stable")
        first = np.flatnonzero(np.diff(places[order], prepend=-1))
        out[places[order[first]]] = np.add.reduceat(lines[order], first)
    return out


class Inputs:
    """The distinct words of a chunk with their n-grams, and its windows as places among them."""

    def __init__(self, column: pa.Array, s: Settings):
        words = Words(column, NON_WORD, lower=True)
        name, first, self.word = np.unique(words.name, return_index=True, return_inverse=True)
        self.slot = (name % np.uint64(s.word_slots)).astype(np.int64)
        size = words.end[first] - words.start[first]
        # bytes of each distinct word between two marks
        padded = np.full(int((size + 2).sum()), 0x7F, np.uint8)
        begin = np.cumsum(size + 2) - (size + 2)
        padded[ranges(begin + 1, size)] = words.data[ranges(words.start[first], size)]
        grams, owner = [], []
        for n in s.grams:
            count = np.maximum(size + 2 - n + 1, 0)
            at = ranges(begin, count)
            code = np.full(len(at), n, np.uint64)
            for j in range(n):
                code = code * np.uint64(256) + padded[at + j]
            grams.append((mix(code) % np.uint64(s.gram_slots)).astype(np.int64))
            owner.append(np.repeat(np.arange(len(first)), count))
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.per_word = grams[order], np.bincount(owner, minlength=len(first))
        self.gram_start = np.cumsum(self.per_word) - self.per_word
        # windows: none starts after one that reaches the end; a text without words has one empty window
        self.count = np.where(words.count > s.span, -(-(words.count - s.span) // s.step), 0) + 1
        self.text = np.repeat(np.arange(words.rows), self.count)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.start = words.first[self.text] + nth * s.step
        self.size = np.clip(words.count[self.text] - nth * s.step, 0, s.span)
        self.span = s.span

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (places among the distinct ones) of windows, and which of them there are."""
        at = self.start[windows][:, None] + np.arange(self.span)
        inside = np.arange(self.span) < self.size[windows][:, None]
        if not len(self.word):
            return np.zeros(at.shape, np.int64), inside
        return np.where(inside, self.word[np.minimum(at, len(self.word) - 1)], 0), inside


class Network:
    """Parameters, scores of windows, and gradients."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        size, h = s.gram_size + s.word_size, s.hidden
        make = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        self.p = {"grams": make(s.gram_slots, s.gram_size, by=0.1), "words": make(s.word_slots, s.word_size, by=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": make(size, 3 * h, by=size**-0.5), f"u{d}": make(h, 3 * h, by=h**-0.5), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": make(2 * h, s.attention, by=(2 * h) ** -0.5), "ab": np.zeros(s.attention, np.float32), "av": make(s.attention, by=0.5), "o": make(2 * h, by=(2 * h) ** -0.5), "ob": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def embed(self, x: Inputs) -> np.ndarray:
        """Inputs of the distinct words."""
        s, n = self.s, len(x.slot)
        out = np.zeros((max(1, n), s.gram_size + s.word_size), np.float32)
        for k in range(0, n, 20_000):  # bounds the gathered n-grams
            part = slice(k, min(n, k + 20_000))
            per = x.per_word[part]
            lines = self.p["grams"][x.grams[x.gram_start[k] : x.gram_start[part.stop - 1] + per[-1]]]
            out[part, : s.gram_size][per > 0] = np.add.reduceat(lines, (np.cumsum(per) - per)[per > 0]) if len(lines) else 0
            out[part, : s.gram_size] /= np.sqrt(np.maximum(per, 1))[:, None]
            out[part, s.gram_size :] = self.p["words"][x.slot[part]]
        return out

    def _states(self, d: str, gates: np.ndarray, at: np.ndarray, inside: np.ndarray, keep: list | None = None) -> np.ndarray:
        h, steps = self.s.hidden, range(at.shape[1])
        state, out = np.zeros((len(at), h), np.float32), np.zeros((len(at), at.shape[1], h), np.float32)
        for t in steps if d == "f" else reversed(steps):
            g, own = gates[at[:, t]], state @ self.p[f"u{d}"]
            zr = 1 / (1 + np.exp(-np.clip(g[:, : 2 * h] + own[:, : 2 * h], -30, 30)))
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[:, 2 * h :] + r * own[:, 2 * h :])
            there = inside[:, t, None]
            after = np.where(there, new + z * (state - new), state)
            if keep is not None:
                keep.append((t, state, z, r, new, own[:, 2 * h :], there))
            state = out[:, t] = after
        return out

    def forward(self, inputs: np.ndarray, at: np.ndarray, inside: np.ndarray, keep: dict | None = None, gates: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        gates = gates or {d: inputs @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}
        steps = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._states(d, gates[d], at, inside, steps[d]) for d in "fb"], axis=2)
        hidden = np.tanh(states @ self.p["a"] + self.p["ab"])
        weight = np.where(inside, hidden @ self.p["av"], -1e9)
        weight = np.exp(weight - weight.max(1, keepdims=True)) * inside
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", weight, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["ob"]

    def gradients(self, x: Inputs, windows: np.ndarray, wanted: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        """Of the mean of the windows' weighted cross-entropies against their labels."""
        s, h, p, k = self.s, self.s.hidden, self.p, {}
        at, inside = x.places(windows)
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(inside.shape)
        part = _Subset(x, used)
        inputs = self.embed(part)
        logit = self.forward(inputs, at, inside, k)
        d_logit = (weight * (sigmoid(logit) - wanted) / len(windows)).astype(np.float32)
        g = {"o": k["pooled"].T @ d_logit, "ob": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["o"]
        d_states = k["weight"][:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("bth,bh->bt", k["states"], d_pooled)
        d_score = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(1, keepdims=True))
        g["av"] = np.einsum("bt,bta->a", d_score, k["hidden"])
        d_hidden = d_score[:, :, None] * p["av"] * (1 - k["hidden"] ** 2)
        g["a"], g["ab"] = np.einsum("bth,bta->ha", k["states"], d_hidden), d_hidden.sum((0, 1))
        d_states = d_states + d_hidden @ p["a"].T
        d_inputs = np.zeros_like(inputs)
        for d, side in (("f", d_states[:, :, :h]), ("b", d_states[:, :, h:])):
            each, d_u = np.zeros((at.shape[1], len(windows), 3 * h), inputs.dtype), np.zeros_like(p[f"u{d}"])
            carry = np.zeros((len(windows), h), np.float32)
            for t, state, z, r, new, own_n, there in reversed(k["steps"][d]):
                total = carry + side[:, t]
                d_after = np.where(there, total, 0)
                d_new = d_after * (1 - z) * (1 - new**2)
                d_z = d_after * (state - new) * z * (1 - z)
                d_r = d_new * own_n * r * (1 - r)
                d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
                each[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u += state.T @ d_own
                carry = d_own @ p[f"u{d}"].T + np.where(there, total * z, total)
            d_gates = summed(each.reshape(-1, 3 * h), at.T.ravel(), len(inputs))
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = d_u, inputs.T @ d_gates, d_gates.sum(0)
            d_inputs += d_gates @ p[f"w{d}"].T
        d_gram = d_inputs[:, : s.gram_size] / np.sqrt(np.maximum(part.per_word, 1))[:, None]
        g["grams"] = summed(np.repeat(d_gram, part.per_word, axis=0), part.grams, s.gram_slots)
        g["words"] = summed(d_inputs[:, s.gram_size :], part.slot, s.word_slots)
        return g

    def logits(self, x: Inputs) -> np.ndarray:
        """Of all windows."""
        inputs = self.embed(x)
        gates = {d: inputs @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}
        step = 4096
        out = [self.forward(inputs, *x.places(np.arange(k, min(k + step, len(x.text)))), gates=gates) for k in range(0, len(x.text), step)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, x: Inputs) -> np.ndarray:
        """0 to 1 for each text, from its highest window."""
        return sigmoid(self.scale * self.highest(x) + self.shift)

    def highest(self, x: Inputs) -> np.ndarray:
        """The highest logit among each text's windows."""
        return np.maximum.reduceat(self.logits(x), np.cumsum(x.count) - x.count).astype(float) if len(x.text) else np.zeros(0)


class _Subset:
    """Some of the distinct words of Inputs."""

    def __init__(self, x: Inputs, used: np.ndarray):
        used = used[used < len(x.slot)]
        self.slot, self.per_word = x.slot[used], x.per_word[used]
        self.grams = x.grams[ranges(x.gram_start[used], self.per_word)]
        self.gram_start = np.cumsum(self.per_word) - self.per_word
        if not len(used):  # windows without any word
            self.slot, self.per_word, self.gram_start = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)


def train(texts: list[str], labels: np.ndarray, s: Settings = Settings()) -> Network | None:
    """A network from labelled texts; None unless both labels occur.

    Weights are learned from three of four texts of each class. Each epoch draws windows of every text by their logits. All
    windows of a text without toxicity are examples; those of a toxic text weigh as much as their share in its
    exponentiated logits, so that a long text counts little until its toxic windows stand out. The curve from highest logits to scores is fitted to the other texts, which the weights
    haven't seen, or to the same ones where a class has under four texts.
    """
    labels = np.asarray(labels)
    own = np.ones(len(labels), bool)
    for value in (0, 1):
        own[np.flatnonzero(labels == value)[3::4]] = False
    if len(set(labels.tolist())) < 2:
        return None
    net, rng = Network(s), np.random.default_rng(s.seed)
    x, y = Inputs(pa.array([t for t, o in zip(texts, own) if o], pa.large_string()), s), labels[own]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    logits, t = np.zeros(len(x.text), np.float32), 0
    epochs = max(s.epochs, -(-s.updates * s.batch // max(1, int(np.minimum(x.count, s.windows_per_text).sum()))))
    for epoch in range(epochs):
        order = np.lexsort((-(logits + rng.gumbel(size=len(logits))), x.text))
        begin = np.cumsum(x.count) - x.count
        share = np.exp(logits - np.repeat(np.maximum.reduceat(logits, begin), x.count))
        share /= np.repeat(np.add.reduceat(share, begin), x.count)
        weight = np.where(y[x.text] == 1, share, 1 / np.minimum(x.count, s.windows_per_text)[x.text])
        nth = np.arange(len(order)) - np.repeat(np.cumsum(x.count) - x.count, x.count)
        drawn = rng.permutation(order[nth < s.windows_per_text])
        for k in range(0, len(drawn), s.batch):
            windows = drawn[k : k + s.batch]
            t += 1
            for name, g in net.gradients(x, windows, y[x.text[windows]], weight[windows]).items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.p[name] *= 1 - s.rate * s.decay
                net.p[name] -= s.rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
        logits = net.logits(x)
    rest = ~own if len(set(labels[~own].tolist())) == 2 else own
    highest = np.concatenate([net.highest(Inputs(part, s)) for part in _parts([t for t, o in zip(texts, rest) if o])])
    net.scale, net.shift = _logistic(highest, labels[rest])
    return net


def _parts(texts: list[str]):
    """Arrays of a few megabytes of text."""
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    return (part.column(0) for part in chunks([table]))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the curve: the slope by Newton steps with a small penalty, the offset so that one half falls in
    the middle between the two logits that part the classes with the fewest errors (the widest gap among equals)."""
    mean, spread = x.mean(), x.std() + 1e-6
    z, v = np.stack([(x - mean) / spread, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        q = sigmoid(z @ v)
        slope = z.T @ (q - y) + 0.02 * v * [1, 0]
        curve = (z * (q * (1 - q))[:, None]).T @ z + np.diag([0.02, 1e-6])
        v = v - np.clip(np.linalg.solve(curve, slope), -2, 2)
    a = max(float(v[0]), 1e-3) / spread
    order = np.argsort(x)
    level, errors = x[order], np.concatenate([[0], np.cumsum(np.where(y[order] == 1, 1, -1))])[1:-1]
    gap = np.where(errors == errors.min(), np.diff(level), -1)
    at = int(gap.argmax())
    return a, -a * (level[at] + level[at + 1]) / 2


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text, toxic: at most `sample` texts of each class in an order given by a hash of doc_id, cut off after `sample_words` words.

    Texts of more than `text_chars` characters are left out; all others are learned from whole, also where a doc_id has several. The one of conflicting labels of a document that is 1 counts; null labels and labels without document don't.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(s.sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("of"), "toxic"))  # at most twice `sample` rows
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", order.alias("by"))
    size = F.length("text") / 6
    rows = rows.where(F.length("text") <= s.text_chars).dropDuplicates(["doc_id", "text"])
    # both classes are cut at half of the words each
    total = F.sum(size).over(Window.partitionBy("toxic").orderBy("by", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", total).where(F.col("so_far") <= s.sample_words / 2).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("long").alias("toxic"))


def score(docs: DataFrame, net: Network | None, column: str = "score", text: str = "text") -> DataFrame:
    """All columns of docs and a score from 0 to 1 of each row's whole text, in one scan.

    Null and empty texts get the score of a text without words. Without a network (no labels of both kinds) it is 0. Every row
    gives a row, repeated ones equal scores; a long text is scored by all its windows. A column of that name is replaced.
    """
    docs = docs.drop(column)
    if net is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((net.s, net.p, net.scale, net.shift))
    place = docs.columns.index(text)

    def scan(batches):
        own = Network.__new__(Network)
        own.s, own.p, own.scale, own.shift = shared.value
        for part in chunks(batches, text):
            found = own.scores(Inputs(part.column(place), own.s))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.round(6), pa.float64())], names=[*part.schema.names, column])

    return docs.mapInArrow(tidy(scan), StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fitted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Network | None:
    """A network from the labels of documents that are not held out. The sample, of a bounded size, is learned from in one task."""
    rows = labelled_sample(docs, labels.where(~held_out()), s)

    def fit(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int64())])
        table = pa.concat_tables([kinds.empty_table(), *(pa.table(b.columns, schema=kinds) for b in batches)]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        net = train(table["text"].to_pylist(), np.asarray(table["toxic"]).astype(float), s)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("long"))
    found = rows.repartition(1).mapInArrow(tidy(fit), "net binary").collect()
    return pickle.loads(found[0].net) if found else None


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
