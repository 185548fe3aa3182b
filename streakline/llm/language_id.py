"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader, calibrated by a temperature.

A text is lower-cased, everything but letters and their marks becomes one space, and its
n-grams of 1 to ``ORDERS`` characters are hashed into ``BUCKETS`` features. A feature's value
is its share of the text's n-grams, in per cent, times its inverse document frequency, which
counts all training documents. A text of any length is read whole: logits are sums over
n-grams, and one of more than ``STRETCH`` characters is worked on in stretches that end at
white space, where n-grams end too.

The classifier is fitted on a bounded sample: ``SAMPLE`` documents of each language, expected,
taken by a hash of doc_id, the same way at every size. A fifth of it, by another part of the
hash, is kept for the calibration. The rest is dealt into ``SHARDS`` shards, the same ones
whatever the number of tasks. In each epoch a shard runs the per-coordinate update with L1
and L2 penalties over its documents, from the state that all shards share; the states are
summed by feature in Spark and averaged.
The state has at most languages x buckets entries, whatever the number of documents. The
L1 penalty leaves the weights sparse.

Languages that the sample holds in other proportions than the corpus get the logarithm of
the ratio as an offset. One temperature then divides the logits, the one of a fixed grid
with the least weighted log loss on the calibration part.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null doc_id or
lang, and rows held out, teach nothing. Equal rows are judged each. Of tied languages the
first by name wins. Without training rows every text is ``und``; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import aliased, aliased_schema, restored, stage, table
from streakline.llm.words import slices

UNKNOWN = "und"
ORDERS = 4
BITS = 18
BUCKETS = 1 << BITS
#: Training documents of a language, about; the bound of the sample that is learned from.
SAMPLE = 2000
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
#: Temperatures that the calibration chooses from: 0.05 to 20.
TEMPERATURES = 20.0 ** np.linspace(-1, 1, 121)
#: Characters of a long text that are worked on at once.
STRETCH = 1 << 20
#: Features of a text up to which they are counted by sorting, not by marking all buckets.
FEW = 2000
SPACES = re.compile(r"\s")
#: How far from its end a stretch is searched for white space.
LOOK_BACK = 1000
_FIRST = np.uint32(0x9E3779B1)
_NEXT = np.uint32(0x85EBCA6B)
_LAST = np.uint32(0xC2B2AE35)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark of letters, 0 otherwise."""
    if not _letters:
        kinds = {"L": 2, "M": 1}
        _letters.append(
            np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)
        )
    return _letters[0]


class Grams:
    """The hashed n-grams of ``texts``.

    orders: for each length of n-gram the bucket at each place of all texts, one after the
    other; begins, ends: the places of each text, where an n-gram of length k has k - 1
    places less; letters: whether a text has a letter.
    """

    def __init__(self, texts: list[str]):
        kinds = letter_table()
        codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        joined = np.empty(int(sizes.sum()) + 2 * len(texts), np.uint32)
        # a space before and after each text
        begins = np.cumsum(sizes + 2) - sizes - 2
        joined[begins] = joined[begins + sizes + 1] = 32
        for code, begin in zip(codes, begins.tolist(), strict=True):
            joined[begin + 1 : begin + 1 + len(code)] = code
        kind = kinds[joined]
        word = kind > 0
        kept = word.copy()
        kept[1:] |= word[:-1]
        kept[begins] = True
        joined[~word] = 32
        at = np.concatenate([[0], np.cumsum(kept)])
        self.begins, self.ends = at[begins], at[begins + sizes + 2]
        self.letters = np.add.reduceat(kind == 2, begins) > 0
        chars = joined[kept]
        self.orders = []
        rolled = np.zeros(len(chars), np.uint32)
        for k in range(ORDERS):
            size = max(0, len(chars) - k)
            rolled = rolled[:size] * _NEXT + (chars[k:] + np.uint32(1)) * _FIRST
            self.orders.append(((rolled ^ (rolled >> np.uint32(15))) * _LAST) >> np.uint32(32 - BITS))

    def lengths(self) -> np.ndarray:
        """The number of n-grams of each text."""
        return sum(np.maximum(self.ends - self.begins - k, 0) for k in range(ORDERS))

    def buckets(self, i: int) -> np.ndarray:
        """The buckets of all n-grams of a text."""
        return np.concatenate([o[self.begins[i] : max(self.begins[i], self.ends[i] - k)] for k, o in enumerate(self.orders)])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of the rows of ``values`` of its n-grams."""
        total = np.zeros((len(self.begins), values.shape[1]))
        for k, order in enumerate(self.orders):
            ends = np.maximum(self.begins, self.ends - k)
            some = np.flatnonzero(ends > self.begins)
            if len(some):
                taken = np.concatenate([values[order], np.zeros((1, values.shape[1]), values.dtype)])
                edges = np.stack([self.begins[some], ends[some]], 1).reshape(-1)
                total[some] += np.add.reduceat(taken, edges, axis=0)[::2]
        return total


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about STRETCH characters, cut at white space where there is some."""
    begin = 0
    while len(text) - begin > STRETCH:
        spaces = [m.start() for m in SPACES.finditer(text, begin + STRETCH - LOOK_BACK, begin + STRETCH)]
        end = spaces[-1] if spaces else begin + STRETCH
        yield text[begin:end]
        begin = end
    yield text[begin:]


class Texts:
    """The texts of a batch; a long one comes alone."""

    def __init__(self, batch: pa.RecordBatch):
        self.texts = [t or "" for t in batch.column("text").to_pylist()]
        self.long = len(self.texts) == 1 and len(self.texts[0]) > STRETCH

    def parts(self) -> Iterator[Grams]:
        """The n-grams of all texts, or of one stretch of the long one after the other."""
        if self.long:
            yield from (Grams([part]) for part in stretches(self.texts[0]))
        else:
            yield Grams(self.texts)

    def totals(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the sum of the rows of ``values`` of its n-grams, their number, and
        whether it has a letter."""
        sums, lengths, letters = 0.0, 0, False
        for grams in self.parts():
            sums, lengths = sums + grams.sums(values), lengths + grams.lengths()
            letters = letters | grams.letters
        return sums, lengths, letters

    def counted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, buckets, occurrences of each) of each text that has a letter."""
        if self.long:
            counts, letters = np.zeros(BUCKETS, np.int64), False
            for grams in self.parts():
                counts += np.bincount(grams.buckets(0), minlength=BUCKETS)
                letters |= bool(grams.letters[0])
            if letters:
                found = np.flatnonzero(counts)
                yield 0, found, counts[found]
            return
        for grams in self.parts():
            for i in np.flatnonzero(grams.letters).tolist():
                yield i, *np.unique(grams.buckets(i), return_counts=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in slices(batches):
        yield batch, Texts(batch)


def _document_counts(batches):
    counts = np.zeros(BUCKETS, np.int64)
    marked = np.zeros(BUCKETS, bool)
    for _, texts in _texts(batches):
        if texts.long:
            for _, found, _ in texts.counted():
                counts[found] += 1
            continue
        for grams in texts.parts():
            for i in np.flatnonzero(grams.letters).tolist():
                own = grams.buckets(i)
                if len(own) <= FEW:
                    counts[np.unique(own)] += 1
                else:
                    marked[own] = True
                    counts += marked
                    marked[:] = False
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])


def inverse_document_frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """log((1 + n) / (1 + documents with the feature)) + 1 over all ``docs`` (text)."""
    parts = docs.select("text").mapInArrow(_document_counts, "bucket long, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.log((1 + n) / (1 + counts)) + 1


@dataclass
class State:
    """Sums of corrected gradients and of squared gradients; the last row is the intercept."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        """One document's update: ``x`` are the values of its features ``rows``."""
        w = self.weights(rows)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + g * g


def _slots(state: State) -> pa.RecordBatch:
    """The entries that a shard has changed; the slot after the last counts the shards."""
    found = np.flatnonzero(state.n.reshape(-1))
    values = [pa.array(np.append(one.reshape(-1)[found], 1.0)) for one in (state.z, state.n)]
    return pa.RecordBatch.from_arrays([pa.array(np.append(found, state.n.size)), *values], ["slot", "z", "n"])


def _epoch(batches, shared: Broadcast):
    """The states of the shards in these rows, each learned from the shared state."""
    idf, z, n = shared.value
    now, state = None, None
    for batch, texts in _texts(batches):
        labels, shards = batch.column("label").to_pylist(), batch.column("shard").to_pylist()
        for i, rows, counts in texts.counted():
            if shards[i] != now:
                if state:
                    yield _slots(state)
                now, state = shards[i], State(z.copy(), n.copy())
            x = 100 * counts / counts.sum() * idf[rows]
            state.learn(np.append(rows, BUCKETS), np.append(x, 1.0), labels[i])
    if state:
        yield _slots(state)


def _train(sample: DataFrame, idf: np.ndarray, classes: int) -> np.ndarray:
    """The weights of features (rows) and languages, from ``sample`` (text, label, order)."""
    context = sample.sparkSession.sparkContext
    shape = (BUCKETS + 1, classes)
    state = State(np.zeros(shape), np.zeros(shape))
    dealt = sample.withColumn("shard", F.pmod("order", F.lit(SHARDS)))
    dealt = dealt.repartitionByRange(SHARDS, "shard").sortWithinPartitions("shard", "order")
    for _ in range(EPOCHS):
        shared = context.broadcast((idf, state.z, state.n))
        states = dealt.mapInArrow(lambda b, s=shared: _epoch(b, s), "slot long, z double, n double")
        rows = states.groupBy("slot").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
        z, n = np.zeros((2, state.z.size + 1))
        z[rows["slot"]], n[rows["slot"]] = rows["z"], rows["n"]
        shards = max(1.0, z[-1])
        state = State(z[:-1].reshape(shape) / shards, n[:-1].reshape(shape) / shards)
        shared.unpersist()
    return state.weights()


@dataclass
class LanguageModel:
    """Languages, and a row of weights times inverse document frequency a feature; the
    offsets hold intercepts and prior odds."""

    languages: list[str]
    table: np.ndarray
    offsets: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The logits of each text, and whether it has a letter."""
        sums, lengths, letters = texts.totals(self.table)
        return 100 * sums / np.maximum(lengths, 1)[:, None] + self.offsets, letters


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))


def _losses(batches, model: Broadcast, weights: np.ndarray):
    """The weighted log loss of each temperature."""
    losses = np.zeros(len(TEMPERATURES))
    for batch, texts in _texts(batches):
        labels = np.array(batch.column("label").to_pylist(), int)
        logits, letters = model.value.logits(texts)
        for t, temperature in enumerate(TEMPERATURES):
            right = _log_softmax(logits / temperature)[np.arange(len(labels)), labels]
            losses[t] -= (right * weights[labels])[letters].sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(losses))), pa.array(losses)], ["slot", "loss"])


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the documents that are learned from."""
    rows = docs.select("doc_id", "text", "lang")
    return rows.where((remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """A model from ``labelled`` (doc_id, text, lang); None if there are no rows."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not sizes:
        return None
    languages, counts = [r["lang"] for r in sizes], np.array([r["n"] for r in sizes], float)
    spark = labelled.sparkSession
    rates = np.minimum(1.0, sample / counts)
    # looked up in a literal of a row a language, so that no text is moved for it
    entries = [(F.lit(name), F.struct(F.lit(k).alias("label"), F.lit(float(rates[k])).alias("rate")))
               for k, name in enumerate(languages)]
    known = F.create_map(*(c for entry in entries for c in entry))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)).alias("part")
    chosen = labelled.withColumn("known", known[F.col("lang")]).where(drawn < F.col("known.rate") * 1_000_003)
    chosen = chosen.select("known.label", "text", part, F.xxhash64("text", "doc_id").alias("order"))
    chosen = stage(chosen, "sample")
    idf = inverse_document_frequencies(labelled, int(counts.sum()))
    weights = _train(chosen.where("part <> 0"), idf, len(languages))
    taken = np.ones(len(languages))
    for row in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect():
        taken[row["label"]] = row["n"]
    offsets = weights[BUCKETS] + np.log(counts / taken) - np.log(counts.sum() / taken.sum())
    model = LanguageModel(languages, (weights[:BUCKETS] * idf[:, None]).astype(np.float32), offsets)
    shared = spark.sparkContext.broadcast(model)
    losses = chosen.where("part = 0").select("text", "label").mapInArrow(
        lambda b: _losses(b, shared, counts / taken), "slot long, loss double"
    )
    best = losses.groupBy("slot").agg(F.sum("loss").alias("loss")).orderBy("loss", "slot").first()
    shared.unpersist()
    if best is not None and best["loss"] > 0:
        model.temperature = float(TEMPERATURES[best["slot"]])
    return model


def _predict(batches, shared: Broadcast | None, keep: list[str]):
    model = shared.value if shared else None
    for batch, texts in _texts(batches):
        names = np.full(batch.num_rows, UNKNOWN, object)
        scores = np.zeros(batch.num_rows)
        if model:
            logits, letters = model.logits(texts)
            p = np.exp(_log_softmax(logits / model.temperature))
            names[letters] = np.array(model.languages, object)[p.argmax(axis=1)[letters]]
            scores[letters] = np.minimum(p.max(axis=1), 1.0)[letters]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(names, pa.string()), pa.array(scores)],
            [*keep, "lang_pred", "score"],
        )


def predict(docs: DataFrame, keep: list[str], model: LanguageModel | None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` of each ``text``."""
    names = [f"kept_{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    kept = aliased_schema(docs, keep)
    found = docs.select("text", *aliased(keep)).mapInArrow(
        lambda b: _predict(b, shared, names), f"{kept + ', ' if kept else ''}lang_pred string, score double"
    )
    return found.select(*restored(keep), "lang_pred", "score")


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = predict(docs, ["doc_id"], fit(training_rows(docs)))
    return found.withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))


QUERIES = {"op11_language_id": op11_language_id}
ORACLES: dict[str, str] = {}
