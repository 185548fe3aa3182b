"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text.

Folding lower-cases, applies NFKC, drops zero-width characters, maps look-alike
letters of other scripts to Latin, and reads digits and signs inside words as the
letters they stand for. Lexicon entries are whole words and word beginnings of 4 to
6 letters. They are learned from a bounded sample of the labelled rows, ``LABELLED`` of each
label, expected, taken by a hash of doc_id in the same way at every size: so few that the
labels go to the texts, and texts are not shuffled to find them. An entry is admitted by
evidence alone, with the same three tests at every size: it occurs in ``MIN_DOCS`` toxic
texts, its weight, the log odds of occurring in toxic against clean texts, is
``MIN_WEIGHT`` or more, and of all entries tested, ``CHANCE`` would be expected to have such
counts if they occurred in both alike. Counts and weights are joined in Spark. Phrases of two words that hold an entry and speak for a
clean text, by the same tests with the labels exchanged and log odds of
``EXCEPTION_WEIGHT``, are exceptions: an entry inside one does not count. Tasks read
lexicon and exceptions from the shared folder.

A text's raw sum takes the largest weight for each matched word; the score is a
logistic model of that sum and of the sum over the text's length.

Null and empty texts have no words and score as a clean text; null labels are left
out; a null doc_id is never in the training rows; repeated rows are scored each.
Without both labels in the training rows the score is the share of toxic ones (0
without any). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import aliased, aliased_schema, kept, restored, shared_folder, stage, table
from streakline.llm.words import slices

MIN_DOCS = 3
MIN_WEIGHT = 3.0
CHANCE = 0.5
#: Labelled documents of each label that are learned from, about.
LABELLED = 20_000
_DRAWS = 1_000_003
#: Different entries that a task counts before it hands them on.
COUNTED = 200_000
PREFIXES = (4, 5, 6)
EXCEPTION_WEIGHT = math.log(10)
WORD = re.compile(r"[^\W_]+")
#: Signs that stand for letters, next to letters.
MIXED = re.compile(r"[^\W\d_][0134578@$!]+[^\W\d_]|[0134578@$][^\W\d_]{2}")
SIGN = re.compile("[0134578@$!]")
TOKEN = re.compile(r"\S+")
#: Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнαορνικτυε", "aeopcyxijsdhkmtbhaopviktue", strict=True))
SIGNS = str.maketrans("0134578@$!", "oieastbasi")
FOREIGN = re.compile(f"[{''.join(LOOKALIKES)}]")
HIDDEN = re.compile("[­​-‏⁠﻿]")
LETTERS = str.maketrans(LOOKALIKES)


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    text = text or ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = HIDDEN.sub("", text)
    text = text.lower()
    if not text.isascii() and FOREIGN.search(text):
        text = text.translate(LETTERS)
    if SIGN.search(text) and MIXED.search(text):
        text = TOKEN.sub(lambda t: t[0].translate(SIGNS) if MIXED.search(t[0]) else t[0], text)
    return WORD.findall(text)


def entries(word: str) -> Iterator[str]:
    """Lexicon entries that would match ``word``: itself, and its beginnings."""
    yield f" {word} "
    for n in PREFIXES:
        if len(word) >= n:
            yield f" {word[:n]}"


def automaton(patterns) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for pattern in patterns:
        found.add_word(pattern, pattern)
    if not len(found):
        return None
    found.make_automaton()
    return found


def matches(found: ahocorasick.Automaton | None, words: list[str]) -> list[tuple[int, str]]:
    """(position of its first character, pattern) of every match in the folded words."""
    if found is None or not words:
        return []
    line = f" {' '.join(words)} "
    return [(end - len(p) + 1, p) for end, p in found.iter(line)]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    #: Tables (entry, weight) in the shared folder, beside ``weights`` and ``exceptions``.
    lexicon: str | None = None
    excepted: str | None = None
    intercept: float = -math.inf
    per_sum: float = 0.0
    per_density: float = 0.0

    def probability(self, total: Column, n_words: Column) -> Column:
        if math.isinf(self.intercept):
            return F.lit(0.0 if self.intercept < 0 else 1.0)
        logit = self.intercept + self.per_sum * F.log1p(total) + self.per_density * density(total, n_words)
        return 1 / (1 + F.exp(-logit))


def density(total: Column, n_words: Column) -> Column:
    return F.log1p(100 * total / F.greatest(n_words, F.lit(1)))


def _read(folder: str | None) -> dict[str, float]:
    """The entries of a table in the shared folder with their weights."""
    if folder is None:
        return {}
    store, root = fs.FileSystem.from_uri(folder)
    schema = pa.schema([("entry", pa.string()), ("weight", pa.float64())])
    rows = ds.dataset(root, schema=schema, format="parquet", filesystem=store).to_table()
    return dict(zip(rows["entry"].to_pylist(), rows["weight"].to_pylist(), strict=True))


class Matcher:
    def __init__(self, model: ToxicityModel):
        self.weights = model.weights | _read(model.lexicon)
        self.found = automaton(self.weights)
        self.excepted = automaton([*model.exceptions, *_read(model.excepted)])

    def hits(self, words: list[str]) -> dict[int, float]:
        """Weight of each matched word by its position in the folded line."""
        best: dict[int, float] = {}
        for at, pattern in matches(self.found, words):
            best[at] = max(best.get(at, 0.0), self.weights[pattern])
        if best:
            for at, phrase in matches(self.excepted, words):
                for inside in [b for b in best if at <= b < at + len(phrase) - 1]:
                    del best[inside]
        return best


def _matcher(model: ToxicityModel) -> Matcher:
    """The model's matcher; a worker process keeps the last one it made from tables."""
    if model.weights or model.exceptions:
        return Matcher(model)
    return kept(("matcher", model.lexicon, model.excepted), lambda: Matcher(model))


def _count(batches, emit):
    """Rows (entry, n_toxic, n_clean); ``emit`` gives the different entries of a text."""
    counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()

    def counted():
        clean, toxic = counts
        both = list(clean | toxic)
        return pa.RecordBatch.from_pydict(
            {
                "entry": pa.array(both, pa.string()),
                "n_toxic": pa.array([toxic[e] for e in both], pa.int64()),
                "n_clean": pa.array([clean[e] for e in both], pa.int64()),
            }
        )

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(emit(text.as_py()))
        if sum(map(len, counts)) > COUNTED:
            yield counted()
            counts = Counter(), Counter()
    yield counted()


def _totals(labelled: DataFrame, emit) -> DataFrame:
    """(entry, n_toxic, n_clean): in how many toxic and clean texts an entry occurs."""
    rows = labelled.select("text", "toxic").mapInArrow(
        lambda b: _count(b, emit), "entry string, n_toxic long, n_clean long"
    )
    return rows.groupBy("entry").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def log_odds(n: Column, rows: int, other: Column, other_rows: int) -> Column:
    """Of occurring in texts of one label, ``n`` of ``rows``, against those of the other."""
    return F.log((n + 0.5) / (rows + 1)) - F.log((other + 0.5) / (other_rows + 1))


def by_chance(n: Column, rows: int, other: Column, other_rows: int) -> Column:
    """The Chernoff bound of the probability that ``n`` or more of the texts with an entry
    have the one label, if the entry occurs in texts of both labels alike."""
    share = rows / (rows + other_rows)
    part = lambda k, s: F.when(k > 0, k * F.log(k / ((n + other) * s))).otherwise(0.0)
    return F.exp(-part(n, share) - part(other, 1 - share))


def _entries_of(text: str | None) -> set[str]:
    return {e for w in set(fold(text)) for e in entries(w)}


def fit(labelled: DataFrame) -> ToxicityModel:
    """A model from all distinct rows of ``labelled`` (text, toxic), and, if the rows of a
    label stand for others, their ``weight``."""
    weight = F.max("weight") if "weight" in labelled.columns else F.lit(1.0)
    labelled = labelled.withColumn("toxic", F.col("toxic").cast("int")).where("toxic in (0, 1)")
    labelled = stage(labelled.groupBy("text", "toxic").agg(weight.alias("weight")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(intercept=math.inf if 1 in sizes else -math.inf)
    toxic, clean = (F.col("n_toxic"), sizes[1]), (F.col("n_clean"), sizes[0])
    model = ToxicityModel()
    model.lexicon = _speaking(_totals(labelled, _entries_of), toxic, clean, MIN_WEIGHT, "lexicon")
    phrases = _totals(labelled, _with_matcher(model, _phrases))
    model.excepted = _speaking(phrases, clean, toxic, EXCEPTION_WEIGHT, "exceptions")
    _calibrate(model, labelled)
    return model


def _speaking(totals: DataFrame, own: tuple[Column, int], other: tuple[Column, int], least: float, name: str) -> str:
    """The path of a table (entry, weight) of the entries of ``totals`` that speak for the
    label of which ``own`` has the number of texts with the entry, and of all texts."""
    tested = stage(totals.where(own[0] >= MIN_DOCS), f"{name}-tested")
    weighed = tested.withColumn("weight", log_odds(*own, *other))
    by_chance_in_all = by_chance(*own, *other) * tested.count()
    found = weighed.where((F.col("weight") >= least) & (by_chance_in_all <= CHANCE))
    path = shared_folder(totals.sparkSession, name)
    found.select("entry", "weight").write.parquet(path)
    return path


def _phrases(text: str | None, matcher: Matcher) -> set[str]:
    """Two-word phrases around the matched words of a text."""
    words, found, at = fold(text), set(), 0
    hits = matcher.hits(words)
    for i, word in enumerate(words):
        if at in hits:
            found |= {f" {' '.join(words[j : j + 2])} " for j in (i - 1, i) if 0 <= j < len(words) - 1}
        at += len(word) + 1
    return found


def _with_matcher(model: ToxicityModel, emit):
    cache: list[Matcher] = []

    def run(text):
        if not cache:
            cache.append(_matcher(model))
        return emit(text, cache[0])

    return run


def _calibrate(model: ToxicityModel, labelled: DataFrame) -> None:
    scored = raw_scores(labelled, ["toxic", "weight"], model)
    points = scored.groupBy(
        F.col("toxic").cast("double").alias("label"),
        F.log1p("total").alias("sum"),
        density(F.col("total"), F.col("n_words")).alias("density"),
    ).agg(F.sum("weight").alias("weight"))
    points = VectorAssembler(inputCols=["sum", "density"], outputCol="features").transform(points)
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(points)
    model.intercept = float(fitted.intercept)
    model.per_sum, model.per_density = (float(x) for x in fitted.coefficients)


def _score(batches, model: ToxicityModel, keep: list[str]):
    matcher = _matcher(model)
    for batch in batches:
        totals, sizes = [], []
        for text in batch.column("text"):
            words = fold(text.as_py())
            sizes.append(len(words))
            totals.append(float(sum(matcher.hits(words).values())))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(totals, pa.float64()), pa.array(sizes, pa.int64())],
            [*keep, "total", "n_words"],
        )


def raw_scores(docs: DataFrame, keep: list[str], model: ToxicityModel) -> DataFrame:
    """The columns ``keep`` with ``total`` and ``n_words`` of each text."""
    names = [f"kept_{i}" for i in range(len(keep))]
    scored = docs.select("text", *aliased(keep)).mapInArrow(
        lambda b: _score(b, model, names), f"{aliased_schema(docs, keep)}, total double, n_words long"
    )
    return scored.select(*restored(keep), "total", "n_words")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted to be toxic."""
    model = fit(training_rows(docs, labels))
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    scored = docs.select("text", *aliased(docs.columns)).mapInArrow(
        lambda b: _score(b, model, names),
        f"{aliased_schema(docs, docs.columns)}, total double, n_words long",
    )
    score = model.probability(F.col("total"), F.col("n_words"))
    return scored.where(score < 0.5).select(*restored(docs.columns))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight) of the documents that labels are learned from; a row stands for
    ``weight`` labelled ones of its kind."""
    known = labels.where((remainder() != 0) & F.col("toxic").cast("int").isin(0, 1))
    known = known.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    rates = {r["toxic"]: min(1.0, LABELLED / r["n"]) for r in counts} or {0: 1.0}
    rate = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[F.col("toxic")]
    drawn = known.withColumn("weight", 1 / rate).where(F.pmod(F.xxhash64("label_id"), F.lit(_DRAWS)) < rate * _DRAWS)
    rows = docs.select("doc_id", "text")
    # about LABELLED numbers a label, whatever the number of labels
    return rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("text", "toxic", "weight")


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    model = fit(training_rows(docs, labels))
    score = model.probability(F.col("total"), F.col("n_words"))
    return (
        raw_scores(docs, ["doc_id"], model)
        .select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), score.alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
