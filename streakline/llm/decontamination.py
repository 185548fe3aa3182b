r"""Benchmark decontamination by a positional inverted index.

The index holds a table of documents with their words, and postings (term, document,
position) of every term of the benchmark's vocabulary. A phrase is looked up from
its rarest terms: the postings of its ``RAREST`` least frequent terms, each shifted
by the term's offset in the phrase, are intersected on (phrase, document, start);
what is left is compared word by word with the document. ``proximity_matches`` finds
documents that hold all terms of a phrase near its rarest one, in any order.

Only tables of the size of the benchmark are broadcast, after their rows are counted
(``BROADCAST_ROWS``); beyond that they join by a shuffle.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.
A benchmark item gives one phrase for each ``WINDOW`` words, or one of all its words
if it has fewer. Null texts have no words; a null item id is written ``null`` in
lists of items; equal phrases of several items count for each; repeated documents
are judged each; an empty table or benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakline.llm.common import aliased, let, lower_ascii, restored, stage, table

WINDOW = 10
RAREST = 2
BROADCAST_ROWS = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(
        F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != ""
    )


@dataclass
class Index:
    #: uid, line (the words joined by a space), n_words, and columns carried along
    documents: DataFrame
    #: uid, pos, term
    postings: DataFrame
    #: term, n
    counts: DataFrame


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has been counted to have at most BROADCAST_ROWS rows."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df) else df


def build_index(docs: DataFrame, vocabulary: DataFrame, keep: list[str]) -> Index:
    """Index ``docs`` (text, and the columns ``keep``) for the terms of ``vocabulary`` (term)."""
    line = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.array_join(w, " ").alias("line"), F.size(w).cast("long").alias("n")),
    )
    documents = stage(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), line.alias("words"), *aliased(keep)
        )
        .withColumn("line", F.col("words.line"))
        .withColumn("n_words", F.col("words.n"))
        .drop("words"),
        "words",
    )
    known = bounded(vocabulary.select("term").distinct())
    postings = stage(
        documents.select("uid", F.posexplode(F.split("line", " ")).alias("pos", "term")).join(
            known, "term", "left_semi"
        ),
        "postings",
    )
    counts = stage(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    return Index(documents, postings, counts)


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase_id, terms, item_id): every window of ``items`` (item_id, text)."""
    words = words_of(F.col("text"))
    windows = let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>"))
        .when(F.size(w) < window, F.array(w))
        .otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))),
                lambda i: F.slice(w, i, window),
            )
        ),
    )
    exploded = stage(items.select("item_id", F.explode(windows).alias("terms")), "windows")
    numbers = stage(
        exploded.select("terms").distinct().withColumn("phrase_id", F.monotonically_increasing_id()),
        "phrases",
    )
    return exploded.join(numbers, "terms").select("phrase_id", "terms", "item_id")


def ranked_terms(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase_id, size, term, offset, rank), rank 1 the rarest; phrases with a term
    that the index lacks are left out, since they occur nowhere."""
    terms = phrases.select(
        "phrase_id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")
    )
    counted = terms.join(index.counts, "term", "left")
    own = Window.partitionBy("phrase_id")
    return (
        counted.withColumn("found", F.count("n").over(own))
        .where("found = size")
        .withColumn("rank", F.row_number().over(own.orderBy("n", "offset")))
        .select("phrase_id", "size", "term", "offset", "rank")
    )


def exact_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase_id, uid, start, size): every occurrence of every phrase (phrase_id, terms)."""
    phrases = stage(phrases.select("phrase_id", "terms").distinct(), "phrases")
    chosen = ranked_terms(index, phrases).where(F.col("rank") <= RAREST)
    shifted = index.postings.join(bounded(stage(chosen, "rarest")), "term").select(
        "phrase_id", "uid", (F.col("pos") - F.col("offset")).alias("start"), "size"
    )
    lists = (
        shifted.where("start >= 0")
        .groupBy("phrase_id", "uid", "start", "size")
        .agg(F.count(F.lit(1)).alias("lists"))
        .where(F.col("lists") == F.least("size", F.lit(RAREST)))
        .drop("lists")
    )
    # lines and questions meet by a shuffle at every size: the lines move once, and what is
    # asked grows with the corpus
    asked = (
        stage(lists, "candidates")
        .join(bounded(phrases), "phrase_id")
        .groupBy("uid")
        .agg(F.collect_list(F.struct("phrase_id", "start", "size", "terms")).alias("asked"))
    )
    compared = index.documents.select("uid", "line").hint("merge").join(asked, "uid")
    same = let(
        F.split("line", " "),
        lambda w: F.filter("asked", lambda c: F.slice(w, c["start"] + 1, c["size"]) == c["terms"]),
    )
    return compared.select("uid", F.explode(same).alias("c")).select(
        "c.phrase_id", "uid", "c.start", "c.size"
    )


def proximity_matches(index: Index, phrases: DataFrame, slop: int) -> DataFrame:
    """(phrase_id, uid, at): the rarest term of a phrase stands at ``at`` and all its other
    terms stand, in any order, within the phrase's length plus ``slop`` words of it.

    Positions are dealt into stretches of a document as long as the widest reach, and a
    term is looked for in the stretch of the rarest one and in its two neighbours, so a
    document of any length costs what stands near the rarest terms.
    """
    ranked = stage(ranked_terms(index, phrases.select("phrase_id", "terms").distinct()), "terms")
    reach = F.lit((ranked.agg(F.max("size")).first()[0] or 1) + max(slop, 0))
    stretch = F.floor(F.col("pos") / reach)
    rarest = bounded(ranked.where("rank = 1").select("phrase_id", "term", "size"))
    anchors = index.postings.join(rarest, "term").select(
        "phrase_id", "uid", F.col("pos").alias("at"), "size", stretch.alias("own")
    )
    needed = ranked.select("phrase_id", "term").distinct()
    counts = needed.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("needed"))
    around = F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])).alias("stretch")
    wanted = anchors.join(bounded(needed), "phrase_id").select(
        "phrase_id", "uid", "at", "size", "term", around
    )
    places = index.postings.select("uid", "term", "pos", stretch.alias("stretch"))
    near = wanted.join(places, ["uid", "term", "stretch"]).where(
        F.abs(F.col("pos") - F.col("at")) < F.col("size") + slop
    )
    return (
        near.select("phrase_id", "uid", "at", "term")
        .distinct()
        .groupBy("phrase_id", "uid", "at")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(bounded(counts), "phrase_id")
        .where("n = needed")
        .select("phrase_id", "uid", "at")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW
) -> DataFrame:
    """(n_words, n_hit, items) and the columns ``keep`` for every row of ``docs``; they come
    under the names of ``common.aliased``."""
    phrases = stage(phrases_of(items, window), "windows")
    index = build_index(docs, phrases.select(F.explode("terms").alias("term")), keep)
    found = stage(exact_matches(index, phrases), "matches")
    spans = found.select("uid", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = (
        Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = (
        spans.withColumn("reached", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
        .groupBy("uid")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("reached"))).alias("n_hit"))
    )
    owners = phrases.select(
        "phrase_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    ).distinct()
    listed = (
        found.select("uid", "phrase_id")
        .distinct()
        .join(bounded(owners), "phrase_id")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        index.documents.drop("line")
        .join(covered, "uid", "left")
        .join(listed, "uid", "left")
        .select(
            *[f"kept_{i}" for i in range(len(keep))],
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"]
    ).select(
        *restored(["doc_id"]),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with docs as (
  select row_number() over () as uid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from documents
), items as (
  select coalesce(item_id::varchar, 'null') as item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
  from benchmark
), phrases as (
  select distinct item, least(len(words), 10) as n,
    array_to_string(words[i:i + least(len(words), 10) - 1], ' ') as phrase
  from items, unnest(range(1, greatest(len(words) - 10, 0) + 2)) as t(i) where len(words) > 0
), windows as (
  select uid, i, n, array_to_string(words[i:i + n - 1], ' ') as phrase
  from docs, (select distinct n from phrases), unnest(range(1, len(words) - n + 2)) as t(i)
), hits as (
  select uid, i, n, item from windows join phrases using (n, phrase)
), covered as (
  select uid, count(distinct i + k) as n_hit from hits, unnest(range(0, n)) as t(k) group by uid
), listed as (
  select uid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items
  from hits group by uid
)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (uid) left join listed using (uid)
"""

QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": SQL}
