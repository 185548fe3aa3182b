r"""Quality rules whose failures are judged by host.

Each document gets its base figures from expressions on its own row. Failures are
counted by host (``source``) after one partial aggregation, so a host with a third of
all rows sends one row a task. A beta prior is fitted to the hosts' failure rates
by moments; the shrunk rate (failures + a) / (documents + a + b) keeps small hosts
near the mean. Hosts at or over ``host_limit`` are refused, and that verdict goes
back to their documents.

Words are maximal runs of characters outside ASCII white space. A word counts as
repeated if a 3-word window over it occurs at least twice in its document.
Null texts have no words, empty lines are no repeats, a null source is a host of its
own, repeated rows are judged each, an empty table gives an empty result. Fewer than
two hosts, or hosts that vary no more than chance, leave the rate of each host
shrunk to the mean by ``MAX_STRENGTH``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import SPACE, let, stage, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
HOST_LIMIT = 0.5
MAX_STRENGTH = 1e6


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the array holds at least twice."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
            i.alias("at"),
        ),
    )
    return F.when(F.size(words) >= 3, let(F.sort_array(windows), _covered)).otherwise(0)


def _covered(ordered: Column) -> Column:
    """Words under the windows of a sorted array of (h, at) whose h is not alone."""
    starts = F.transform(
        F.filter(
            F.transform(
                ordered,
                lambda w, i: F.struct(
                    w["at"].alias("at"),
                    (
                        F.coalesce(w["h"] == F.get(ordered, i + 1)["h"], F.lit(False))
                        | F.coalesce(w["h"] == F.get(ordered, i - 1)["h"], F.lit(False))
                    ).alias("twice"),
                ),
            ),
            lambda w: w["twice"],
        ),
        lambda w: w["at"],
    )
    return F.aggregate(
        F.sort_array(starts),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")
        ),
        lambda acc: acc["n"],
    )


def base_figures(docs: DataFrame) -> DataFrame:
    """Every document's base figures and ``base_failed``; keeps doc_id and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    split = docs.select(
        "doc_id",
        "source",
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated")
            ),
        ).alias("words"),
    )
    counted = split.select(
        "doc_id",
        "source",
        F.col("words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("words.repeated").alias("n_repeat_words"),
    )
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def host_verdicts(figures: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(source, host_docs, host_rate, host_failed), the rate shrunk by the beta prior."""
    hosts = figures.groupBy("source").agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("long")).alias("failures"),
    )
    rate = F.col("failures") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("failures") / F.sum("host_docs")).alias("mean"),
        F.var_pop(rate).alias("variance"),
        F.avg(1 / F.col("host_docs")).alias("noise"),
    ).select(
        "mean",
        # what is left of the variance once the hosts' sampling noise is taken away
        (F.col("variance") - F.col("mean") * (1 - F.col("mean")) * F.col("noise")).alias("between"),
    ).select(
        "mean",
        F.when(
            F.col("between") > 0,
            F.least(
                F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("between") - 1, F.lit(1.0)),
                F.lit(MAX_STRENGTH),
            ),
        ).otherwise(MAX_STRENGTH).alias("strength"),
    )
    mean = prior.select("mean").scalar()
    strength = prior.select("strength").scalar()
    shrunk = (F.col("failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.select("source", "host_docs", shrunk.alias("host_rate")).withColumn(
        "host_failed", F.col("host_rate") >= host_limit
    )


def judge_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Base figures, the host's shrunk rate, and ``kept`` for every document."""
    figures = stage(base_figures(docs), "figures")
    hosts = host_verdicts(figures, host_limit).withColumnRenamed("source", "host")
    return figures.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed")
    )


def op2_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


SQL = r"""
with words as (
  select doc_id, source, coalesce(text, '') as text, row_number() over () as row,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from words, unnest(range(1, len(words) - 1)) as t(i)
), twice as (
  select row, i from windows qualify count(*) over (partition by row, w) > 1
), repeated as (
  select row, count(distinct i + k) as n from twice, unnest(range(0, 3)) as t(k) group by row
), figures as (
  select doc_id, source, len(words) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
    len(words) < 50 or 100 * coalesce(n, 0) > 50 * len(words) as base_failed
  from words left join repeated using (row)
), hosts as (
  select source as host, count(*) as docs, sum(base_failed::int)::double as failures
  from figures group by source
), prior as (
  select sum(failures) / sum(docs) as mean,
    var_pop(failures / docs) - sum(failures) / sum(docs) * (1 - sum(failures) / sum(docs)) * avg(1.0::double / docs) as between_
  from hosts
), strengths as (
  select mean, case when between_ > 0 then least(greatest(mean * (1 - mean) / between_ - 1, 1.0), 1e6) else 1e6 end as s
  from prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (failures + mean * s) / (docs + s) < 0.5 as kept
from figures join hosts on source is not distinct from host, strengths
"""

QUERIES = {"op2_host_rules": op2_host_rules}
ORACLES = {"op2_host_rules": SQL}
