"""URL filters by a cascade of Bloom filters over the corpus's own keys.

A rule is a host and a path. It fits its host and all subdomains when the path of
the url starts with the rule's path; the longest fitting rule wins. Every url has a
few candidate keys: each host suffix joined with the path prefixes of the lengths
that rules have. The distinct candidates of all urls are the complete universe of
keys that will ever be asked for. Level 1 of the cascade holds the listed keys,
level 2 the keys of the universe that level 1 takes for listed, level 3 the listed
keys that level 2 takes for false, and so on until a level makes no error. The
answer is then exact for every key of the universe, and looking one up is an
expression on the row: no join, no shuffle.

Only the bits of the filters reach the driver; their size follows the rule list
(``BITS_PER_KEY`` a key) and is checked against ``MAX_BITS``.

Nulls and edges: a null url, or one without ``://``, has an empty host and path and
fits no rule; an empty table gives an empty result; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import lower_ascii, stage, table

BITS_PER_KEY = 10
HASHES = 5
MAX_BITS = 1 << 30
MAX_LEVELS = 40


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        bitmap = F.lit(np.array(self.words, dtype=np.int64))

        def bit(position: Column) -> Column:
            word = F.get(bitmap, F.shiftright(position, 6).cast("int"))
            return F.getbit(word, (position % 64).cast("int")) == 1

        found = [bit(p) for p in positions(key, self.seed, self.bits)]
        result = found[0]
        for one in found[1:]:
            result = result & one
        return result


def positions(key: Column, seed: int, bits: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(key, F.lit(seed * HASHES + i)), F.lit(bits)) for i in range(HASHES)
    ]


def build_level(keys: DataFrame, count: int, seed: int) -> Level:
    """A Bloom filter of the ``count`` keys in column ``key``."""
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {bits} bits is over the limit of {MAX_BITS}")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), seed, bits))).alias("at"))
    set_words = (
        at.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64)
    for row in set_words:
        words[row["word"]] = row["bits"]
    return Level(seed, bits, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @classmethod
    def fit(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """Exact membership of ``listed`` for every key of ``universe`` (columns ``key``)."""
        listed = stage(listed.select("key").where("key is not null").distinct(), "listed")
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        levels: list[Level] = []
        while count := inside.count():
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not converge")
            level = build_level(inside, count, len(levels))
            levels.append(level)
            wrong = stage(outside.where(level.holds(F.col("key"))), "level")
            inside, outside = wrong, inside
        return cls(tuple(levels))

    def holds(self, key: Column) -> Column:
        answer = F.lit(False)
        for depth, level in reversed(list(enumerate(self.levels, 1))):
            inner = level.holds(key)
            if depth == len(self.levels):
                answer = inner
            else:
                answer = inner & ~answer
        return answer


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    part = lambda group: F.coalesce(
        F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", group), F.lit("")
    )
    return lower_ascii(part(1)), part(2)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule fitting (host, path) can have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.substring(path, 1, n) for n in lengths]) if lengths else F.array(),
        lambda p: F.length(p).isin(lengths),
    )
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))
    )
    # a short path gives the same prefix for several lengths
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for ``pages`` (page_id, url).

    ``rules`` has host, path and verdict (block or allow); a key listed with both
    verdicts is blocked. Urls that fit no rule are allowed.
    """
    rules = rules.select(
        F.concat(lower_ascii(F.col("host")), F.col("path")).alias("key"), "verdict", "path"
    ).where("key is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "keys", candidates(F.col("host"), F.col("path"), lengths)
    )
    universe = stage(parsed.select(F.explode("keys").alias("key")).distinct(), "universe")
    block = Cascade.fit(universe, rules.where("verdict = 'block'"))
    allow = Cascade.fit(universe, rules.where("verdict = 'allow'"))
    best = F.array_max(
        F.transform(
            F.filter(F.col("keys"), lambda k: block.holds(k) | allow.holds(k)),
            lambda k: F.struct(F.length(k).alias("length"), k.alias("key")),
        )
    )["key"]
    return parsed.withColumn("rule", best).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(block.holds(F.col("rule")), "block").otherwise("allow").alias("verdict"),
    )


#: Fixed values of the query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op10_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(
        "select * from values "
        + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
        + " as rules(host, path, verdict)"
    )
    return judge_urls(table(spark, folder, "pages"), rules)


SQL = """
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), parts as (
  select page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) as path
  from rest
), fits as (
  select *, case
    when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
    when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/'
    when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule
  from parts
)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from fits
"""

QUERIES = {"op10_url_cascade": op10_url_cascade}
ORACLES = {"op10_url_cascade": SQL}
