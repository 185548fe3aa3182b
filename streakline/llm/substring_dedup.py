"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text; every word under a window whose
word sequence also starts elsewhere is removed. The work is dealt out in blocks of
about ``BLOCK_CHARS`` characters by a hash of the row.

1. Each window picks an anchor, the ``ANCHOR``-word phrase of least hash within it, so
   equal windows pick equal anchors, and about one word in twelve starts one. Anchors
   are counted over the corpus; only those found twice can lie in a recurring window.
2. The windows of one anchor form a stretch. Stretches of recurring anchors are
   counted by content. Where an anchor has several different stretches, their windows
   are counted one by one. Windows found twice are confirmed; together they make the
   recurring passages.
3. Each block compiles an Aho-Corasick automaton (pyahocorasick) of the passages that
   touch it, a bounded shard, and streams its documents through it once; each hit
   covers its words.

Every count is a partial sum by task first, so a passage in a third of all texts sends
one row a block. Windows are told apart by 128 bits (anchor and window hash).

Null and empty texts have no words and lose none; rows that repeat are documents of
their own, so their long passages go from each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import aliased, aliased_schema, restored, stage, table
from streakline.llm.words import Sequences, Words, slices

WINDOW = 35
ANCHOR = 12
BLOCK_CHARS = 2_000_000
POSITION_BITS = np.uint64(28)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    reach, least = 1, values
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Stretches:
    """The stretches of the windows of ``texts``.

    first, last: their first and last window, as word numbers; anchor: the hash of
    the anchor that all these windows pick.
    """

    def __init__(self, texts: list[str | None]):
        self.words = Words([(t or "").encode() for t in texts])
        self.sequences: Sequences = self.words.sequences()
        n = len(self.words.hashes)
        empty = np.zeros(0, np.int64)
        self.first = self.last = empty
        self.anchor = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        at = np.arange(n - ANCHOR + 1)
        grams = self.sequences.hash(at, at + ANCHOR)
        keyed = ((grams >> POSITION_BITS) << POSITION_BITS) | at.astype(np.uint64)
        picked = (_sliding_min(keyed, WINDOW - ANCHOR + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
        text = self.words.text
        window = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
        if not len(window):
            return
        picked = picked[window]
        new = np.ones(len(window), bool)
        new[1:] = (picked[1:] != picked[:-1]) | (np.diff(window) != 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(window)) - 1
        self.first, self.last, self.anchor = window[begin], window[end], grams[picked[begin]]

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.last, self.anchor = self.first[chosen], self.last[chosen], self.anchor[chosen]

    def contents(self) -> np.ndarray:
        """A hash of the words of each stretch."""
        return self.sequences.hash(self.first, self.last + WINDOW)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, anchor, n) counted by batch."""
    for batch in slices(batches):
        blocks = batch.column("block").to_numpy()
        found = Stretches(batch.column("text").to_pylist())
        pair = np.empty(len(found.first), [("block", np.int32), ("anchor", np.uint64)])
        pair["block"] = blocks[found.words.text[found.first]] if len(pair) else 0
        pair["anchor"] = found.anchor
        order = np.lexsort((pair["block"], pair["anchor"]))
        pair = pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        begin = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(pair["block"][begin]),
                _longs(np.ascontiguousarray(pair["anchor"][begin])),
                pa.array(np.diff(np.append(begin, len(pair)))),
            ],
            ["block", "anchor", "n"],
        )


def find_stretches(docs: pa.Table, anchors: pa.Table) -> pa.Table:
    """The stretches of a block whose anchor recurs: (block, anchor, stretch, n, windows)."""
    found = Stretches(docs.column("text").to_pylist())
    recurring = anchors.column("anchor").to_numpy().view(np.uint64)
    found.keep(np.isin(found.anchor, recurring))
    contents = found.contents()
    pair = np.stack([found.anchor, contents], 1)
    _, begin, n = np.unique(pair, axis=0, return_index=True, return_counts=True)
    first, sizes = found.first[begin], (found.last - found.first)[begin] + 1
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    windows = found.sequences.hash(at, at + WINDOW)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    block = docs.column("block")[0] if docs.num_rows else anchors.column("block")[0]
    return pa.table(
        {
            "block": pa.array(np.full(len(begin), block.as_py(), np.int32)),
            "anchor": _longs(found.anchor[begin]),
            "stretch": _longs(contents[begin]),
            "n": pa.array(n.astype(np.int64)),
            "windows": pa.ListArray.from_arrays(offsets, _longs(windows)),
        }
    )


def passages(found: Stretches, confirmed: pa.Table, codes: np.ndarray) -> list[tuple[int, ...]]:
    """The distinct confirmed passages of a block as sequences of word codes."""
    keys = zip(*(confirmed.column(c).to_pylist() for c in ("anchor", "stretch")), strict=True)
    positions = dict(zip(keys, confirmed.column("positions").to_pylist(), strict=True))
    made: dict[tuple[int, ...], None] = {}
    own = zip(
        found.anchor.view(np.int64).tolist(),
        found.contents().view(np.int64).tolist(),
        found.first.tolist(),
        found.last.tolist(),
        strict=True,
    )
    for anchor, stretch, first, last in own:
        if (anchor, stretch) not in positions:
            continue
        chosen = positions.pop((anchor, stretch))  # one stretch of a kind gives the pattern
        if chosen is None:
            made[tuple(codes[first : last + WINDOW].tolist())] = None
            continue
        chosen = np.sort(np.asarray(chosen))
        for run in np.split(chosen, np.flatnonzero(np.diff(chosen) != 1) + 1):
            made[tuple(codes[first + run[0] : first + run[-1] + WINDOW].tolist())] = None
    return list(made)


def covered_words(found: Stretches, confirmed: pa.Table) -> np.ndarray:
    """Which words of a block lie in a confirmed passage."""
    words = found.words
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    if confirmed.num_rows:
        codes = np.unique(words.hashes, return_inverse=True)[1] + 1
        patterns = passages(found, confirmed, codes)
        if patterns:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for pattern in patterns:
                automaton.add_word(pattern, len(pattern))
            automaton.make_automaton()
            # code 0 stands between texts, so no hit runs over an end
            line = np.insert(codes, words.first[1:-1], 0)
            shift = np.insert(words.text, words.first[1:-1], 0)
            hits = np.fromiter(
                (v for hit in automaton.iter(tuple(line.tolist())) for v in hit), np.int64
            ).reshape(-1, 2)
            last = hits[:, 0] - shift[hits[:, 0]]
            np.add.at(covered, last - hits[:, 1] + 1, 1)
            np.add.at(covered, last + 1, -1)
    return np.cumsum(covered[:-1]) > 0


def remove_passages(docs: pa.Table, confirmed: pa.Table, keep: list[str]) -> pa.Table:
    found = Stretches(docs.column("text").to_pylist())
    covered = covered_words(found, confirmed)
    words = found.words
    texts, spans = [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        gone = covered[a:b]
        kept = np.flatnonzero(~gone) + a
        pieces = zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)
        texts.append(b" ".join([words.data[s:e] for s, e in pieces]).decode())
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        spans.append([{"first": s, "last": e - 1} for s, e in edges.reshape(-1, 2).tolist()])
    removed = np.add.reduceat(np.append(covered, False), words.first[:-1]) if docs.num_rows else []
    sizes = np.diff(words.first)
    removed = np.where(sizes == 0, 0, removed)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.table(
        {k: docs.column(k) for k in keep}
        | {
            "kept_text": pa.array(texts, pa.string()),
            "n_words": pa.array(sizes.astype(np.int64)),
            "n_removed": pa.array(np.asarray(removed, np.int64)),
            "removed": pa.array(spans, span),
        }
    )


def confirm(stretches: DataFrame) -> DataFrame:
    """(anchor, stretch, positions): which windows of a stretch recur, null for all."""
    kinds = stage(
        stretches.groupBy("anchor", "stretch").agg(
            F.sum("n").alias("n"), F.any_value("windows").alias("windows")
        ),
        "kinds",
    )
    several = (
        kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    )
    windows = kinds.join(several, "anchor", "left_semi").select(
        "anchor", "stretch", "n", F.posexplode("windows").alias("at", "window")
    )
    twice = (
        windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    )
    partly = (
        windows.join(twice, ["anchor", "window"], "left_semi")
        .groupBy("anchor", "stretch")
        .agg(F.collect_list("at").alias("positions"))
    )
    whole = kinds.where("n > 1").join(several, "anchor", "left_anti")
    return partly.union(
        whole.select("anchor", "stretch", F.lit(None).cast("array<int>").alias("positions"))
    )


def remove_repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with kept_text, n_words, n_removed and the removed
    word spans of column ``text``."""
    return cut_passages(docs, keep).select(
        *restored(keep),
        "kept_text",
        "n_words",
        "n_removed",
        "removed",
    )


def cut_passages(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``remove_repeats`` with the columns ``keep`` under the names of ``aliased``, which
    clash with none of the others."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = chars // BLOCK_CHARS + 1
    dealt = docs.select(
        F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keep], "text"), F.lit(n_blocks)).cast("int").alias("block"),
        F.col("text"),
        *aliased(keep),
    )
    anchors = stage(
        dealt.select("block", "text").mapInArrow(count_anchors, "block int, anchor long, n long"),
        "anchors",
    )
    recurring = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = anchors.select("block", "anchor").join(recurring, "anchor", "left_semi").distinct()
    stretches = stage(
        dealt.select("block", "text")
        .groupBy("block")
        .cogroup(wanted.groupBy("block"))
        .applyInArrow(
            find_stretches,
            "block int, anchor long, stretch long, n long, windows array<long>",
        ),
        "stretches",
    )
    confirmed = stretches.select("block", "anchor", "stretch").join(
        confirm(stretches), ["anchor", "stretch"]
    )
    names = [f"kept_{i}" for i in range(len(keep))]
    return (
        dealt.groupBy("block")
        .cogroup(confirmed.groupBy("block"))
        .applyInArrow(
            lambda left, right: remove_passages(left, right, names),
            f"{aliased_schema(docs, keep)}, kept_text string, n_words long, n_removed long, "
            "removed array<struct<first:long,last:long>>",
        )
    )


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), ["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
with docs as (
  select row_number() over () as uid, doc_id, list_filter(regexp_split_to_array(
    coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
), windows as (
  select uid, i, md5_number(array_to_string(words[i:i + 34], ' ')) as w
  from docs, unnest(range(1, len(words) - 33)) as t(i)
), twice as (
  select w from windows group by w having count(*) > 1
), covered as (
  select uid, list(distinct i + k) as gone
  from windows join twice using (w), unnest(range(0, 35)) as t(k) group by uid
), words as (
  select uid, i, words[i] as word from docs, unnest(range(1, len(words) + 1)) as t(i)
), gone as (
  select uid, unnest(gone) as i from covered
), kept as (
  select uid, count(*) as n, string_agg(word, ' ' order by i) as text
  from words anti join gone using (uid, i) group by uid
)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (uid)
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {"op1_substring_dedup": SQL}
