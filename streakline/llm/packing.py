"""Hierarchical packing of documents into windows of several lengths.

Tiers are the powers of two 2048, 1024, 512 and 256. A document's ids fill whole
2048 windows; what is left is routed to the smallest tier that holds it. Each tier
is packed from the longest down: a document opens a window of its tier, and the gap
is filled from the shorter tiers, the longest that fits first; if none fits, one is
cut, and its rest goes to the tier of its new length. Windows are therefore full.
What the end of a partition leaves over is laid end to end into full windows of
ever shorter tiers; under 256 ids a partition remain in one padded window.

Step groups hold the same number of places each: ``STEP_TOKENS`` / tier windows of one
tier, numbered over all partitions from a table of their counts, so only the last group
of a tier is short. A padded window counts as one of 2048. Documents are packed in blocks
of ``BLOCK_TOKENS`` ids as they are read, so documents are not shuffled and memory is
bounded by the block; a document longer than that is one block of its own.

A null text has only the end id; repeated rows are packed each; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakline.llm.common import stage, table
from streakline.llm.tokens import encoder_of, text_groups

TIERS = (256, 512, 1024, 2048)
END = 1
BLOCK_TOKENS = 1 << 19
STEP_TOKENS = 16 * TIERS[-1]
#: Sequence numbers of a partition begin at its number times two to this power.
SHARD_BITS = 36
#: ``turn`` numbers the windows of a tier within a partition.
SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "tier int, turn long, ids array<int>, ids_crc32 long"
)

#: (document, start, length)
Piece = tuple[int, int, int]


class Packer:
    """Fills windows from pieces; what is not yet in a full window waits in its tier."""

    def __init__(self) -> None:
        self.waiting: list[deque[Piece]] = [deque() for _ in TIERS]
        self.held = [0] * len(TIERS)

    @property
    def tokens(self) -> int:
        return sum(self.held)

    def add(self, document: int, n: int) -> Iterator[tuple[int, list[Piece]]]:
        longest = TIERS[-1]
        for start in range(0, n - n % longest, longest):
            yield longest, [(document, start, longest)]
        if n % longest:
            self._wait((document, n - n % longest, n % longest))

    def _wait(self, piece: Piece) -> None:
        tier = bisect_left(TIERS, piece[2])
        self.waiting[tier].append(piece)
        self.held[tier] += piece[2]

    def _take(self, tier: int) -> Piece:
        piece = self.waiting[tier].popleft()
        self.held[tier] -= piece[2]
        return piece

    def _cut(self, piece: Piece, n: int) -> Piece:
        if n < piece[2]:
            self._wait((piece[0], piece[1] + n, piece[2] - n))
        return piece[0], piece[1], min(n, piece[2])

    def full(self) -> Iterator[tuple[int, list[Piece]]]:
        """Windows that can be filled, the longest tiers first."""
        for tier in range(len(TIERS) - 1, -1, -1):
            while self.waiting[tier] and sum(self.held[: tier + 1]) >= TIERS[tier]:
                pieces = [self._take(tier)]
                gap = TIERS[tier] - pieces[0][2]
                while gap:
                    pieces.append(self._cut(self._filler(tier, gap), gap))
                    gap -= pieces[-1][2]
                yield TIERS[tier], pieces

    def _filler(self, tier: int, gap: int) -> Piece:
        """From the longest shorter tier that fits the gap, else any that can be cut."""
        for t in [t for t in range(tier, -1, -1) if TIERS[t] <= gap] + list(range(tier + 1)):
            if self.waiting[t]:
                return self._take(t)
        raise AssertionError("no piece is left to fill a window")

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """Everything that waits, end to end; only the last window is not full."""
        line = [self._take(t) for t in range(len(TIERS) - 1, -1, -1) for _ in range(len(self.waiting[t]))]
        left = sum(p[2] for p in line)
        while left:
            size = next((t for t in reversed(TIERS) if t <= left), left)
            pieces, gap = [], size
            while gap:
                document, start, n = line.pop(0)
                used = min(n, gap)
                pieces.append((document, start, used))
                if used < n:
                    line.insert(0, (document, start + used, n - used))
                gap -= used
            left -= size
            yield (size if size in TIERS else TIERS[-1]), pieces


class _Block:
    """Documents whose ids are at hand, and the windows made of them."""

    def __init__(self, shard: int):
        self.base, self.sequences, self.turns = shard << SHARD_BITS, 0, dict.fromkeys(TIERS, 0)
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.packer, self.added = Packer(), 0

    def emit(self, windows: Iterator[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(9)]
        chunks: list[np.ndarray] = []
        for tier, pieces in windows:
            offset = 0
            for document, start, n in pieces:
                doc_id, ids = self.docs[document]
                part = ids[start : start + n]
                chunks.append(part)
                row = (doc_id, start, n, len(ids), self.base + self.sequences, offset, tier)
                row += (self.turns[tier], zlib.crc32(part))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset += n
            self.sequences += 1
            self.turns[tier] += 1
        if chunks:
            offsets = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.concatenate(chunks).astype(np.int32))
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, ids, pa.array(columns[8], pa.int64())], names
            )

    def forget(self) -> None:
        """Drop the ids of documents of which nothing waits."""
        waits = {p[0] for tier in self.packer.waiting for p in tier}
        self.docs = {k: v for k, v in self.docs.items() if k in waits}


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, end: int, lower: bool):
    encoder, block = encoder_of(path, lower), _Block(TaskContext.get().partitionId())
    for batch in batches:
        for part in text_groups(batch.column("chars").to_pylist()):
            rows = batch.slice(part.start, part.stop - part.start)
            ids, counts = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
            windows: list[tuple[int, list[Piece]]] = []
            at = 0
            for doc_id, n in zip(rows.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4")
                at += n
                block.docs[block.added] = (doc_id, own)
                windows += block.packer.add(block.added, len(own))
                block.added += 1
            if block.packer.tokens >= BLOCK_TOKENS:
                windows += block.packer.full()
            yield from block.emit(iter(windows))
            block.forget()
    yield from block.emit(block.packer.full())
    yield from block.emit(block.packer.rest())


def pieces(docs: DataFrame, tokenizer: str, end: int = END, lower: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their window, tier, turn and ids.

    ``lower`` tells that the tokenizer reads letters of both cases alike.
    """
    return docs.select(
        "doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    ).mapInArrow(lambda b: pack_batches(b, tokenizer, end, lower), SCHEMA)


def in_step_groups(found: DataFrame) -> DataFrame:
    """``pieces`` with their step group instead of their turn. The pieces are written once;
    what is joined to them has a row a partition and tier."""
    staged = stage(found, "pieces")
    shard = F.shiftright("sequence_id", SHARD_BITS).alias("shard")
    counts = staged.where("offset = 0").groupBy(shard, "tier").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "shard", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    number = F.col("before") + F.col("turn")
    group = F.floor(number * F.col("tier") / STEP_TOKENS).cast("long")
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1
    own = [c for c in staged.columns if c not in ("turn", "ids", "ids_crc32")]
    rest = [c for c in staged.columns if c in ("ids", "ids_crc32")]
    return (
        staged.select("*", shard)
        .join(firsts, ["shard", "tier"])
        .select(*own, (group * len(TIERS) + tier).alias("step_group"), *rest)
    )


def pack(docs: DataFrame, tokenizer: str, end: int = END, lower: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their window, tier, step group and ids."""
    return in_step_groups(pieces(docs, tokenizer, end, lower))


def packed_digest(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return in_step_groups(pieces(docs, path, lower=True).drop("ids"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digest(table(spark, folder, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
