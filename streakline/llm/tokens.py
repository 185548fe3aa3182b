"""Encoding of whole texts with a public tokenizer, many documents at a time.

Both byte-level and word-level pre-tokenizers end a token where ASCII letters meet
ASCII punctuation (but not after an apostrophe, which may begin a contraction), around
a single line break, and before a space that stands between two characters that are
not white space. Texts are cut there, equal pieces of a batch are encoded once, and a
bounded memo keeps pieces between batches; the ids are those of the tokenizer on the
whole text. Texts with Unicode white space or with the beginning of a special token,
around which those rules are less plain, are not cut. Pieces are known by 64-bit hashes of
their bytes and length. Texts are lower-cased early, to
share pieces, unless they hold combining marks: some of these compose with the small
letter only, and tokenizers compose before they lower-case.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from streakline.llm.common import kept

BATCH_BYTES = 1 << 20
MEMO_PIECES = 1_000_000
UNCUT = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<[|]")
MARKED = re.compile("[\u0300-\u036f]")
CUT = re.compile(rb"(?<=[^ \t\n\r\x0b\x0c])(?= [^ \t\n\r\x0b\x0c])")
_BASE = 0x9E3779B97F4A7C15
_LENGTH = np.uint64(0xD1342543DE82EF95)
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, dtype=np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1 of all i in a row."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Memo:
    """The ids of pieces by the pieces' hashes, in arrays."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or would stand, and whether it does."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return at, np.zeros(len(at), bool)
        return at, self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes

    def add(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """Pieces by rising hashes, none of which is known, with their ids in a row."""
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.insert(self.counts, at, counts)
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of these pieces has, and all of them in a row."""
        counts = self.counts[at]
        return counts, self.flat[ragged(self.starts[at], counts)]


def encoder_of(path: str, lower: bool = False) -> Encoder:
    """The worker process's encoder, with the vocabulary and the pieces of earlier tasks."""
    return kept(("encoder", path, lower), lambda: Encoder(path, lower))


class Encoder:
    """``lower`` tells that the tokenizer reads letters of both cases alike."""

    def __init__(self, path: str, lower: bool = False):
        self.lower = lower
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.older = Memo(), Memo()
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and how many each text has."""
        counts, parts = np.zeros(len(texts), np.int64), []
        group: list[tuple[int, bytes, bool]] = []
        size = 0
        for i, text in enumerate(texts):
            cut = not UNCUT.search(text)
            data = text.encode()
            if cut and self.lower and (text.isascii() or not MARKED.search(text)):
                data = data.lower()
            for piece in _bounded(data) if cut else [data]:
                if size and size + len(piece) > BATCH_BYTES:
                    parts.append(self._group(group, counts))
                    group, size = [], 0
                group.append((i, piece, cut))
                size += len(piece)
        parts.append(self._group(group, counts))
        return np.concatenate(parts), counts

    def _group(self, group: list[tuple[int, bytes, bool]], counts: np.ndarray) -> np.ndarray:
        group = [g for g in group if g[1]]
        if not group:
            return np.zeros(0, np.uint32)
        data = b"".join(g[1] for g in group)
        byte = np.frombuffer(data, np.uint8)
        if len(byte) > len(self.powers):
            n = max(len(byte), 2 * BATCH_BYTES)
            self.powers = _powers(_BASE, n)
            self.inverse = _powers(pow(_BASE, -1, 2**64), n)
        lengths = np.array([len(g[1]) for g in group])
        begins = np.cumsum(lengths) - lengths
        space = _SPACES[byte]
        cut = np.zeros(len(byte), bool)
        alone = space[1:-1] & ~space[:-2] & ~space[2:]
        cut[1:-1] = alone & ((byte[1:-1] == 32) | (byte[1:-1] == 10))
        cut[2:] |= alone & (byte[1:-1] == 10)
        letter, mark = _LETTERS[byte], _MARKS[byte]
        cut[1:] |= letter[:-1] & mark[1:]
        cut[1:] |= mark[:-1] & letter[1:] & (byte[:-1] != 39)
        for (_, _, wanted), at, n in zip(group, begins, lengths, strict=True):
            if not wanted:
                cut[at : at + n] = False
        cut[begins] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(byte))
        prefix = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum(_TABLE[byte] * self.powers[: len(byte)], out=prefix[1:])
        hashes = (prefix[ends] - prefix[starts]) * self.inverse[starts]
        hashes ^= (ends - starts).astype(np.uint64) * _LENGTH
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(data, unique, starts[first], ends[first])
        at, _ = self.memo.find(unique)
        each, ids = self.memo.ids(at[which])
        owner = np.searchsorted(begins, starts, "right") - 1
        np.add.at(counts, np.array([g[0] for g in group])[owner], each)
        if len(self.memo.hashes) > MEMO_PIECES:  # what is still in use moves on when it is next seen
            self.memo, self.older = Memo(), self.memo
        return ids

    def _learn(self, data: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Take the pieces of ``data`` into the memo, from the older one or by encoding them."""
        new = ~self.memo.find(hashes)[1]
        at, known = self.older.find(hashes)
        old = new & known
        if old.any():
            self.memo.add(hashes[old], *self.older.ids(at[old]))
        new &= ~known
        counts, parts = [], array("I")
        pieces = list(zip(starts[new].tolist(), ends[new].tolist(), strict=True))
        for i in range(0, len(pieces), 4096):
            some = [data[a:b].decode() for a, b in pieces[i : i + 4096]]
            for one in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                ids = one.ids
                counts.append(len(ids))
                parts.extend(ids)
        if pieces:
            self.memo.add(hashes[new], np.array(counts), np.frombuffer(parts, np.uint32))


def _bounded(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about BATCH_BYTES, cut where a token ends for certain."""
    at = 0
    while len(data) - at > BATCH_BYTES:
        found = CUT.search(data, at + BATCH_BYTES)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def text_groups(lengths: list[int]) -> Iterator[slice]:
    """Slices of rows whose texts hold about BATCH_BYTES together."""
    begin = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > BATCH_BYTES:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))
