"""Sets of day numbers as arrays of BIGINT, and arithmetic on them.

A word holds 63 days, so that its sign bit stays free and no step can overflow. Sets are
built by ``bit_or``, whose buffers are plain numbers: an aggregation of any number of words
stays in a hash table, and sets of the same length merge by ``bit_or`` again. The functions
take a set as the list of its words, which the caller knows from the number of days.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_DAYS = 63


def n_words(days: int) -> int:
    return -(-days // WORD_DAYS)


def set_of(day: Column, days: int) -> Column:
    """Aggregate: the set of the numbers ``day`` from 0 to ``days`` - 1; NULL adds nothing."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(day, F.lit(WORD_DAYS)))
    place = F.floor(day / WORD_DAYS)
    return F.array(*[F.coalesce(F.bit_or(F.when(place == i, bit)), F.lit(0)) for i in range(n_words(days))])


def union_of(bits: Column, days: int) -> Column:
    """Aggregate: the union of sets."""
    return F.array(*[F.bit_or(word) for word in words(bits, days)])


def words(bits: Column, days: int) -> list[Column]:
    return [F.get(bits, F.lit(i)) for i in range(n_words(days))]


def size(of: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in of])


def members(bits: Column, days: int) -> Column:
    """The numbers in the set, rising."""
    word = lambda d: F.get(bits, F.floor(d / WORD_DAYS).cast("int"))
    inside = lambda d: F.getbit(word(d), d % WORD_DAYS) == 1
    return F.filter(F.sequence(F.lit(0), F.lit(days - 1)), inside)


def run_starts(of: Sequence[Column]) -> list[Column]:
    """The first day of each run of days."""
    full = 2**WORD_DAYS - 1
    out, carry = [], F.lit(0).cast("bigint")
    for w in of:
        before = F.shiftleft(w, 1).bitwiseAND(F.lit(full)).bitwiseOR(carry)
        out.append(w.bitwiseAND(F.bitwise_not(before)))
        carry = F.shiftright(w, WORD_DAYS - 1)
    return out


def run_ends(of: Sequence[Column]) -> list[Column]:
    """The last day of each run of days."""
    out, carry = [], F.lit(0).cast("bigint")
    for w in reversed(of):
        after = F.shiftright(w, 1).bitwiseOR(F.shiftleft(carry, WORD_DAYS - 1))
        out.append(w.bitwiseAND(F.bitwise_not(after)))
        carry = w.bitwiseAND(F.lit(1).cast("bigint"))
    return out[::-1]


def _lowest(word: Column) -> Column:
    return word.bitwiseAND(-word)


def first(of: Sequence[Column]) -> Column:
    """The least number; NULL for an empty set."""
    found = [F.when(w != 0, i * WORD_DAYS + F.bit_count(_lowest(w) - 1)) for i, w in enumerate(of)]
    return F.coalesce(*found)


def without_first(of: Sequence[Column]) -> list[Column]:
    """The set without its least number."""
    out, empty = [], F.lit(True)
    for w in of:
        out.append(F.when(empty & (w != 0), w.bitwiseAND(w - 1)).otherwise(w))
        empty = empty & (w == 0)
    return out


def size_below(of: Sequence[Column], other: Sequence[Column]) -> Column:
    """How many numbers of ``of`` lie below the least one of ``other``; NULL if that is empty."""
    found, before = [], F.lit(0)
    for w, o in zip(of, other, strict=True):
        found.append(F.when(o != 0, before + F.bit_count(w.bitwiseAND(_lowest(o) - 1))))
        before = before + F.bit_count(w)
    return F.coalesce(*found)
