"""Fill-in-the-middle rearrangement of texts, by line units, in pyarrow.compute.

A text is split into units of one line with its line break. Two cuts that the document's
number decides divide the units into prefix, middle and suffix, which are written with
sentinels as ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle``
(spm), or left as they are (plain). A batch is worked on in whole columns: the units of
all texts are list arrays, flattened with the indices of their texts and ordinals in
them, filtered by role, made into lists again and joined. No step crosses documents, so
there is no shuffle, and a lost task only repeats its own rows.

Null texts are empty texts; empty texts, and texts that hold a sentinel, stay plain, so
that ``restore`` always finds the text again. A null doc_id draws its cuts from the seed
alone. Repeated rows are rearranged alike; an empty table gives an empty result. Batches
are worked on a megabyte at a time, a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import aliased, aliased_schema, restored, table
from streakline.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"
#: Percentages: of documents that are rearranged, and of these in the order spm.
RATE = 100
SPM_RATE = 50
DRAWS = 4


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers that ``key`` decides."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(DRAWS)]


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(unit, index of its text, ordinal in it) of all units, and each text's number of units."""
    lines = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lines).cast(pa.int64())
    flat, parents = pc.list_flatten(lines), pc.list_parent_indices(lines)
    begins = pc.subtract(pc.cumulative_sum(counts), counts)
    ordinals = pc.subtract(pa.array(np.arange(len(flat))), pc.take(begins, parents))
    # what follows the last line break is a unit without one, or nothing
    last = pc.equal(ordinals, pc.subtract(pc.take(counts, parents), 1))
    real = pc.invert(pc.and_(last, pc.equal(flat, "")))
    units = pc.binary_join_element_wise(flat, pc.if_else(last, "", "\n"), "")
    ended = pc.or_(pc.equal(texts, ""), pc.ends_with(texts, "\n"))
    counts = pc.subtract(counts, ended.cast(pa.int64()))
    return pc.filter(units, real), pc.filter(parents, real), pc.filter(ordinals, real), counts


def _joined(units: pa.Array, sizes: pa.Array) -> pa.Array:
    """The units, of which ``sizes`` belong to each text, joined by text."""
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units), "")


def _modulo(draw: pa.Array, divisor: pa.Array) -> pa.Array:
    return pc.subtract(draw, pc.multiply(pc.divide(draw, divisor), divisor))


def _rearrange(batches: Iterator[pa.RecordBatch], keep: list[str], rate: int, spm_rate: int):
    for batch in slices(batches):
        texts = pc.fill_null(batch.column("text"), "")
        h = [batch.column(f"draw_{i}") for i in range(DRAWS)]
        units, parents, ordinals, counts = _units(texts)
        places = pc.add(counts, 1)
        cuts = _modulo(h[0], places), _modulo(h[1], places)
        first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
        before = pc.less(ordinals, pc.take(first, parents))
        after = pc.greater_equal(ordinals, pc.take(second, parents))
        between = pc.invert(pc.or_(before, after))
        prefix = _joined(pc.filter(units, before), first)
        middle = _joined(pc.filter(units, between), pc.subtract(second, first))
        suffix = _joined(pc.filter(units, after), pc.subtract(counts, second))
        marked = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE)))
        left = pc.greater_equal(_modulo(h[2], pa.scalar(100)), rate)
        plain = pc.or_(pc.or_(pc.equal(texts, ""), marked), left)
        spm = pc.less(_modulo(h[3], pa.scalar(100)), spm_rate)
        psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
        spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
        chars = [pc.if_else(plain, None, pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in keep),
                counts,
                pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
                pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
                *chars,
            ],
            [*keep, "n", "form", "output", "prefix_chars", "middle_chars"],
        )


def fill_in_middle(
    docs: DataFrame,
    keep: list[str],
    key: str = "doc_id",
    seed: str = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, then n units, form, output, prefix_chars and
    middle_chars (code points, null if plain) of each row's ``text``."""
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(
        "text", *(d.alias(f"draw_{i}") for i, d in enumerate(draws(F.col(key), seed))), *aliased(keep)
    )
    kept = aliased_schema(docs, keep)
    found = rows.mapInArrow(
        lambda b: _rearrange(b, names, rate, spm_rate),
        f"{kept + ', ' if kept else ''}n long, form string, output string, prefix_chars long, middle_chars long",
    )
    return found.select(*restored(keep), "n", "form", "output", "prefix_chars", "middle_chars")


def restore(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made; no part of it holds a sentinel."""

    def parts(mark: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(PREFIX) + 1))
        rest = F.substring_index(body, mark, -1)
        return F.substring_index(body, mark, 1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_in_middle(table(spark, folder, "documents"), ["doc_id"])
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
with units as (
    select doc_id, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
        sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents
), numbers as (
    select *, len(u) as n,
        cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
        cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
    from units
), cuts as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100
            as plain
    from numbers
), parts as (
    select *, coalesce(array_to_string(u[1:a], ''), '') as p,
        coalesce(array_to_string(u[a + 1:b], ''), '') as m,
        coalesce(array_to_string(u[b + 1:n], ''), '') as s
    from cuts
)
select doc_id, cast(n as bigint) as n,
    case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
    case when not plain then cast(length(p) as bigint) end as prefix_chars,
    case when not plain then cast(length(m) as bigint) end as middle_chars,
    sha256(case when plain then t when h4 % 100 < 50 then '<S>' || s || '<P>' || p || '<M>' || m
        else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
    sha256(p || m || s) as restored_sha256
from parts
"""

QUERIES = {"op12_fill_middle": op12_fill_middle}
ORACLES = {"op12_fill_middle": SQL}
