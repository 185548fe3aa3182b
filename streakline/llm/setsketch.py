"""Near-duplicate classes by SetSketch registers.

A text's set is its distinct word shingles. Register i is the truncated exponent
``floor(1 - log_b(min h_i))`` of the least of exponential hashes of the set, so
registers merge by maximum and are locality-sensitive: with ``BASE`` close to 1 two
sets agree in a register about as often as their similarity. ``BANDS`` bands of
``ROWS`` registers name buckets; a pair at the threshold of 0.75 shares one with
probability 1 - (1 - 0.75 ** 3) ** 24, all but two in a million.

1. Texts with equal words are one node; only nodes are compared.
2. Of the nodes that share a bucket, those with under 75 % of their shingles in any
   other such node cannot be linked and leave.
3. Each bucket's leader, its most connected member, is compared with the members of
   other components: one pair a member. The likelihood of the two sketches, jointly
   with the known sizes, discards pairs far below the threshold; the rest are
   verified on their full sets. Components are found, and buckets that still hold
   several get their next leader, while pairs are many and rounds halve them.
4. What is left of a bucket is dealt into blocks of bounded size. A task takes one or
   two blocks, counts the common shingles of all its texts at once by products of
   incidence matrices, and gives a spanning forest of the links: no row a pair.
   Every pair that shares a bucket is thus compared, or already connected.

Verification streams members past their leader's set; leaders with many members are
dealt out over salts. No step holds a group in one task or emits all its pairs. The
comparisons of a bucket whose members stay unlinked still grow with its square.

Null and empty texts have no shingles and stay alone; texts of fewer words than a
shingle have their whole sequence as the only one; repeated rows are equal texts. A
null doc_id is never the smallest of a component, but alone it is its own. An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import ASCII_LOWER, aliased, aliased_schema, forget_kept, restored, stage, table
from streakline.llm.components import components
from streakline.llm.words import Sequences, Words, slices

SHINGLE = 5
#: similar if 100 * intersection >= PERCENT * union
PERCENT = 75
BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
#: Pairs whose likelihoods are worked out together.
PAIRS_AT_ONCE = 1024
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: Members compared with one copy of a leader.
MEMBERS = 256
#: Texts and shingles of a block, expected.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles whose occurrences make one incidence matrix.
COLUMNS = 2048
#: Standard errors below the threshold at which an estimate discards a pair.
ERRORS = 5
#: Similarity so many standard errors below the threshold, as sketches show it.
LEAST = PERCENT / 100 - ERRORS * math.sqrt(PERCENT * (100 - PERCENT) / REGISTERS) / 100
_OTHER = np.uint64(0xA24BAED4963EE407)
_random = np.random.Generator(np.random.PCG64(5))
_XOR = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_TIMES = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """The shingle sets of texts, as sorted 64-bit hashes."""

    def __init__(self, texts: list[str | None]):
        words = Words([(t or "").encode().translate(ASCII_LOWER) for t in texts])
        self.first = words.first
        self.sequences = words.sequences()
        self.hashes = words.hashes

    def set_of(self, i: int) -> np.ndarray:
        a, b = int(self.first[i]), int(self.first[i + 1])
        if b == a:
            return np.zeros(0, np.uint64)
        at = np.arange(a, max(b - SHINGLE, a) + 1)
        return np.unique(self.sequences.hash(at, np.minimum(at + SHINGLE, b)))

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each text's word sequence."""
        a, b = self.first[:-1], self.first[1:]
        return self.sequences.hash(a, b), Sequences(self.hashes, _OTHER).hash(a, b)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        block = (shingles[i : i + 2048, None] ^ _XOR) * _TIMES
        np.minimum(least, block.min(0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers from the least uniform hash of each register."""
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, LIMIT).astype(np.int32)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """Most likely similarity of each pair of sketches, given both set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, None) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    same = np.clip(1 - more - less, 1e-12, None)
    likelihood = above[:, None] * np.log(more) + below[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return grid[np.arange(len(grid)), likelihood.argmax(1)]


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_kept()
    for batch in slices(batches):
        found = Shingles(batch.column("text").to_pylist())
        sizes, sketches = [], []
        for i in range(batch.num_rows):
            own = found.set_of(i)
            sizes.append(len(own))
            sketches.append(registers(least_hashes(own)) if len(own) else None)
        high, low = found.identities()
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(high.view(np.int64)),
                pa.array(low.view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(sketches, pa.list_(pa.int32())),
            ],
            [*batch.schema.names, "high", "low", "size", "sketch"],
        )


def explode_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_kept()
    for batch in slices(batches):
        nodes = batch.column("node").to_numpy()
        found = Shingles(batch.column("text").to_pylist())
        sets = [found.set_of(i) for i in range(len(nodes))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(nodes, [len(s) for s in sets])),
                pa.array(np.concatenate(sets).view(np.int64)),
            ],
            ["node", "shingle"],
        )


def discard_unlikely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimated similarity does not speak against a link."""
    forget_kept()
    parts = (b.slice(i, PAIRS_AT_ONCE) for b in batches for i in range(0, b.num_rows, PAIRS_AT_ONCE))
    for batch in parts:
        a, b = (
            batch.column(c).flatten().to_numpy().reshape(-1, REGISTERS)
            for c in ("sketch_a", "sketch_b")
        )
        size_a, size_b = (batch.column(c).to_numpy().astype(float) for c in ("size_a", "size_b"))
        likely = joint_similarity(a, b, size_a, size_b) > LEAST
        yield batch.select(["a", "b"]).filter(pa.array(likely))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows in which each leader's text comes before its members'."""
    forget_kept()
    leader, own = None, np.zeros(0, np.uint64)
    for batch in slices(batches):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        found, links = Shingles(batch.column("text").to_pylist()), []
        for i in range(len(a)):
            if b[i] is None:
                leader, own = a[i], found.set_of(i)
                continue
            assert leader == a[i], "a member came before its leader"
            other = found.set_of(i)
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(own) + len(other) - both):
                links.append(i)
        yield batch.select(["a", "b"]).take(pa.array(links, pa.int64()))


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements any two of the sets have in common."""
    counts = np.zeros((len(sets), len(sets)), np.int32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, first, number, times = np.unique(
        np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True
    )
    # columns in the order of the first set that has them, so that like sets meet in few matrices
    order = np.lexsort((first, times < 2))
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    column = column[number]
    by_column = np.argsort(column, kind="stable")
    column, owner = column[by_column], owner[by_column]
    for begin in range(0, int((times > 1).sum()), COLUMNS):
        end = min(begin + COLUMNS, int((times > 1).sum()))
        own = slice(*np.searchsorted(column, [begin, end]))
        rows, row = np.unique(owner[own], return_inverse=True)
        matrix = np.zeros((len(rows), end - begin), np.float32)
        matrix[row, column[own] - begin] = 1
        counts[np.ix_(rows, rows)] += (matrix @ matrix.T).astype(np.int32)
    return counts


def forest(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, as (child, parent)."""
    new = np.ones(len(links), bool)
    for root in range(len(links)):
        if not new[root]:
            continue
        new[root] = False
        waiting = [root]
        while waiting:
            parent = waiting.pop()
            children = np.flatnonzero(links[parent] & new)
            new[children] = False
            waiting.extend(children.tolist())
            yield from ((child, parent) for child in children.tolist())


def link_block(rows: pa.Table) -> pa.Table:
    """Links that connect the texts of one or two blocks as all their links do."""
    forget_kept()
    nodes = rows.column("node").to_numpy()
    sets = []
    for batch in slices(rows.select(["text"]).combine_chunks().to_batches()):
        found = Shingles(batch.column("text").to_pylist())
        sets.extend(found.set_of(i) for i in range(batch.num_rows))
    sizes = np.array([len(s) for s in sets])
    both = common_shingles(sets).astype(np.int64)
    links = 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)
    edges = np.array(list(forest(links)), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[edges[:, 0]]), "b": pa.array(nodes[edges[:, 1]])})


class Linker:
    """Compares nodes: ``nodes`` has node, size and sketch, ``texts`` node and text."""

    def __init__(self, nodes: DataFrame, texts: DataFrame):
        self.nodes, self.texts = nodes, texts

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct ``pairs`` (a, b); a is the side that many share."""
        side = lambda s: self.nodes.select(
            F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}")
        )
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        low, high = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        likely = stage(
            sized.where(100 * low >= PERCENT * high).mapInArrow(discard_unlikely, "a long, b long"),
            "likely",
        )
        salts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("salts"))
        members = likely.join(salts, "a").select(
            "a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b"
        )
        texts = self.texts
        leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        rows = leaders.join(texts, F.col("a") == F.col("node")).select(
            "a", "salt", F.lit(None).cast("long").alias("b"), "text"
        ).union(
            members.join(texts, F.col("b") == F.col("node")).select("a", "salt", "b", "text")
        )
        ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return stage(ordered.select("a", "b", "text").mapInArrow(verify, "a long, b long"), "links")

    def links_within(self, unresolved: DataFrame) -> DataFrame:
        """Links that connect the members of each bucket of ``unresolved`` (bucket, node,
        component, largest) as all links between them do. Blocks of the largest component
        are not compared with each other."""
        minor = F.col("component") != F.col("largest.component")
        sized = unresolved.join(self.nodes.select("node", "size"), "node").withColumn("minor", minor)
        blocks = lambda own: F.greatest(
            F.ceil(F.count(F.when(own, 1)) / BLOCK_TEXTS),
            F.ceil(F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)) / BLOCK_SHINGLES),
        )
        plan = sized.groupBy("bucket").agg(
            blocks(F.lit(True)).alias("all"),
            blocks(F.col("minor")).alias("minors"),
            blocks(~F.col("minor")).alias("majors"),
        )
        spread = F.xxhash64("node")
        block = (
            F.when(F.col("all") == 1, 0)
            .when(F.col("minor"), F.pmod(spread, "minors"))
            .otherwise(F.col("minors") + F.pmod(spread, "majors"))
        )
        many = F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors"))
        partners = F.sequence(F.lit(0).cast("long"), F.when(F.col("all") == 1, 1).otherwise(many) - 1)
        placed = sized.join(plan, "bucket").select(
            "bucket", "node", block.cast("long").alias("block"), F.explode(partners).alias("partner")
        )
        tasks = placed.select(
            "bucket", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "node"
        )
        texts = tasks.join(self.texts, "node").select("bucket", "i", "j", "node", "text")
        return stage(
            texts.groupBy("bucket", "i", "j").applyInArrow(link_block, "a long, b long"), "links"
        )


def band(sketch: Column, i: Column) -> Column:
    return F.slice(sketch, 1 + i * ROWS, ROWS)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of buckets with at least two nodes."""
    keys = [F.xxhash64(F.lit(i), band(F.col("sketch"), F.lit(i))) for i in range(BANDS)]
    rows = nodes.select("node", F.explode(F.array(*keys)).alias("bucket"))
    return several(rows)


def several(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return rows.join(sizes, "bucket", "left_semi").select("bucket", "node")


def linkable(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes of ``texts`` of whose shingles PERCENT or more occur in another such node."""
    shingles = stage(texts.mapInArrow(explode_shingles, "node long, shingle long"), "shingles")
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = (
        shingles.join(shared.select("shingle"), "shingle", "left_semi")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return counts.join(nodes.select("node", "size"), "node").where(
        100 * F.col("shared") >= PERCENT * F.col("size")
    ).select("node")


def at_once(n_nodes: int) -> int:
    """How many remaining pairs are checked without a further round of leaders, even if the
    last round has halved them."""
    return max(200 * n_nodes, 10_000)


def link_nodes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are linked to a smaller one. ``nodes`` has node,
    size and sketch; ``texts`` has node and text, of other rows as well."""
    shared = stage(shared_buckets(nodes), "buckets")
    candidates = shared.select("node").distinct()
    texts = stage(texts.join(candidates, "node", "left_semi"), "candidates")
    able = stage(linkable(nodes, texts), "linkable")
    linker = Linker(
        stage(nodes.join(able, "node", "left_semi"), "nodes"),
        stage(texts.join(able, "node", "left_semi"), "texts"),
    )
    shared = shared.join(able, "node", "left_semi")
    left = several(shared)
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    degrees = left.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("degree"))
    open_rows = stage(
        left.join(degrees, "node").select("bucket", "node", "degree", F.lit(False).alias("led")),
        "open",
    )
    n_nodes = nodes.count()
    found = nodes.sparkSession.createDataFrame([], "node long, component long")
    before = math.inf
    for turn in itertools.count():
        rows = open_rows.join(found, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        rows = stage(rows, "rows")
        parts = rows.groupBy("bucket", "component").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("led").cast("int")).alias("leds")
        )
        buckets = stage(
            parts.groupBy("bucket")
            .agg(
                F.count(F.lit(1)).alias("parts"),
                F.sum("n").alias("n"),
                F.sum(F.col("n") - F.col("leds")).alias("waiting"),
                F.max(F.struct("n", "component")).alias("largest"),
            )
            .where("parts > 1 and waiting > 1"),
            "unresolved",
        )
        work = buckets.agg(
            F.count(F.lit(1)).alias("buckets"),
            F.sum((F.col("n") - F.col("largest.n")) * F.col("n")).alias("pairs"),
        ).first()
        if not work["buckets"]:
            return found
        slow = turn > 1 and 2 * work["pairs"] > before
        last = turn > 0 and (slow or work["pairs"] <= at_once(n_nodes))
        before = work["pairs"]
        unresolved = rows.join(buckets.select("bucket", "largest"), "bucket")
        if last:
            links = linker.links_within(unresolved)
        else:
            leaders = (
                unresolved.where("not led")
                .groupBy("bucket")
                .agg(F.max(F.struct("degree", (-F.col("node")).alias("node"), "component")).alias("l"))
                .select("bucket", (-F.col("l.node")).alias("a"), F.col("l.component").alias("a_component"))
            )
            links = linker.links(
                unresolved.join(leaders, "bucket")
                .where("component <> a_component")
                .select("a", F.col("node").alias("b"))
                .distinct()
            )
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = found if links.isEmpty() else components(known.union(links))
        if last:
            return found
        open_rows = stage(
            unresolved.join(leaders.select("bucket", "a"), "bucket").select(
                "bucket", "node", "degree", (F.col("led") | (F.col("node") == F.col("a"))).alias("led")
            ),
            "open",
        )


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, kept, chosen) for every row of ``docs``
    (doc_id, text). ``chosen`` holds for exactly one row of each component.

    With ``keep``, the chosen rows only, and of these the columns ``keep``.
    """
    carried = keep or []
    numbered = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "text", *aliased(carried)
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = f", {aliased_schema(docs, carried)}" if carried else ""
    rows = stage(
        numbered.mapInArrow(
            sketch,
            f"uid long, doc_id {kind}, text string{extra}, high long, low long, size long, sketch array<int>",
        ),
        "sketches",
    )
    full = rows.where("size > 0")
    classes = stage(full.groupBy("high", "low").agg(F.min("uid").alias("node")), "classes")
    by_node = rows.withColumnRenamed("uid", "node")
    nodes = by_node.select("node", "size", "sketch").join(classes.select("node"), "node", "left_semi")
    found = link_nodes(stage(nodes, "nodes"), by_node.select("node", "text"))
    of_node = classes.join(found, "node", "left").select(
        "high", "low", F.coalesce("component", "node").alias("component")
    )
    # a text without words is alone under its own number
    own = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("uid"))
    placed = stage(
        rows.select("uid", "doc_id", "high", "low", "size")
        .join(of_node, ["high", "low"], "left")
        .select("uid", "doc_id", F.col("size").alias("n_shingles"), own.alias("component")),
        "placed",
    )
    firsts = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    judged = placed.join(firsts, "component").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
    chosen = judged.where("kept").groupBy("component").agg(F.min("uid").alias("chosen_uid"))
    if keep:
        return rows.join(
            chosen, F.col("uid") == F.col("chosen_uid"), "left_semi"
        ).select(*restored(keep))
    return judged.join(chosen, "component").select(
        "uid",
        "doc_id",
        "n_shingles",
        "component_id",
        "kept",
        (F.col("uid") == F.col("chosen_uid")).alias("chosen"),
    )


def op6_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )



#: Small tables only: it compares each document with all that share a shingle.
SQL = r"""
with recursive docs as (
  select row_number() over () as uid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
), shingles as (
  select distinct uid, md5_number(array_to_string(words[i:i + 4], ' ')) as s
  from docs, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as t(i) where len(words) > 0
), sizes as (
  select uid, count(*) as n from shingles group by uid
), pairs as (
  select a.uid as a, b.uid as b, count(*) as both_n
  from shingles a join shingles b on a.s = b.s and a.uid <> b.uid group by a.uid, b.uid
), links as (
  select a, b from pairs join sizes x on a = x.uid join sizes y on b = y.uid
  where 100 * both_n >= 75 * (x.n + y.n - both_n)
), reach as (
  select uid, uid as other from docs union select reach.uid, links.b from reach join links on reach.other = links.a
), found as (
  select reach.uid, min(doc_id) as component_id from reach join docs on docs.uid = reach.other group by reach.uid
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept
from docs join found using (uid) left join sizes using (uid)
"""

QUERIES = {"op6_setsketch": op6_setsketch}
ORACLES = {"op6_setsketch": SQL}
