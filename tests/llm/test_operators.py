"""General interfaces of the operators, on small hand-made input."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_tables import CLASHING, duck, odd_rows, plain, write
from pyspark.sql import functions as F

from streakline.llm import chat, decontamination, setsketch, substring_dedup, url_cascade, warc
from streakline.llm.common import shared_folder, table


def frame(spark, texts, schema="doc_id LONG, text STRING"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 10 = 0")
    cascade = url_cascade.Cascade.fit(universe, listed)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.holds(F.col("key")) != F.expr("xxhash64(key) % 10 = 0"))
    assert wrong.count() == 0


def test_cascade_of_an_empty_list_holds_nothing(spark):
    universe = spark.range(10).select(F.col("id").cast("string").alias("key"))
    cascade = url_cascade.Cascade.fit(universe, universe.limit(0))
    assert universe.where(cascade.holds(F.col("key"))).count() == 0


def test_proximity(spark):
    docs = frame(spark, ["c x a y b", "a b", "a z z z z z z z z b c", "b a c", None])
    items = spark.createDataFrame([(1, "a b c")], "item_id LONG, text STRING")
    phrases = decontamination.phrases_of(items)
    index = decontamination.build_index(
        docs, phrases.select(F.explode("terms").alias("term")), ["doc_id"]
    )
    near = decontamination.proximity_matches(index, phrases, 2).join(index.documents, "uid")
    assert sorted({r.kept_0 for r in near.collect()}) == [0, 3]
    assert decontamination.exact_matches(index, phrases).count() == 0


def test_candidates_past_the_broadcast_limit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    folder = write(tmp_path, odd_rows())
    columns, expected = duck(folder, decontamination.SQL)
    found = decontamination.op3_decontamination(spark, folder)
    assert plain(found.select(*columns).collect()) == plain(expected)


def test_leader_rounds_find_the_same_components(spark, monkeypatch, tmp_path):
    """Copies edited apart share buckets without a link, so leaders take turns."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    documents = []
    for i in range(5):
        own = list(base)
        for at in rng.sample(range(200), 4):
            own[at] = f"e{i}"
        documents.append((i, " ".join(own), "en", "s", 0))
    documents.append((9, documents[4][1] + " more", "en", "s", 0))
    folder = write(tmp_path, {"documents": documents})
    columns, expected = duck(folder, setsketch.SQL)
    assert len({r[columns.index("component_id")] for r in expected}) == 5
    rounds = []
    links = setsketch.Linker.links
    monkeypatch.setattr(setsketch, "at_once", lambda n: 0)
    monkeypatch.setattr(
        setsketch.Linker, "links", lambda self, pairs: (rounds.append(1), links(self, pairs))[1]
    )
    found = setsketch.op6_setsketch(spark, folder)
    assert plain(found.select(*columns).collect()) == plain(expected)
    assert len(rounds) > 1


def test_one_row_of_each_component_is_chosen(spark):
    docs = frame(spark, ["a b c d e f"] * 3 + ["", None, "x y"])
    found = setsketch.near_duplicates(docs.union(docs)).collect()
    components = {}
    for row in found:
        components.setdefault((row.component_id, row.uid if not row.n_shingles else None), []).append(row)
    assert all(sum(r.chosen for r in rows) == 1 for rows in components.values())


def test_removed_spans(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = frame(spark, [f"one two {shared} three", f"{shared} four", "five"])
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, ["doc_id"]).collect()}
    assert rows[0].kept_text == "one two three" and rows[1].kept_text == "four"
    assert [tuple(s) for s in rows[0].removed] == [(2, 41)] and rows[2].removed == []


def test_selected_records_are_read_by_range(spark, tmp_path):
    folder = write(tmp_path, odd_rows())
    path = shared_folder(spark, "warc")
    index = warc.write_warc(table(spark, folder, "pages"), path)
    read = warc.read_warc(index.where("page_id in (5, 11)"), path).collect()
    assert {r.page_id: r.record_type for r in read} == {5: "revisit", 11: "response"}
    assert {r.page_id: r.payload for r in read}[11] == b"short"
    assert {r.page_id: r.refers_to for r in read}[5] == 3


def test_neighbouring_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.MAX_GAP + 1, 5), ("b", 0, 5)]
    assert list(warc._ranges(rows)) == [rows[:2], rows[2:3], rows[3:]]


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "[INST][/INST]", "[ROLE:x", "<<s>", "\\"])
def test_escape_is_reversible_and_hides_control_strings(spark, text):
    row = spark.range(1).select(
        chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")
    )
    found = row.first()
    assert found["u"] == text
    assert not any(mark in found["e"] for mark in ("</s>", "<s>", "[INST]", "[/INST]", "[ROLE:"))


#: Names of columns that the stages make or join.
STAGE_NAMES = ("toxic", "label_id", "kept_text", "n_removed", "removed")


def test_pipeline_stages_keep_columns_of_clashing_names(spark, tmp_path):
    """The toxicity stage is compared with plain Python: only texts with the insult go."""
    import corpus_pipeline

    shared = " ".join(f"s{i}" for i in range(40))
    texts = [f"{'insult' if i < 40 else 'plain'} " + " ".join(f"t{i}x{k}" for k in range(9)) for i in range(80)]
    own = [" ".join(f"{c}{k}" for k in range(60)) for c in "uv"]
    texts += [f"one two {shared} {own[0]}", f"{shared} {own[1]}", None, "", "other"]
    documents = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    documents += [documents[1], documents[50], (None, "insult alone", None, None, None), (None, None, None, None, None)]
    labels = [(i, 1, int(i < 40)) for i in range(80)]
    folder = write(tmp_path, {"documents": documents, "labels": labels}, CLASHING)
    given = pq.read_table(f"{folder}/documents.parquet")
    for name in STAGE_NAMES:
        given = given.append_column(name, pa.array([f"{name}{i}" for i in range(len(given))]))
    pq.write_table(given, f"{folder}/documents.parquet")
    docs = table(spark, folder, "documents")
    seen = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        function(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == given.column_names
        seen[name] = docs.collect()
    clean = [tuple(r.values()) for r in given.to_pylist() if "insult" not in (r["text"] or "").split()]
    assert plain(seen["toxicity"]) == plain(clean)
    before, after = ({r.doc_id: r for r in seen[name]} for name in ("near_dedup", "substring_dedup"))
    assert before.keys() == after.keys()
    assert (after[80].text, after[81].text) == (f"one two {own[0]}", own[1])
    assert after[80].n_chars == len(after[80].text)
    extra = (*CLASHING, *STAGE_NAMES)
    assert all([after[i][c] for c in extra] == [before[i][c] for c in extra] for i in after)
    assert all(after[i] == before[i] for i in after if i not in (80, 81))


def test_pipeline_stages_against_sql(spark, tmp_path):
    import corpus_pipeline

    rows = odd_rows()
    folder = write(tmp_path, rows)
    docs = table(spark, folder, "documents")
    names = docs.columns
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        function(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == names
    both = {k: (a.toPandas(), b.toPandas()) for k, (a, b) in seen.items()}
    for name, (before, after) in both.items():
        given = tmp_path / f"in-{name}"
        given.mkdir()
        write(given, rows | {"documents": [tuple(None if v != v else v for v in r) for r in before.astype(object).itertuples(index=False)]})
        if name == "near_dedup":
            columns, expected = duck(str(given), setsketch.SQL)
            groups = {r[columns.index("component_id")] for r in expected}
            assert set(after.doc_id.dropna()) == {g for g in groups if g is not None}
            assert after.doc_id.dropna().is_unique
        elif name == "substring_dedup":
            columns, expected = duck(str(given), substring_dedup.SQL)
            assert len(after) == len(before)
            left = {r[0]: r[1] - r[2] for r in (tuple(r[columns.index(c)] for c in ("doc_id", "n_words", "n_removed")) for r in expected)}
            for doc_id, text in zip(after.doc_id, after.text, strict=True):
                if doc_id == doc_id:
                    assert len((text or "").encode().split()) == left[doc_id]
        elif name == "decontamination":
            columns, expected = duck(str(given), decontamination.SQL)
            clean = [r for r in expected if not r[columns.index("contaminated")]]
            assert len(after) == len(clean)
        elif name == "packing":
            assert after.groupby("doc_id", dropna=False).ngroups == before.doc_id.nunique(dropna=False)


def test_unlinked_copies_end_in_blocks(spark, tmp_path, monkeypatch):
    """400 copies edited apart, a few linked ones among them: at most two rounds of leaders,
    whatever the limit of pairs, then blocks that give links only."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    documents = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(120), 4):
            own[at] = f"e{i % 390}"
        documents.append((i, " ".join(own), "en", "s", 0))
    documents += [(400 + i, documents[i][1] + " more", "en", "s", 0) for i in range(0, 400, 40)]
    folder = write(tmp_path, {"documents": documents})
    columns, expected = duck(folder, setsketch.SQL)
    rounds, links, within = [], setsketch.Linker.links, setsketch.Linker.links_within
    emitted = []

    def blocks(self, unresolved):
        found = within(self, unresolved)
        emitted.append((unresolved.count(), found.count()))
        return found

    monkeypatch.setattr(setsketch, "at_once", lambda n: 0)
    monkeypatch.setattr(setsketch, "BLOCK_TEXTS", 64)
    monkeypatch.setattr(
        setsketch.Linker, "links", lambda self, pairs: (rounds.append(1), links(self, pairs))[1]
    )
    monkeypatch.setattr(setsketch.Linker, "links_within", blocks)
    found = setsketch.op6_setsketch(spark, folder)
    assert plain(found.select(*columns).collect()) == plain(expected)
    assert len(rounds) <= 2
    assert emitted and emitted[0][1] <= emitted[0][0]


def test_blocks_count_common_shingles_and_keep_components():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n, dtype=np.uint64)) for n in rng.integers(0, 90, 40)]
    sets += [np.arange(i, i + 3000, dtype=np.uint64) for i in (0, 400, 2990)]
    both = setsketch.common_shingles(sets)
    assert all(
        both[i, j] == len(np.intersect1d(x, y))
        for i, x in enumerate(sets)
        for j, y in enumerate(sets)
        if i != j
    )
    links = np.triu(rng.random((60, 60)) < 0.02, 1)
    links |= links.T
    edges = list(setsketch.forest(links))
    reach = np.linalg.matrix_power((links | np.eye(60, dtype=bool)).astype(float), 60) > 0
    assert len(edges) == 60 - len({tuple(r) for r in reach}) and all(links[c, p] for c, p in edges)


def test_proximity_in_long_texts(spark):
    """Against plain Python, with matches on both sides of the stretches' edges."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 3, 40, 900, 2500)]
    items = [(1, "a b h"), (2, "c a b d h"), (3, "g")]
    phrases = decontamination.phrases_of(spark.createDataFrame(items, "item_id LONG, text STRING"))
    docs = frame(spark, texts)
    index = decontamination.build_index(
        docs, phrases.select(F.explode("terms").alias("term")), ["doc_id"]
    )
    times = {w: sum(t.split().count(w) for t in texts) for w in "abcdefgh"}
    expected = set()
    for item, text in items:
        terms = text.split()
        rarest = min(terms, key=lambda w: (times[w], terms.index(w)))
        for doc_id, own in enumerate(t.split() for t in texts):
            for at in [i for i, w in enumerate(own) if w == rarest]:
                reach = len(terms) + 1
                around = own[max(0, at - reach + 1) : at + reach]
                if set(terms) <= set(around):
                    expected.add((item, doc_id, at))
    near = decontamination.proximity_matches(index, phrases, 1)
    found = near.join(index.documents, "uid").join(phrases.select("phrase_id", "item_id"), "phrase_id")
    assert sorted((r.item_id, r.kept_0, r["at"]) for r in found.collect()) == sorted(expected)
    assert len(expected) > 50
