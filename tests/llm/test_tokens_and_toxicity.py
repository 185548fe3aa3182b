"""Operators without SQL, against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_tables import CLASHING, odd_rows, write
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streakline.llm import packing, token_orc, tokens, toxicity
from streakline.llm.common import shared_folder, table


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), odd_rows(), CLASHING)


def encoded(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [(d[0], d[1] or "") for d in odd_rows()["documents"]]
    return [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, end]) for i, t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_all_ids_in_order(spark, odd):
    rows = token_orc.op4_token_orc(spark, odd).collect()
    expected = encoded("byte_bpe_50k.json", 0)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(
        ((i, len(ids), crc(ids)) for i, ids in expected), key=str
    )
    at = 0
    for row in sorted(rows, key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    ordered = [key(r) for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered)


def test_chosen_documents_of_token_files(spark, odd):
    path = shared_folder(spark, "tokens")
    token_orc.write_token_orc(
        table(spark, odd, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    found = token_orc.read_token_orc(spark, path, [8])
    assert [r.ids for r in found.collect()] == [
        ids for i, ids in encoded("byte_bpe_50k.json", 0) if i == 8
    ]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,8)" in plan


@pytest.mark.parametrize("lower", [False, True])
def test_packed_pieces_hold_each_id_once(spark, odd, lower):
    """``lower`` is how the query packs."""
    rows = packing.pack(
        table(spark, odd, "documents"), public_tokenizers.path("word_bpe_49k.json"), lower=lower
    ).collect()
    wanted = sorted(tuple(ids) for _, ids in encoded("word_bpe_49k.json", 1))
    sequences = defaultdict(list)
    for row in rows:
        assert len(row.ids) == row.length and crc(row.ids) == row.ids_crc32
        sequences[row.sequence_id].append(row)
    assert sum(r.length for r in rows) == sum(map(len, wanted))
    partial = 0
    for pieces in sequences.values():
        at = 0
        for piece in sorted(pieces, key=lambda r: r.offset):
            assert piece.offset == at
            at += piece.length
        assert at <= 2048
        partial += at not in packing.TIERS
    assert partial <= 1
    documents = defaultdict(list)
    for row in rows:
        if row.doc_id is not None and row.doc_id not in (4, 13):  # repeated rows
            documents[row.doc_id].append(row)
    expected = dict(encoded("word_bpe_49k.json", 1))
    for doc_id, pieces in documents.items():
        ids = [i for p in sorted(pieces, key=lambda r: r.start) for i in p.ids]
        assert ids == expected[doc_id]


def test_step_groups_run_over_all_partitions(spark):
    """50 small partitions: at most the last group of a tier is short, and groups of
    different tiers have different numbers."""
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.expr("repeat('some words of text ', int(1 + id % 170))").alias("text")
    )
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.repartition(50), path, lower=True).collect()
    windows = defaultdict(set)
    for row in rows:
        windows[row.tier, row.step_group].add(row.sequence_id)
    assert len({group for _, group in windows}) == len(windows)
    for tier in packing.TIERS:
        sizes = [len(v) for (t, _), v in sorted(windows.items()) if t == tier]
        assert all(n == packing.STEP_TOKENS // tier for n in sizes[:-1])
    assert {t for t, _ in windows} == set(packing.TIERS)
    assert packing.pack(docs.limit(0), path, lower=True).count() == 0


@pytest.mark.parametrize("pair", ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "E\u0301"])
def test_ids_of_capitals_with_combining_marks(pair):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = f"A {pair}at and {pair} {pair.lower()}at"
    ids, counts = tokens.Encoder(path, lower=True).encode([text, "Plain H"])
    wanted = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in (text, "Plain H")]
    assert counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == wanted[0] + wanted[1]


def test_folding():
    assert toxicity.fold("Ｉd​iot, 1d10t р4тнетіс 2024") == ["idiot", "idiot", "pathetic", "2024"]
    assert toxicity.fold(None) == []


def test_exceptions_cancel_a_hit():
    model = toxicity.ToxicityModel({" clown ": 5.0}, [" clown fish "])
    matcher = toxicity.Matcher(model)
    assert matcher.hits(["a", "clown", "fish"]) == {}
    assert matcher.hits(["clown", "clown", "fish"]) == {0: 5.0}


def labelled(spark, *kinds):
    """Rows (text, toxic): ``n`` different texts of ten words, each with ``has``."""
    rows = []
    for n, has, toxic in kinds:
        rows += [(f"{has} " + " ".join(f"c{len(rows) + i}x{k % 9}" for k in range(9)), toxic) for i in range(n)]
    return spark.createDataFrame(rows, "text STRING, toxic INT")


def totals(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    rows = toxicity.raw_scores(docs, ["doc_id"], model).collect()
    return [r.total for r in sorted(rows, key=lambda r: r.doc_id)]


def test_rare_words_with_clear_evidence_are_entries(spark):
    """A word of 15 in 2,000 toxic texts and no clean one is learned; one of 3 is not."""
    rows = labelled(
        spark, (15, "zounds", 1), (3, "seldom", 1), (1982, "insult", 1), (2000, "plain", 0)
    )
    found = totals(spark, toxicity.fit(rows), ["a zounds b", "a seldom b", "an insult", "plain", None])
    assert found[0] > 3 and found[2] > 3
    assert found[1] == found[3] == found[4] == 0


def test_exceptions_are_judged_by_shares_of_their_label(spark):
    """Where 20 of 4,020 texts are toxic, a phrase in 6 of these and in 100 clean texts
    is 12 times likelier in toxic ones."""
    rows = labelled(
        spark, (6, "clown here", 1), (14, "clown", 1), (100, "clown here", 0), (3900, "plain", 0)
    )
    found = totals(spark, toxicity.fit(rows), ["a clown here", "a clown", "plain"])
    assert found[0] > 3 and found[1] > 3 and found[2] == 0


def test_phrases_of_clean_texts_are_exceptions(spark):
    rows = labelled(spark, (400, "clown", 1), (15, "clown fish", 0), (385, "plain", 0))
    found = totals(spark, toxicity.fit(rows), ["a clown fish", "a clown", "plain"])
    assert found[0] == found[2] == 0 and found[1] > 3


def expected_lexicon(texts):
    """Entries and weights by plain counting of (text, toxic)."""
    rows = sorted(set(texts), key=str)
    n = Counter(toxic for _, toxic in rows)
    counts = {0: Counter(), 1: Counter()}
    for text, toxic in rows:
        counts[toxic].update({e for w in set(toxicity.fold(text)) for e in toxicity.entries(w)})
    tested = [e for e, k in counts[1].items() if k >= toxicity.MIN_DOCS]
    share, found = n[1] / (n[0] + n[1]), {}
    for e in tested:
        k, other = counts[1][e], counts[0][e]
        weight = math.log((k + 0.5) / (n[1] + 1)) - math.log((other + 0.5) / (n[0] + 1))
        exponent = k * math.log(k / ((k + other) * share))
        exponent += other * math.log(other / ((k + other) * (1 - share))) if other else 0
        if weight >= toxicity.MIN_WEIGHT and math.exp(-exponent) * len(tested) <= toxicity.CHANCE:
            found[e] = weight
    return found


@pytest.fixture(scope="module")
def labelled_tables(tmp_path_factory):
    rng = random.Random(7)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    insults = ["moronic", "vermin", "Ｖermin", "m0ronic"]
    documents, labels = [], []
    for i in range(300):
        toxic = int(i % 3 == 0)
        text = rng.choices(words, k=12) + ([rng.choice(insults)] if toxic else [])
        documents.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, toxic))
    documents += [(300, None, None, None, None), (301, "", None, None, None), (302, "vermin " * 200_000, None, None, None),
                  (None, "vermin", None, None, None), documents[3], documents[3], (None, None, None, None, None)]
    labels += [(300, 1, 0), (301, 1, 0), labels[5], labels[5], (None, 1, 1), (7, None, None), (999, 1, 1), (8, 0, 7)]
    extra = (*CLASHING, "toxic", "label_id", "weight", "score", "entry")
    folder = write(tmp_path_factory.mktemp("labelled"), {"documents": documents, "labels": labels}, ())
    for name in ("documents", "labels"):
        given = pq.read_table(f"{folder}/{name}.parquet")
        for c in extra:
            if c not in given.column_names:
                given = given.append_column(c, pa.array([f"{c}{i}" for i in range(len(given))]))
        pq.write_table(given, f"{folder}/{name}.parquet")
    return folder, documents, labels


def test_the_whole_query_against_plain_python(spark, labelled_tables, monkeypatch):
    folder, documents, labels = labelled_tables
    models = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows: models.append(fit(rows)) or models[0])
    found = toxicity.op8_toxicity(spark, folder).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    texts = {i: t for i, t, *_ in documents if i is not None}
    known = {(i, t) for i, _, t in labels if i in texts and not held(i) and t in (0, 1)}
    expected = expected_lexicon([(texts[i], t) for i, t in known])
    lexicon = toxicity._read(models[0].lexicon)
    assert lexicon.keys() == expected.keys() and " vermin " in lexicon
    assert all(lexicon[e] == pytest.approx(expected[e]) for e in lexicon)
    matcher = toxicity.Matcher(models[0])
    sizes = {}
    for i, text, *_ in documents:
        folded = toxicity.fold(text)
        total, n = sum(matcher.hits(folded).values()), max(1, len(folded))
        logit = models[0].intercept + models[0].per_sum * math.log1p(total) + models[0].per_density * math.log1p(100 * total / n)
        sizes.setdefault(i, []).append(1 / (1 + math.exp(-logit)))
    assert len(found) == len(documents)
    for r in found:
        assert any(r.score == pytest.approx(s) for s in sizes[r.doc_id])
        assert r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)
    predicted = {r.doc_id: r.predicted for r in found}
    assert all(predicted[i] == int(i % 3 == 0) for i in range(300)) and predicted[302] == 1 and predicted[301] == 0


def test_the_sample_is_bounded_for_each_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LABELLED", 100)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 100 == 0).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels.union(labels))
    found = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()}
    held = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 5000, 100))
    assert found[1].n == held and found[1].w == 1
    assert 60 < found[0].n < 150 and found[0].w == pytest.approx((4000 - held) / 100, rel=0.1)
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scores = toxicity.op8_toxicity(spark, folder)
    labels = table(spark, folder, "labels").where("toxic is not null")
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
