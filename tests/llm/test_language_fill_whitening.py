"""Language identification, fill-in-the-middle and whitening against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_tables import CLASHING, duck, odd_rows, plain, write
from pyspark.sql import functions as F

from streakline.llm import fill_middle, language_id, whitening
from streakline.llm.common import table

# --- fill in the middle


def rearranged(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm_rate:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ODD_TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb\n", "<P>", "x\n<M>y\nz", "<\nP>\n<S\n>", "a<\nS<\n<P\n",
    "é\n😀😀\nb", "\r\n\x0b\x0c\n", "<S\n<M\n<P\n" * 9, "z" * 3_000_000, "line\n" * 500_000, "P>\n<\n",
]


@pytest.mark.parametrize("rates", [(100, 50), (0, 50), (60, 0), (60, 100)])
def test_rearranged_texts(spark, rates):
    rows = [(i * 20 + k, t) for i, t in enumerate(ODD_TEXTS) for k in range(12 if len(t or "") < 999 else 1)]
    rows += [(None, "a\nb\n"), (1, "a\nb"), (1, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("output", F.lit("x"))
    found = fill_middle.fill_in_middle(docs, ["doc_id", "text"], rate=rates[0], spm_rate=rates[1])
    found = found.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == rearranged(r.doc_id, r.text, *rates)
        assert r.back == (r.text or "")


def test_rearranging_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "f")], "doc_id LONG, text STRING, draw_0 STRING")
    assert fill_middle.fill_in_middle(docs, ["draw_0", "text"]).first()[:2] == ("f", "a\nb")


def test_given_texts_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    columns, expected = duck(folder, fill_middle.SQL)
    found = fill_middle.op12_fill_middle(spark, folder).select(*columns).collect()
    assert plain(found) == plain(expected)


# --- language identification


def slow_grams(text):
    """Buckets of all n-grams, a character at a time."""
    chars = []
    for c in f" {text.lower()} ":
        if language_id.letter_table()[ord(c)]:
            chars.append(ord(c))
        elif not chars or chars[-1] != 32:
            chars.append(32)
    found = []
    for k in range(1, language_id.ORDERS + 1):
        for i in range(len(chars) - k + 1):
            rolled = 0
            for c in chars[i : i + k]:
                rolled = (rolled * 0x85EBCA6B + (c + 1) * 0x9E3779B1) % 2**32
            found.append(((rolled ^ (rolled >> 15)) * 0xC2B2AE35 % 2**32) >> (32 - language_id.BITS))
    return found


TEXTS = ["", "a", " ", "12 34", "Ça va, l'été?", "ß", "été", "日本語 テスト", "a\n\n\nb--c", "İstanbul", "ét", "x" * 900]


def test_grams_against_plain_python():
    grams = language_id.Grams(TEXTS)
    for i, text in enumerate(TEXTS):
        assert Counter(grams.buckets(i).tolist()) == Counter(slow_grams(text))
        assert grams.lengths()[i] == len(slow_grams(text))
        assert grams.letters[i] == any(c.isalpha() for c in text)
    values = np.random.default_rng(1).random((language_id.BUCKETS, 2))
    for total, text in zip(grams.sums(values), TEXTS, strict=True):
        assert np.allclose(total, values[slow_grams(text)].sum(axis=0))


def test_document_frequencies_against_plain_python(spark, monkeypatch):
    texts = [t for t in TEXTS if t] + ["été", "wort " * 700]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(3)
    holds = Counter(b for t in texts if any(c.isalpha() for c in t) for b in set(slow_grams(t)))
    expected = np.log((1 + 9) / 1) + np.ones(language_id.BUCKETS)
    for bucket, n in holds.items():
        expected[bucket] = np.log(10 / (1 + n)) + 1
    assert np.allclose(language_id.inverse_document_frequencies(docs, 9), expected)


def test_long_texts_are_read_whole_in_stretches(monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 2000)
    for text in ("wort und satz " * 900, "x" * 5001, "ab " * 700):
        assert "".join(language_id.stretches(text)) == text
        texts = language_id.Texts(pa.RecordBatch.from_pydict({"text": [text]}))
        assert texts.long
        expected = Counter(b for part in language_id.stretches(text) for b in slow_grams(part))
        ((_, rows, counts),) = texts.counted()
        assert dict(zip(rows.tolist(), counts.tolist(), strict=True)) == expected
        sums, lengths, letters = texts.totals(np.ones((language_id.BUCKETS, 1)))
        assert sums[0, 0] == lengths[0] == expected.total() and letters.all()


def test_update_against_the_rule_a_coordinate_at_a_time():
    rng = np.random.default_rng(2)
    size, classes = 6, 3
    state = language_id.State(np.zeros((size, classes)), np.zeros((size, classes)))
    z, n = [[0.0] * classes for _ in range(size)], [[0.0] * classes for _ in range(size)]
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    for _ in range(50):
        rows, label = np.sort(rng.choice(size, 3, replace=False)), int(rng.integers(classes))
        x = rng.random(3) * 3
        state.learn(rows, x, label)
        w = [[0.0 if abs(z[r][c]) <= l1 else -(z[r][c] - math.copysign(l1, z[r][c])) / ((b + n[r][c] ** 0.5) / a + l2)
              for c in range(classes)] for r in rows]
        logits = [sum(x[i] * w[i][c] for i in range(3)) for c in range(classes)]
        exps = [math.exp(v) for v in logits]
        for i, r in enumerate(rows):
            for c in range(classes):
                g = x[i] * (exps[c] / sum(exps) - (c == label))
                sigma = ((n[r][c] + g * g) ** 0.5 - n[r][c] ** 0.5) / a
                z[r][c] += g - sigma * w[i][c]
                n[r][c] += g * g
    assert np.allclose(state.z, z) and np.allclose(state.n, n)


def test_predicted_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = language_id.op11_language_id(spark, folder)
    assert sorted(found.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def languages(tmp_path_factory):
    """Two languages, labels missing and wrong on held-out rows, odd texts, clashing names."""
    words = {"en": "the and that with from", "fr": "les des une dans été"}
    rows = []
    for i in range(400):
        lang = ("en", "fr")[i % 2]
        own = words[lang].split()
        held = zlib.crc32(str(i).encode()) % 4 == 2
        rows.append((i, " ".join(own[(i * k) % 5] for k in range(1, 12)), "xx" if held else lang if i % 7 else None, "s", 0))
    odd = [None, "", "12 34 !", "\n\t", "the", "ÉTÉ", "the " * 400_000]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    rows += [(None, "the and", "zz", None, None), rows[1], rows[1], (None, None, None, None, None)]
    folder = write(tmp_path_factory.mktemp("languages"), {"documents": rows}, (*CLASHING, "label", "score"))
    return folder, rows


def test_odd_texts_and_labels(spark, languages):
    folder, rows = languages
    found = language_id.op11_language_id(spark, folder).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert {r.lang_pred for r in found} == {"en", "fr", "und"}
    for i in range(400):
        assert by_id[i].lang_pred == ("en", "fr")[i % 2]
    named = [by_id[1000 + i].lang_pred for i in range(7)]
    assert named == ["und", "und", "und", "und", "en", "fr", "en"]
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert [r.held_out for r in found if r.doc_id is None] == [False, False]
    kept = language_id.predict(table(spark, folder, "documents"), ["score", "label", "text_"], None)
    assert kept.select("label").count() == len(rows) and {r.lang_pred for r in kept.select("lang_pred").collect()} == {"und"}


def test_a_rare_language_is_learned_and_weighted(spark):
    rows = [(i, "the and that with" if i % 50 else "les des une dans", "fr" if i % 50 == 0 else "en") for i in range(3000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), sample=100)
    assert model.languages == ["en", "fr"]
    docs = spark.createDataFrame([(0, "les des une"), (1, "the and")], "doc_id LONG, text STRING")
    found = language_id.predict(docs, ["doc_id"], model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["fr", "en"]


# --- whitening


def embedding_rows(d=20, n=300):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((n, d)) * np.linspace(3, 0.2, d)
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (None, rows[5][1], 0), rows[7], rows[7]]
    rows += [(902, None, 0), (903, [None, *rows[0][1][1:]], 0), (904, [math.nan] * d, 0), (905, [math.inf] * d, 0)]
    return rows + [(906, [], 0), (907, [1.0, 2.0], 0), (908, [0.0] * d, None), (909, [-0.0] * d, None)]


def expected_components(rows, d, k=16):
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows
              if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({tuple(x) for _, x in usable})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fitted])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = float((centred**2).sum() / n)
    out = []
    for i, x in usable:
        y = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (y @ vectors) / np.sqrt(values)))
    return out, values / trace


@pytest.mark.parametrize(("d", "n"), [(20, 300), (40, 300), (5, 60)])
def test_whitened_rows(spark, tmp_path, d, n):
    rows = embedding_rows(d, n)
    folder = write(tmp_path, {"embeddings": rows}, (*CLASHING, "x", "whitened", "component"))
    expected, explained = expected_components(rows, d)
    found = whitening.op13_whitening(spark, folder).collect()
    k = min(16, d)
    assert len(found) == k * len(expected)
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation)
    got = {}
    for r in found:
        got.setdefault((key(r)), {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, count, deviation, white in expected:
        own = got[(i is None, i or 0, deviation)]
        assert sorted(own) == list(range(1, k + 1))
        for c, same in own.items():
            for r in same:
                assert r.n == count and r.deviation == deviation
                assert abs(abs(r.whitened) - abs(white[c - 1])) < 1e-9
                if abs(white[c - 1]) > 1e-6:
                    signs.setdefault(c, set()).add(r.whitened * white[c - 1] > 0)
                assert abs(r.explained / explained[c - 1] - 1) < 1e-9
                assert 0 <= r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())
    assert len({r.identity_error for r in found}) == 1


def test_equal_vectors_and_short_lists(spark):
    for rows in ([(1, [1.0, 2.0])] * 4, [(1, [])], [(1, None)], [(1, [math.nan])]):
        frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
        assert whitening.whitened_components(frame).collect() == []
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id LONG, embedding ARRAY<FLOAT>")
    found = whitening.whitened_components(two).collect()
    assert [r.component for r in found] == [1, 1] and abs(abs(found[0].whitened) - 1) < 1e-12
    assert found[0].explained == pytest.approx(1.0)


def test_close_eigenvalues_are_certified(spark):
    """A block of fewer columns than dimensions finds 4 of 60 almost equal directions."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 200, (3000, 60)) + 1_000_000
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "x ARRAY<LONG>")
    fit = whitening.fit_list(frame)
    found = whitening.components(fit, k=4, guards=8)
    centred = np.unique(x, axis=0) - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(centred))
    assert found.iterations > 1
    assert np.allclose(found.values, values[::-1][:4], rtol=1e-10)
    assert np.allclose(np.abs(found.vectors), np.abs(vectors[:, ::-1][:, :4]), atol=1e-8)


def test_large_numbers_stay_exact():
    deviations = np.array([[2**33, -(2**31)], [3, 4]])
    assert whitening._exact_squares(deviations) == [2**66 + 2**62, 25]


def test_given_embeddings(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    rows = [(r["vec_id"], r["embedding"], 0) for r in pq.read_table(path).to_pylist()]
    expected, explained = expected_components(rows, 64)
    found = whitening.op13_whitening(spark, "/root/testdata/sf0.01").collect()
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == 16 * len(expected)
    for i, n, deviation, white in expected:
        for c in range(16):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(white[c])) < 1e-9
            assert abs(r.explained / explained[c] - 1) < 1e-9
