"""Language identification, whitening and importance resampling against plain versions and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import language_id, resampling, whitening

WORDS = {"en": "the of and to house water that with from people river under many stone", "de": "der die und das haus wasser nicht mit von leute fluss unter viele steine", "fr": "le la et les maison eau que avec dans gens fleuve sous plusieurs pierres"}


def texts(n=240, seed=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(8, 80))).capitalize() + ".", lang))
    return out


def test_languages_of_held_out_texts(spark):
    rows = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    known = language_id.learn_dictionaries(rows.where("doc_id < 150"))
    out = language_id.identify_language(rows.where("doc_id >= 150"), known).join(rows, "doc_id").collect()
    assert len(out) == 90 and all(r.lang_pred == r.lang and r.accepted and 0.5 < r.score <= 1 for r in out)


def test_smallest_code_wins_as_plain_compression_has_it(spark):
    import zstandard as zstd

    rows = texts()
    known = {lang: language_id.dictionary([language_id.fold(t) for _, t, l in rows[:150] if l == lang], 20_000) for lang in WORDS}
    coder = language_id.Coder(known)
    for _, t, _ in rows[150:]:
        plain = [len(zstd.ZstdCompressor(level=12, dict_data=zstd.ZstdCompressionDict(known[n], dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress(language_id.fold(t))) for n in sorted(known)]
        assert coder(t)[0] == sorted(known)[int(np.argmin(plain))]


def test_language_edge_cases(spark):
    long = "der haus wasser und " * 60_000
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 — 456 !?", "x"), (4, long, "x"), (5, "the water of the river", "x"), (5, "the water of the river", "x"), (None, "le maison et les gens dans le fleuve", "x"), (7, "zzqx", "x")], "doc_id long, text string, lang_pred string")
    known = language_id.learn_dictionaries(spark.createDataFrame(texts() + [(900, None, "en"), (901, "haus", None), (902, "...", "symbols")], "doc_id long, text string, lang string"))
    assert sorted(known) == sorted(WORDS)
    out = sorted(((r.doc_id or 0, r.lang_pred, r.accepted, r.score) for r in language_id.identify_language(rows, known).collect()))
    assert [x[:2] for x in out if x[0] != 7] == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en")]
    assert all(s == 0 and not a for _, lang, a, s in out if lang == "und")
    assert not next(a for i, _, a, _ in out if i == 7)  # a word of no language: the margin is narrow
    assert language_id.identify_language(rows.limit(0), known).count() == 0
    nothing = language_id.learn_dictionaries(rows.limit(0).withColumnRenamed("lang_pred", "lang"))
    assert nothing == {} and {r.lang_pred for r in language_id.identify_language(rows, nothing).collect()} == {"und"}
    one = language_id.identify_language(rows.where("doc_id = 5").withColumn("doc_id", F.lit("d5")), {"en": known["en"]}).first()
    assert (one.doc_id, one.lang_pred, one.score, one.accepted) == ("d5", "en", 1.0, True)


@pytest.mark.parametrize("folded", [b"", b" a ", b" " + b"ab " * 5000, b"x" * 20_000, " é".encode() * 9000])
def test_pieces_put_together_are_the_text(folded):
    parts = language_id.pieces(folded, 1000)
    assert b"".join(parts) == folded and max(map(len, parts)) <= 1000


def embeddings(n, d, seed=0, flat=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * (1 if flat else 0.9 ** np.arange(d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "flat"), [(400, 48, False), (300, 30, True), (60, 5, False)])
def test_whitening_equals_a_full_eigendecomposition(spark, n, d, flat):
    rows = embeddings(n, d, flat=flat)
    vectors = whitening.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    out = whitening.whiten(vectors, whitening.fit_whitening(vectors)).collect()
    x = np.array([[math.floor(1024 * v) + 100_000 for v in row] for _, row in rows], dtype=object)
    sums, k = x.sum(axis=0), min(8, d)
    centred = (x - sums / n).astype(float)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    assert len(out) == n * k and {r.component for r in out} == set(range(1, k + 1))
    got = np.zeros((n, k))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9
        assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums))
    want = centred @ vectors_[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        assert np.allclose(got[:, c], want[:, c] * np.sign(got[:, c] @ want[:, c]), atol=1e-6)


def test_whitening_needs_no_full_basis_where_values_fall_fast(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 3)) @ rng.standard_normal((3, 40))
    vectors = whitening.whole_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), scale=2**20)
    fitted = whitening.fit_whitening(vectors, 3)
    exact = np.linalg.eigvalsh(np.cov(np.array([r.x for r in vectors.collect()], dtype=float).T, bias=True))[::-1][:3]
    assert np.allclose(fitted.values, exact, rtol=1e-10)


def test_whitening_edge_cases(spark):
    rows = [(1, [1.0, 2.0, 3.0], 9), (1, [1.0, 2.0, 3.0], 9), (2, [0.5, -2.0, 3.0], 9), (3, None, 9), (4, [1.0, None, 2.0], 9), (5, [1.0, float("nan"), 0.0], 9), (6, [float("inf"), 0.0, 0.0], 9), (7, [1.0], 9), (8, [], 9), (None, [7.0, 1.0, 3.0], 9), (9, [1e30, 0.0, 0.0], 9)]
    vectors = whitening.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int"))
    assert sorted(str(r.vec_id) for r in vectors.collect()) == ["1", "1", "2", "None"]
    out = whitening.whiten(vectors, whitening.fit_whitening(vectors)).collect()
    assert {r.component for r in out} == {1, 2} and len(out) == 8 and all(r.n == 4 and r.identity_error < 1e-9 for r in out)  # the third entry is the same in all rows
    for none in (vectors.limit(0), vectors.where("vec_id = 1")):
        assert whitening.whiten(none, whitening.fit_whitening(none)).count() == 0
    wide = whitening._deviations(np.array([[10**15, -5], [100, 7]]), 10**5, (10**16, 10**3))
    assert wide == [None, (10**5 * 100 - 10**16) ** 2 + (10**5 * 7 - 10**3) ** 2] or wide == [None, None]


def plain(docs, target, runs=1, buckets=10_000, percent=10, least=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    def counts(t):
        w = split(t)
        return Counter(zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1))
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(counts(x))
    for x in target:
        t.update(counts(x))
    ss, tt, out = sum(s.values()), sum(t.values()), {}
    for i, x in docs:
        c = counts(x)
        weight = sum(n * math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b, n in c.items())
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    open_ = sorted((-out[i][2], i) for i, x in docs if len(split(x)) >= least)
    for place, (_, i) in enumerate(open_[: len(open_) * percent // 100]):
        out[i][3] = place + 1
    return out


@pytest.mark.parametrize(("runs", "block"), [(1, 500_000), (3, 50)])
def test_resampling_equals_a_plain_one(spark, runs, block, monkeypatch):
    monkeypatch.setattr(resampling.count_blocks, "__kwdefaults__", {**resampling.count_blocks.__kwdefaults__, "block": block})
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["Tok%d" % rng.randint(0, 60), "é%d" % rng.randint(0, 9), "x-y", "A1"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "tok1 " * 30_000), (303, "... \x00\x7f --")]
    target = [" ".join(f"tok{rng.randint(0, 9)}" for _ in range(40)) for _ in range(20)] + [None, ""]
    out = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), runs=runs)
    want = plain(docs, target, runs)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in out.collect()} == want


def test_resampling_edge_cases(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = spark.createDataFrame([(None, text, 1)] + [("a", text, 1)] * 30 + [("b", text, 1)], "doc_id string, text string, rank int")
    out = resampling.resample(rows, rows.limit(0)).collect()
    assert len(out) == 32 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]
    assert all(r.doc_id is not None for r in out if r["rank"]) and next(r for r in out if r.doc_id is None).score is None
    assert resampling.resample(rows.limit(0), rows).count() == 0


def test_blocks_hold_every_count(spark):
    rows = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 5}") for i in range(200)], "row long, text string")
    sums = resampling.column_sums(resampling.count_blocks(rows, block=10)).collect()
    assert sum(r.c for r in sums) == 600 and len(sums) == 7
