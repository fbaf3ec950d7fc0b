"""Whitening, vector codes and language identification against brute force and held-out rows, with odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gistmill.llm import codes, language, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, x string, n string, component string"


def vectors(spark, rows):
    """Vectors with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "x", "n", "c") for i, v, label in rows], VECTORS).repartition(3)


BAD = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [1.0, float("nan"), 2.0], 1), (903, [1.0, float("-inf"), 2.0], 1), (904, [], 1), (905, [1.0], 1), (906, [1.0, 1e300, 2.0], 1)]


# --- 11: whitening


def whole(c):
    return F.transform(c, lambda v: F.floor(v * 64) + 1_000_000)


def brute_whitening(x):
    n, sums = len(x), x.astype(object).sum(axis=0)
    c = x - np.array([float(s) / n for s in sums])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [int(v) for v in ((x.astype(object) * n - sums) ** 2).sum(axis=1)]
    return e, c @ u / np.sqrt(e), e / e.sum(), deviation


def held(got, ids, x, k):
    e, z, explained, deviation = brute_whitening(x)
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == len(ids) * k and (got.n == len(ids)).all()
    order = np.argsort(ids)
    own = got.whitened.to_numpy().reshape(len(ids), k)
    z = z[order, :k]
    sign = np.sign((z * own).sum(axis=0))
    assert np.abs(z - own * sign).max() < 1e-7
    assert np.abs(got.explained.to_numpy().reshape(-1, k) - explained[:k]).max() < 1e-12
    assert got.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == [deviation[i] for i in order]
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_op11_by_brute_force(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.floor(64 * np.array(rows.embedding.tolist(), dtype=float)).astype(np.int64) + 1_000_000
    held(queries.op11_whitening(spark, SF).toPandas(), rows.vec_id.to_numpy(), x, 32)


@pytest.mark.parametrize(("fall", "full"), [(0.6, False), (0.999, True)])
def test_range_finder_expands_where_residuals_fail(spark, fall, full):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 40)) * 1e5 * fall ** np.arange(40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]).astype(np.int64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(4)
    model = whitening.fit(rows, 40, 300, components=4)
    assert (model.passes[-1] == 40) == full and all(p == 14 for p in model.passes[:-1])
    e, z, explained, _ = brute_whitening(x)
    assert np.abs(model.values / e[:4] - 1).max() < 1e-12
    own = model.apply(x)
    assert np.abs(own * np.sign((own * z[:, :4]).sum(axis=0)) - z[:, :4]).max() < 1e-6


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 2), v.tolist(), 0) for i, v in enumerate(rng.normal(size=(40, 3)))] + [(None, [0.5, 0.25, 1.0], 0)] * 2
    got = whitening.whiten(vectors(spark, rows + BAD), whole(F.when(F.forall("embedding", lambda c: F.abs(c) < 1e9), F.col("embedding")))).toPandas()
    assert len(got) == 42 * 3 and got.vec_id.isna().sum() == 6 and sorted(got.component.unique()) == [1, 2, 3] and (got.n == 42).all()
    assert abs(got[got.component == 1].whitened.pow(2).mean() - 1) < 1e-9
    flat = [(i, [1.0, float(i % 2), float(i % 2)], 0) for i in range(10)]  # one direction has all variance
    assert whitening.whiten(vectors(spark, flat), whole(F.col("embedding"))).select("component").distinct().collect() == [(1,)]
    for none in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, BAD[:5]):
        assert whitening.whiten(vectors(spark, none), whole(F.col("embedding"))).count() == 0


def test_deviations_beyond_64_bits_on_the_way():
    x = np.array([[1 << 39, 5], [-(1 << 39), 6], [0, 7]], dtype=np.int64)
    mean = whitening.Mean.of(3, [0, 18])
    assert mean.deviations(x) == [None, None, 9]
    assert mean.deviations(x[2:]) == [9]


# --- 12: language


def test_op12_predicts_held_out_rows(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    got = queries.op12_language(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert (out.lang_pred.to_numpy() == docs.lang.loc[out.doc_id].to_numpy()).mean() > 0.97


def plain_grams(text):
    """All n-grams by a plain loop."""
    import unicodedata

    out, word = [], ""
    for ch in text.lower() + "\n":
        if unicodedata.category(ch)[0] in "LM":
            word += ch
            continue
        marked = f" {word} "
        if word:
            out += [marked[i : i + n] for n in language.SIZES for i in range(len(marked) - n + 1) if marked[i : i + n].strip()]
        word = ""
    return [g for g in out if not (len(g) == 1 and g == " ")]


def hashed(texts):
    found = [[] for _ in texts]
    for codes_, owner in language.pieces(texts):
        for n, gram, text in language.grams(codes_, owner):
            for g, t in zip(gram.tolist(), text.tolist(), strict=True):
                found[t].append((n, g))
    return found


def test_grams_are_those_of_words(monkeypatch):
    texts = ["Ab, cde f", None, "", "...", "x", "Éa-b\n\nçß 12 z", "a" * 40]
    number: dict = {}
    got = hashed(texts)
    for text, own in zip(texts, got, strict=True):
        want = plain_grams(text or "")
        assert len(own) == len(want)
        for n in language.SIZES:
            a, b = sorted(g for m, g in own if m == n), sorted(x for x in want if len(x) == n)
            assert len(set(a)) == len(set(b)) and sorted(map(a.count, set(a))) == sorted(map(b.count, set(b)))
            number.update(dict.fromkeys(b))
    monkeypatch.setattr(language, "PIECE", 7)
    texts.remove("a" * 40)  # its pieces are words of their own
    assert [sorted(x) for x in hashed(texts)] == [sorted(x) for x in got[:-1]]


def test_filters_hold_all_their_grams_and_correct_for_false_ones():
    rng = np.random.default_rng(9)
    for many in (3, 9, 70):
        gram = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
        owner = rng.integers(0, many, 5000)
        own = language.Filters.of([f"l{k}" for k in range(many)], gram, owner)
        hits = own.hits(gram, owner, many)
        assert (np.diag(hits) == np.bincount(owner, minlength=many)).all()
        other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
        seen = own.hits(other, np.zeros(20000, dtype=np.int64), 1)[0]
        assert np.abs(seen - 20000 * own.false).max() < 6 * np.sqrt(20000 * own.false.max()) + 3


def test_language_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, gram string, size int"
    rows = [(i, "the cat and the dog are in the house", "en", "g", 1) for i in range(8)] + [(i, "der hund und die katze sind im haus", "de", "g", 1) for i in range(10, 17)]
    rows += [(20, "perro", None, "g", 1), (21, None, "fr", "g", 1), (22, "", "fr", "g", 1), (23, "12 34 !?", "fr", "g", 1), (None, "die katze", None, "g", 1), (24, "日本", None, "g", 1), (25, "the dog " * 90000, None, "g", 1), (25, "DER HUND", None, "g", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    model = language.train(docs)
    assert set(model.languages) == {"en", "de"}  # texts without letters teach nothing
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    found = {(i, lang) for i, lang, _ in got}
    assert len(got) == len(rows) and {(20, "de"), (20, "en")} & found and {(21, "und"), (22, "und"), (23, "und"), (None, "de"), (25, "en"), (25, "de")} <= found
    assert {i: s for i, _, s in got if i in (21, 22, 23, 24)} == dict.fromkeys((21, 22, 23, 24), 0.0) and (24, model.languages[0]) in found
    none = language.train(docs.filter("lang IS NULL"))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0 and language.train(docs.limit(0)).languages == []


# --- 13: vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows]
    size = len(kept[0][1])
    cut = codes.widths(size, parts)
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in start] for p in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for k, p in enumerate(cut):
            own = [[] for _ in books[k]]
            for _, v, _ in kept:
                own[nearest(v[p], books[k])[1]].append(v[p])
            books[k] = [[sum(col) // len(o) for col in zip(*o, strict=True)] if o else c for o, c in zip(own, books[k], strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(v[p], b) for p, b in zip(cut, books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total: dict = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("labels", [10_000, 1])
def test_codes_by_brute_force(spark, labels, monkeypatch):
    monkeypatch.setattr(codes, "LABELS", labels)  # broadcast, and dealt
    rng = np.random.default_rng(8)
    rows = [(int(i // 2), (np.round(v * 40) / 1024).tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(rng.normal(size=(120, 6)))]
    rows += [(None, [0.0] * 6, None)] * 3 + [(500, [5e9] + [-3e9] * 5, 4)]  # repeated rows, and squares beyond 64 bits on the way
    bad = [(i, v and (v * 6)[:5], label) for i, v, label in BAD[:5]]
    got = codes.compress(vectors(spark, rows + bad), F.transform("embedding", lambda c: c * 1024), entries=16).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == brute_codes(rows, entries=16)


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_bounds_keep_the_nearest(bits):
    rng = np.random.default_rng(bits)
    entries, x = rng.integers(-50, 50, (200, 8)), rng.integers(-60, 60, (500, 8))
    cells = codes.Cells.of(entries, bits)
    square = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    entry, least = cells.nearest(x)
    assert (entry == square.argmin(axis=1)).all() and (least == square.min(axis=1)).all()
    assert bits == 1 or len(cells.candidates(x)[0]) < 0.5 * square.size  # most entries are never measured
    same = codes.Cells.of(np.ones((5, 3), dtype=np.int64), bits)
    assert same.nearest(np.zeros((4, 3), dtype=np.int64))[0].tolist() == [0] * 4


def test_codes_of_small_tables(spark):
    x = F.transform("embedding", lambda c: c * 1024)
    assert codes.compress(vectors(spark, []), x).count() == 0 and codes.compress(vectors(spark, BAD[:5]), x).count() == 0
    (one,) = codes.compress(vectors(spark, [(7, [0.5, -0.5], None)]), x).collect()  # fewer places than parts
    assert (one.vec_id, one.code, one.error, one.label_error) == (7, "00000000", 0, 0)
