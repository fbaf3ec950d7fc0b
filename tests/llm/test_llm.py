"""The operators against brute force, the library, round trips, and SQL, with odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from gistmill import lineage
from gistmill.llm import ann, bpe, chat, exact_dedup, lines, minhash, packing, queries, suffix, toxicity, urls
from gistmill.llm import rows as rows_module
from gistmill.llm.shingles import hashed_words
from gistmill.operators.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, set_hash string, spans string, component string"


def frame(spark, docs):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in docs], SCHEMA).repartition(3)


ODD = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "a"), (9004, "é" * 300), (9005, "x" * 5000), (9006, "one two three four five six"), (9007, "one two three four five six")]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = ["w%d" % k for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 90))) for _ in range(40)] + [" ".join(words[k : k + 150]) for k in (0, 140)]
    out = []
    for i in range(160):
        text = rng.choice(base).split()
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, ("\n" if i % 3 else " ").join(" ".join(text[k : k + 12]) for k in range(0, len(text), 12))))
    out += [(200 + i, " ".join(words[i * 3 : 140 + i * 2])) for i in range(12)]  # long lines, of about LONG words or more
    return [*out, *ODD]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1: BPE


def test_bpe_is_the_library(spark):
    own = bpe.encoder(bpe.vocabulary_path())
    rng = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["It's <|endoftext|> 42 naïve — 日本 İΣς a\x85b\x1cc", "don't<|startoftext|>x"]
    texts += ["".join(rng.choice("abcdé '.\n😀") for _ in range(rng.randint(1, 300))) for _ in range(300)] + ["".join(rng.choice("aAbt") for _ in range(9000))]
    for t in texts:
        want = own.library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == own.library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [3, 8, 50])
def test_tree_concatenation_is_exact(leaf):
    own = bpe.encoder(bpe.vocabulary_path())
    rng = random.Random(leaf)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "ingeration"):
        t = "".join(rng.choice(letters) for _ in range(700))
        assert own.tree(t, leaf) == own._tokens(t)


def test_bpe_rows(spark):
    got = {r.doc_id: r for r in bpe.encode(frame(spark, ODD)).collect()}
    assert len(got) == len(ODD) and got[9000].n_tokens == got[9001].n_tokens == 0 and got[9000].ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, ODD))).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in back.items()} == {i: r.decoded_sha256 for i, r in got.items()}
    assert bpe.encode(empty(spark)).count() == 0


# --- 2: near copies


def near_brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_dedup(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, docs)).collect()}
    assert got == near_brute(docs)
    assert minhash.near_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_keeps_links_of_repeated_ids(spark, seed):
    """A document's rows are decided alike, and each of its texts links it with others."""
    rng = random.Random(seed)
    text = {k: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(60)) for k in "ABCDE"}
    text["near"] = text["C"].rsplit(" ", 1)[0] + " end"
    rows = [(1, text["A"]), (5, text["A"]), (5, text["B"]), (5, text["B"]), (7, text["A"]), (8, text["B"]), (9, text["C"]), (10, text["C"]), (10, text["D"]), (10, ""), (11, text["D"]), (12, text["near"]), (13, text["E"]), (13, None), (None, text["A"]), (20, ""), (20, None)]
    rng.shuffle(rows)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (5, 1, False), (7, 1, False), (8, 1, False), (9, 9, True), (10, 9, False), (11, 9, False), (12, 9, False), (13, 13, True), (None, None, True), (20, 20, True)}
    assert (7, 5, False) in {(r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(frame(spark, [x for x in rows if x[0] != 1])).collect()}
    assert minhash.near_dedup(frame(spark, rows)).count() == len(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert len(got) == 103 and got[100] == 0 and got[501] == 500


# --- 3: nearest neighbours


def test_search_is_near_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0] * 3)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hit += len({i for i, _ in found} & {int(i) for i in want})
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and all(abs(d[i] - s) < 1e-9 for i, s in found)
    assert hit / (10 * len(got)) >= 0.9
    assert [i for i, _ in got[100]] == list(range(101, 111))


def test_outliers_beside_a_hot_cluster_get_all_rows(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((np.ones((2500, 8)) + rng.normal(size=(2500, 8)) * 1e-3, rng.normal(size=(60, 8)) * 1000))
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))] + [(2555, [float(v) for v in x[2555]])] * 12
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") >= 2490)
    got = {r.query_id: r for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.max((F.col("query_id") == F.col("vec_id")).cast("int")).alias("own")).collect()}
    assert {i: r.n for i, r in got.items()} == {i: 10 for i in range(2490, 2560)} and not any(r.own for r in got.values())


def test_search_of_small_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(few.filter("vec_id > 9"), F.col("vec_id") == 0).count() == 0


def test_search_with_repeated_ids_and_vectors_of_any_size(spark):
    schema = "vec_id long, embedding array<double>, list string, score string, row string"
    table = lambda rows: spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], schema)
    twice = table([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])])
    ranked = lambda found: [(r.query_id, r["rank"], r.vec_id) for r in found.orderBy("query_id", "rank").collect()]
    assert ranked(ann.search(twice, F.col("vec_id") == 0, k=2)) == [(0, 1, 2), (0, 2, 1)]
    apart = table([(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [0.0, 4.0]), (2, [1.5, 0.0]), (2, [1.5, 0.0])])
    assert ranked(ann.search(apart, F.col("vec_id") == 0)) == [(0, 1, 2), (0, 2, 2), (0, 3, 1)]
    big = table([(0, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [1e200, 3e200]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0]), (5, [1.7e308, -1.7e308])])
    got = [(r.vec_id, r.score) for r in ann.search(big, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 3, 4, 2, 5] and np.allclose([x for _, x in got[:4]], [1e200, 1e200, 1e200, 3e200])
    small = [(r.vec_id, r.score) for r in ann.search(big, F.col("vec_id") == 3).orderBy("rank").collect()]
    assert small[0][0] == 4 and np.isclose(small[0][1], 2e-200, rtol=1e-12, atol=0)


# --- 4: toxicity


def test_class_models_sum_to_one(spark, monkeypatch):
    rows = [(i, f"plain{i % 90} common{i % 7} " + (f"vile{i % 50} vile{i % 50} foul" if i % 3 == 0 else f"vilest{i} word") * 2) for i in range(600)]
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "_packed", lambda nodes, own=toxicity._packed: (seen.append(nodes), own(nodes))[1])
    model = toxicity.train(frame(spark, rows), known).named(seen)
    words = sorted({toxicity.expression(x) for _, t in rows for x in t.encode().split()} | {"unknown", "vi", "vilex", "plainest", "ü"})
    assert np.allclose(model.ratios(words), [model.log_ratio(w) for w in words], rtol=0, atol=1e-12)
    counts = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 not in (0, 4):
            for x in t.encode().split():
                counts[0][toxicity.expression(x) + "$"][i % 3 == 0] += 1
    for k, n in enumerate(toxicity.LEVELS):
        for node, c in counts[k].items():
            for side in (0, 1):
                counts[k + 1][node[:n]][side] += c[side] > 0
    for k, at in enumerate(model.levels):  # with the nodes that scoring does not need
        assert at["excess"] and all(counts[k][n][0] == v for n, v in at["own"].items())
        at["own"] = {n: c[0] for n, c in counts[k].items()}
        at["children"] = dict(Counter(n[: toxicity.LEVELS[k - 1]] for n in counts[k - 1])) if k else {}
    chains = [toxicity.chain(n[:-1]) for n in counts[0]]
    # of each shorter form an unseen one
    unseen = [["?"] * k + c[k:] for k in (1, 2, 3) for c in {c[k]: c for c in chains}.values()] + [["?"] * 4]
    for side in (0, 1):
        assert abs(sum(model.probabilities(c)[side] for c in [*chains, *unseen]) - 1) < 1e-9
    assert all(abs(toxicity._held(np.log(t / o)) - model.plain) < 1e-9 for c in chains for o, t in [model.probabilities(c)] if not any(n in at["excess"] for at, n in zip(model.levels, c, strict=True)))


def test_toxicity_learns_rare_expressions(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words = ["w%d" % rng.randrange(400) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileone", "viletwo", "vilething" + str(rng.randrange(90)), "foul!"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    known = spark.createDataFrame([*labels, (77, 1, None), (9999, 1, 5)], "doc_id long, quality int, toxic int")
    table = frame(spark, [*rows, *ODD])
    model = toxicity.train(table, known)
    got = {r.doc_id: r.toxicity for r in toxicity.score(table, model).collect()}
    held = [(got[i] >= 0.5, t == 1) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001] < 0.5
    none = toxicity.train(table, known.filter("toxic = 0"))
    assert {r.toxicity for r in toxicity.score(table, none).collect()} == {0.0}


def test_toxicity_counts_all_rows_and_keeps_all_nodes(spark, monkeypatch):
    rows = [(i, f"plain{i % 90} common{i % 7} " + (f"vile{i % 50} vile{i % 50} foul" if i % 3 == 0 else f"vilest{i} word") * 2) for i in range(600)]
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    table = frame(spark, [*rows, *ODD])
    model = toxicity.train(table, known)
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    few = toxicity.train(table, known)
    assert [x["own_total"] for x in few.levels] == [x["own_total"] for x in model.levels]
    monkeypatch.setattr(toxicity, "NODES", 5)
    joined = toxicity.train(table, known)
    assert joined.nodes and np.allclose(joined.weights, few.weights, rtol=1e-6)
    plain, wide = ({r.doc_id: r.toxicity for r in toxicity.score(table, m).collect()} for m in (few, joined))
    assert plain.keys() == wide.keys() and all(abs(plain[i] - wide[i]) < 1e-6 for i in plain)


def plain_toxicity(rows, labels):
    """The same formulas in plain Python: counts of both classes, discounts, excesses, log-ratios, features, logistic function."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    label = {}
    for i, t in labels:
        label[i] = t if label.get(i, t) == t else None
    label = {i: t for i, t in label.items() if t in (0, 1) and fold(i) != 0}
    counts = [defaultdict(lambda: [0, 0, 0]) for _ in range(4)]
    for i, text in rows:
        if label.get(i) is not None and fold(i) != 4:
            for x in (text or "").encode().split():
                if word := toxicity.expression(x):
                    counts[0][word + "$"][label[i]] += 1
    for c in counts[0].values():
        c[2] = 1
    for k, n in enumerate(toxicity.LEVELS):
        for node, c in counts[k].items():
            below = counts[k + 1][node[:n]]
            below[0] += c[0] > 0
            below[1] += c[1] > 0
            below[2] += 1
    levels = []
    for level in counts:
        o, t = sum(c[0] for c in level.values()), sum(c[1] for c in level.values())
        once, twice = (sum(c[0] + c[1] == n for c in level.values()) for n in (1, 2))
        d = max(once, 1) / (max(once, 1) + 2 * twice) if twice else 0.75
        over = {n: c[1] - d - c[0] * t / o - 3 * (c[0] * t / o + 0.3) ** 0.5 for n, c in level.items()}
        over = {n: x for n, x in over.items() if x > 0}
        levels.append((level, o, t, d, d * sum(c[0] > 0 for c in level.values()) / o, 1 - sum(over.values()) / t, over))

    def ratio(word):
        nodes = [word + "$", *((word + "$")[:n] for n in toxicity.LEVELS)]
        if not any(n in x[6] for n, x in zip(nodes, levels, strict=True)):
            value = sum(np.log(x[5]) for x in levels)
        else:
            ordinary, forms = 1 / (len(levels[3][0]) + 1), [levels[k + 1][0].get(nodes[k + 1], (0, 0, 0))[2] + 1 for k in range(3)]
            for k in (3, 2, 1, 0):
                level, o, _, d, rest, _, _ = levels[k]
                ordinary = max(level.get(nodes[k], (0, 0))[0] - d, 0) / o + rest * ordinary / (forms[k] if k < 3 else 1)
            toxic = ordinary
            for k in (3, 2, 1, 0):
                toxic = levels[k][6].get(nodes[k], 0) / levels[k][2] / np.prod(forms[:k]) + levels[k][5] * toxic
            value = np.log(toxic / ordinary)
        return min(6.0, max(-2.0, value))

    def features(text):
        x = [ratio(w) if (w := toxicity.expression(r)) else 0.0 for r in (text or "").encode().split()]
        n = min(32, len(x))
        return (max(sum(x[k : k + n]) for k in range(len(x) - n + 1)) / 32, sum(x) / (len(x) + 20)) if x else (0.0, 0.0)

    own = [(features(t), label[i]) for i, t in rows if label.get(i) is not None and fold(i) == 4]
    a, b, c = toxicity._logistic(np.array([f for f, _ in own]), np.array([y for _, y in own]))
    return {i: 1 / (1 + np.exp(-np.clip(a * f + b * g + c, -40, 40))) for i, t in rows for f, g in [features(t)]}


def test_toxicity_by_plain_formulas(spark):
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(700):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randint(0, 90))]
        if i % 3 == 0 and words:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "viler!", "Vilest", f"foul{rng.randrange(30)}", "word7"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    labels += [(5, 1, 1), (8, 1, None), (9999, 1, 1)]
    rows.append((2000, "word3 vile " * 30_000))
    table = frame(spark, [*rows, (3000, None)])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score(table, toxicity.train(table, known)).collect()}
    want = plain_toxicity([*rows, (3000, None)], [(i, t) for i, _, t in labels if t is not None])
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_very_long_texts(spark):
    """Texts of some hundred thousand characters, near copies and repeats among them."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    near = words[:]
    near[30_000] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " \n".join(words)), (4, "x" * 300_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(frame(spark, rows)).collect()}
    assert got == {i: x[:2] for i, x in near_brute(rows).items()} and got[3][1] == 1 and got[4][1] == 4
    same = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert same == {1: 1, 2: 2, 3: 1, 4: 4}
    cut = {r.doc_id: r.n_removed for r in suffix.substring_dedup(frame(spark, rows[:2] + rows[3:])).collect()}
    assert cut[1] == 0 and len(rows[1][1]) - cut[2] <= 210 and cut[4] == 299_999  # all but the first byte


def test_urls_in_long_html(spark):
    filler = "<p>" + "text " * 200_000 + "</p>"
    rows = [(1, "http://a.com/x", filler + '<link rel="canonical" href="http://bad.org/es/1">' + filler), (2, "http://b.com/", filler)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got == {1: "block", 2: "allow"}


# --- 5: lines


def lines_brute(docs):
    seen, by_word, gone = set(), defaultdict(list), defaultdict(list)
    for i, t in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        for k, line in enumerate(t.encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if len(s) < lines.LEAST_WORDS:
                continue
            shared = Counter(o for w in s for o in by_word[w])
            if s in seen or any(100 * n >= 80 * (len(s) + len(o) - n) for o, n in shared.items()):
                gone[i].append(k)
            if s not in seen:
                seen.add(s)
                for w in s:
                    by_word[w].append(s)
    return gone


@pytest.mark.parametrize(("small", "medium"), [(64, 2048), (2, 3)])
def test_line_dedup(spark, docs, small, medium, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "MEDIUM", medium)
    got = {r.doc_id: r.removed for r in lines.line_dedup(frame(spark, docs)).collect()}
    want = lines_brute(docs)
    assert got == {i: want.get(i, []) for i, _ in docs}
    texts = {r.doc_id: r.text for r in lines.without_lines(frame(spark, docs)).collect()}
    assert texts == {i: t if i not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in docs}
    assert lines.line_dedup(empty(spark)).count() == 0


def test_short_lines_match_equal_ones(spark):
    repeated = ["Read more", "Share", "All rights reserved", "buy now " * 40, "a b c d", "a b c d e"]
    other = ["read", "All rights", "rights reserved all THE", "buy now x", "", "  "]
    rows = [(i, "\n".join([*repeated, *other[i : i + 1], f"own{i}", "", "more READ"])) for i in range(6)]
    got = {r.doc_id: r.removed for r in lines.line_dedup(frame(spark, rows)).collect()}
    want, before = {}, []
    for i, t in rows:
        want[i] = []
        for k, s in enumerate(set(x.encode().lower().split()) for x in t.split("\n")):
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in before):
                want[i].append(k)
            before.append(s)
    assert got == want and want[0] == [5, 9] and all(want[i][:6] == [0, 1, 2, 3, 4, 5] for i in range(1, 6))


def test_lines_of_a_very_long_text(spark):
    long = ["a b c d e f g h"] + [""] * (1 << 20) + ["q r s t u v w x", "own line of it"]
    rows = [(1, "\n".join(long)), (2, "first\na b c d e f g h\nkept one\nx w v u t s r q"), (3, "\n".join([*long[:-1], "third"]))]
    got = {r.doc_id: r for r in lines.line_dedup(frame(spark, rows)).collect()}
    assert got[1].removed == [] and got[2].removed == [1, 3] and got[3].removed == [0, (1 << 20) + 1] and got[1].n_lines == (1 << 20) + 3
    cut = {r.doc_id: r.text for r in lines.without_lines(frame(spark, rows)).collect()}
    assert cut[1] == rows[0][1] and cut[2] == "first\nkept one" and cut[3] == "\n" * ((1 << 20) - 1) + "\nthird"


def test_rows_with_one_id_lose_their_own_lines(spark):
    rows = [(5, "one two three four\nfive six seven"), (5, "other words stand here\none two three four"), (5, "same text\nhere twice"), (5, "same text\nhere twice"), (4, "five six seven\nnew"), (None, "same text")]
    got = Counter(r.text for r in lines.without_lines(frame(spark, rows)).collect())
    fixed = Counter(["five six seven\nnew", "same text", "same text\nhere twice", ""])
    # of the two that share a line, the one whose text's hash comes first keeps it
    assert got - fixed in (Counter(["one two three four", "other words stand here"]), Counter(["", "other words stand here\none two three four"]))
    assert sum(r.n_removed for r in lines.line_dedup(frame(spark, rows)).collect()) == 4


def test_word_hashes_follow_words():
    text = "Ab  c\tab\n\n Ä c\r\nC".encode()
    words, at = hashed_words(text)
    assert len(words) == 6 and words[0] == words[2] and words[1] == words[4] == words[5] and len(set(words.tolist())) == 3
    assert at.tolist() == [0, 0, 0, 2, 2, 3]
    assert hashed_words(b"")[0].tolist() == [] and hashed_words(b"zz ab")[0][1] == words[0]


def test_ranks_of_words_that_share_leading_bits():
    rng = np.random.default_rng(3)
    words = np.unique(np.concatenate((rng.integers(0, 1 << 44, 900), rng.integers(0, 1 << 20, 300), [0, (1 << 44) - 1])).astype(np.uint64))
    rank_of = rng.permutation(len(words)).astype(np.uint64) + np.uint64(1)
    asked = np.concatenate((words, words + np.uint64(1), words[:0])) & lines._HASH
    known = dict(zip(words.tolist(), rank_of.tolist(), strict=True))
    assert lines.Ranks(words, rank_of, 8)[asked].tolist() == [known.get(w, 0) for w in asked.tolist()]
    assert lines.Ranks(words[:0], rank_of[:0])[asked].tolist() == [0] * len(asked)


# --- 6: exact copies


def test_exact_dedup(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HEAVY", 20)
    rows = [*docs, *((20_000 + i, "a  hot\ttext") for i in range(60)), (30_000, "a hot text"), (None, "lone")]
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    want = {i: (min((x for x in g if x is not None), default=None), len(g), i == min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g}
    assert got == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# --- 7: repeated bytes


def bytes_brute(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = (t or "").encode()
        mark = np.zeros(len(raw), dtype=int)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                mark[k : k + 100] = 1
            seen.add(raw[k : k + 100])
        out[i] = (len(raw), int(mark.sum()), int((np.diff(np.concatenate(([0], mark))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[mark == 0])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix.HOT_ROWS, 2])
def test_substring_dedup(spark, docs, hot):
    rows = [*docs, (700, "ab" * 400), (701, "ab" * 250 + "c" + "ab" * 99)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.substring_dedup(frame(spark, rows), hot_rows=hot).collect()}
    assert got == bytes_brute(rows)
    assert suffix.substring_dedup(empty(spark)).count() == 0
    cut = {r.doc_id: r.text for r in suffix.without_repeats(frame(spark, rows)).collect()}
    assert cut[9000] is None and all(len(cut[i].encode()) <= got[i][0] - got[i][1] for i, t in rows if t is not None)


def test_rows_without_id_lose_only_their_own_repeats(spark, docs):
    own = random.Random(8).sample(range(10**6), 60)
    alone = [" ".join(map(str, own)) * 2 + "é", " ".join(map(str, own)), "ab" * 400, docs[0][1], docs[0][1], "", None]
    rows = [*docs, *((None, t) for t in alone)]
    plain = lambda found: sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    got = plain(suffix.substring_dedup(frame(spark, rows)).collect())
    want = [(i, *v) for i, v in bytes_brute(docs).items()] + [(-1, *bytes_brute([(0, t)])[0]) for t in alone]
    assert got == sorted(want)
    cut = Counter(r.text for r in suffix.without_repeats(frame(spark, rows)).collect() if r.doc_id is None)
    assert cut == Counter([alone[1] + "é", alone[1], "ab", docs[0][1], docs[0][1], "", None])


def test_difference_cover_finds_first_equal():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1500:2200] = text[100:800]
    starts = np.arange(2900)
    first = suffix.first_equal(text, starts)
    raw, seen = text.tobytes(), {}
    assert first.tolist() == [seen.setdefault(raw[i : i + 100], i) for i in range(2900)]
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


# --- 8: urls


def test_urls_and_aliases(spark):
    page = lambda link: f'<head><link href="{link}" rel="canonical"></head>'
    rows = [
        (1, "http://A.Example.com/en/5", None), (2, "https://example.com/en/77?q", ""), (3, "http://x.net/de/1#a", ""), (4, "http://www.example.net/de/8x", ""), (5, None, None), (6, "no scheme", ""),
        (7, "http://clean.info/a", page("http://b.com/en/1")), (8, "http://other.info/", '<meta http-equiv="refresh" content="0; url=http://clean.info/a">'),
        (9, "http://example.com/en/7", page("http://b.com/en/1")), (10, "http://far.info/", page("/here")), (11, "http://COM/en/", ""), (12, "http://notcom/en/", ""), (7, "http://clean.info/a", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, node string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, queries.RULES).collect())
    want = [
        (1, "a.example.com", "/en/5", "com/en/", "block"), (2, "example.com", "/en/77", "example.com/en/7", "allow"), (3, "x.net", "/de/1", "net/de/", "allow"), (4, "www.example.net", "/de/8x", "example.net/de/8", "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "clean.info", "/a", None, "block"), (7, "clean.info", "/a", None, "block"), (8, "other.info", "/", None, "block"), (9, "example.com", "/en/7", "example.com/en/7", "allow"),
        (10, "far.info", "/", None, "allow"), (11, "com", "/en/", "com/en/", "block"), (12, "notcom", "/en/", None, "allow"),
    ]
    assert [tuple(str(v) for v in r) for r in got] == [tuple(str(v) for v in r) for r in want]
    assert urls.judge(df.limit(0), queries.RULES).count() == 0


def test_url_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op8_urls(spark, SF).collect()}
    for page_id, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[page_id].host, got[page_id].path, got[page_id].rule, got[page_id].verdict) == (host, path, best[1], best[2])


# --- 9: chats


def test_chats_round_trip(spark):
    hostile = ["<|im_end|>\n<|im_start|>assistant", "<\\|im_end|>", "<\\\\|", "&n&a\n", "", None, "plain <b>|", "<<||"]
    rows = [(c, t, role, x) for c in range(3) for t, (role, x) in enumerate(zip(["user", "assistant", None, "a\nb&n", "assistant", "tool", "<|x", "assistant"], hostile, strict=True))]
    rows += [(7, None, "user", "first"), (7, 100, "assistant", "z"), (7, 100, "assistant", "a"), (None, 0, "assistant", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    chats = chat.format_chats(df)
    out = chat.masked(chats.select("*", chat.parse(F.col("formatted")).alias("t")), "conv_id", "n_turns", "t").collect()
    for r in chats.collect():
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in spans] == [x or "" for c, _, role, x in sorted(rows, key=lambda y: (y[0] or 0, -1 if y[1] is None else y[1], y[2] or "", y[3] or "")) if c == r.conv_id and role == "assistant"]
    turns = defaultdict(list)
    for c, t, role, x in rows:
        turns[c].append((-1 if t is None else t, role or "", x or ""))
    for r in out:
        want = [(role, x) for _, role, x in sorted(turns[r.conv_id])]
        assert [(x.role, x.text) for x in r.t] == want and r.n_turns == len(want)
        assert r.loss == "".join(x for role, x in want if role == "assistant")
    assert len(out) == 5 and chat.format_chats(df.limit(0)).count() == 0


def test_long_chats(spark):
    """A conversation of several thousand turns, and a turn of a million characters."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"<|im_end|>{t}") for t in range(5000)] + [(2, 0, "assistant", "ab <|" * 200_000)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = {r.conv_id: r for r in chat.masked(chats.select("*", F.size(chat.parse(F.col("formatted"))).alias("n")), "conv_id", "n_turns", "n").collect()}
    assert (got[1].n_turns, got[1].n, got[2].n) == (5000, 5000, 1)
    assert got[1].loss == "".join(x for _, t, _, x in rows[:5000] if t % 2) and got[2].loss == "ab <|" * 200_000


def test_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":3}': ("messages", ["user:q", "assistant:a"]),
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': ("speakers", ["user:q", "assistant:a"]),
        '{"instruction":"do","input":"this","output":"done"}': ("instruction_input", ["user:do\nthis", "assistant:done"]),
        '{"instruction":"do","output":null}': ("instruction", ["user:do", "assistant:"]),
        '{"prompt":"p","completion":"c"}': ("prompt_completion", ["user:p", "assistant:c"]),
        '{"question":"p","answer":"c"}': ("question_answer", ["user:p", "assistant:c"]),
        '{"messages":[{"role":"system"},{"role":"user","content":"q"}],"model":{"prompt":"p"}}': ("messages", ["system:", "user:q"]),
        '{"messages":[{"role":"user","content":7},null,{"content":"x","name":"n"}],"turns":3,"done":true,"note":null}': ("messages", ["user:7", ":", ":x"]),
        # a list in the place of a text, and texts that a mapping would leave out
        '{"messages":[{"role":"user","content":["a",1]},{"role":"x","content":"x"}]}': (None, []),
        '{"messages":[{"role":"user","content":"q"}],"prompt":"p"}': (None, []),
        '{"messages":[{"role":"user","content":"q"}],"prompt":"p","response":"r"}': (None, []),
        '{"messages":[{"role":"user","content":"q"},"and more"]}': (None, []),
        '{"messages":[{"role":"user","content":"q","tool_calls":[{"f":1}]}]}': (None, []),
        '{"prompt":"p","completion":"c","context":"k"}': (None, []),
        '{"prompt":{"text":"p"},"completion":"c"}': (None, []),
        '{"prompt":[{"role":"system","content":"s"},{"role":"user","content":"p"}],"completion":[{"role":"assistant","content":"c"}]}': ("prompt_completion_messages", ["system:s", "user:p", "assistant:c"]),
        '{"prompt":[{"role":"user","content":"p"}],"completion":"c"}': ("prompt_messages", ["user:p", "assistant:c"]),
        '{"prompt":[{"role":"user","content":"p"}],"response":"c"}': ("prompt_response_messages", ["user:p", "assistant:c"]),
        '{"odd":{"messages":[{"role":"user","content":"q"}]}}': (None, []), '{"messages":[]}': (None, []), "[1]": (None, []),
        '{"role":"human","text":"x"}': ("turn_row", ["user:x"]), '{"odd":1}': (None, []), "no json": (None, []),
    }
    df = spark.createDataFrame([(k,) for k in records], "record string")
    got = {r.record: (r.layout, [f"{t.role}:{t.text}" for t in r.turns]) for r in chat.canonical_turns(df, "record", "record").collect()}
    assert got == records
    rows = chat.canonical_turns(df, "record", "record").collect()
    prints = {(r.layout, r.fingerprint) for r in rows if r.layout}
    assert len(prints) == len({r.layout for r in rows} - {None})  # one for each layout
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"d":1,"e":"x"}}}}',), ('{"a":{"b":{"c":{"d":1}}}}',)], "record string")
    assert [chat.canonical_turns(deep, "record", depth=n).select("fingerprint").distinct().count() for n in (2, 4)] == [1, 2]


# --- 10: packing


def test_packing(spark, docs):
    rows = [*docs, (500, "word. " * 9000)]
    own = bpe.encoder(bpe.vocabulary_path())
    got = packing.pack(frame(spark, rows), flush=12_000).collect()
    ids = {i: np.array([*own.encode(t), 1], dtype="<u4") for i, t in rows}
    at, sequences = defaultdict(int), defaultdict(list)
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        at[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert at == {i: len(x) for i, x in ids.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding < 0.1 * sum(map(len, ids.values()))
    assert packing.pack(empty(spark)).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(50):
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + rng.randint(1, 9))
        penalties = [0, *(rng.choice([0, 2, 5]) for _ in places[1:])]
        cost = lambda chosen: sum(10 - (places[b] - places[a]) + penalties[b] for a, b in zip([0, *chosen], chosen, strict=False))  # noqa: B023, E731
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + 10 - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= 10)
        assert cost(packing.cuts(places, penalties, 10)) == best[len(places) - 1]


# --- the registered queries, on whole tables


@pytest.fixture(scope="module")
def whole(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def found(spark, name, *columns, key="doc_id"):
    rows = queries.QUERIES[name](spark, SF).collect()
    out = {r[key]: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1_by_the_library(spark, whole):
    library = bpe.encoder(bpe.vocabulary_path()).library
    want = {}
    for i, t in whole:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert found(spark, "op1_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op2_by_brute_force(spark, whole):
    assert found(spark, "op2_minhash", "n_shingles", "component_id", "kept") == near_brute(whole)


def test_op3_by_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    got = defaultdict(list)
    for r in queries.QUERIES["op3_ann"](spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, ranked in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        hits += len({i for _, i, _ in ranked} & set(want))
        assert [k for k, _, _ in sorted(ranked)] == list(range(1, len(want) + 1)) and all(abs(d[ids == i][0] - s) < 1e-9 for _, i, s in ranked)
    assert hits >= 0.9 * 10 * len(got)


def test_op4_scores_every_document(spark, whole):
    got = found(spark, "op4_toxicity", "held_out", "score", "predicted")
    assert got.keys() == {i for i, _ in whole}
    for i, (held_out, score, predicted) in got.items():
        assert held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.5)


def test_op5_by_brute_force(spark, whole):
    want = lines_brute(whole)
    assert found(spark, "op5_lines", "n_lines", "removed") == {i: (0 if t is None else t.count("\n") + 1, want.get(i, [])) for i, t in whole}


def test_op7_by_brute_force(spark, whole):
    assert found(spark, "op7_suffix", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_brute(whole)


def test_op10_keeps_every_id_once(spark, whole):
    own = bpe.encoder(bpe.vocabulary_path())
    at, ends = defaultdict(int), defaultdict(list)
    for p in sorted(queries.QUERIES["op10_packing"](spark, SF).collect(), key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id]
        at[p.doc_id] += p.length
        ends[p.sequence_id].append((p.offset, p.length))
    assert at == {i: len(own.encode(t)) + 1 for i, t in whole}
    for pieces in ends.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


# --- odd rows


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_keys_of_repeated_ids(spark, ids, monkeypatch):
    """Unique, in the order of ids, whether the rows whose ids repeat are numbered alone or all rows are."""
    monkeypatch.setattr(rows_module, "BROADCAST_IDS", ids)
    docs = [(i, f"t{i}") for i in (-5, 0, 3, 3, 3, 7, 7, 9, 1 << 40)] + [(None, "a"), (None, "b"), (3, "t3"), (3, None)]
    got = sorted((r[rows_module.KEY], r.doc_id) for r in rows_module.keyed(frame(spark, docs), "doc_id", "text").collect() if r.doc_id is not None)
    assert [i for _, i in got] == sorted(i for i, _ in docs if i is not None) and len({k for k, _ in got}) == 11
    assert all(r[rows_module.KEY] is None for r in rows_module.keyed(frame(spark, docs), "doc_id", "text").collect() if r.doc_id is None)
    wide = [(1 << 61, "x"), (1 << 61, "y"), (-(1 << 61), "z")]
    assert [i for _, i in sorted((r[rows_module.KEY], r.doc_id) for r in rows_module.keyed(frame(spark, wide), "doc_id", "text").collect())] == sorted(i for i, _ in wide)


@pytest.mark.parametrize("ids", [1_000_000, 0])
def test_rows_with_one_id_are_documents_of_their_own(spark, ids, monkeypatch):
    monkeypatch.setattr(rows_module, "BROADCAST_IDS", ids)
    rng = random.Random(12)
    own, first, other = ("".join(rng.choice("abcdefghij klm") for _ in range(300)) for _ in range(3))
    rows = [(1, first + own), (1, other), (2, "before " + own + " after"), (2, "before " + own + " after"), (3, None), (3, "")]
    got = suffix.substring_dedup(frame(spark, rows)).collect()
    assert len(got) == 6 and sum(r.n_removed == 0 for r in got if r.doc_id == 1) >= 1 and sorted(r.n_bytes for r in got if r.doc_id == 3) == [0, 0]
    cut = [r.text for r in suffix.without_repeats(frame(spark, rows)).collect()]
    assert rows[1][1] in cut and cut.count(None) == 1 and "" in cut
    twice = [*rows, *rows]
    assert sorted(r.n_tokens for r in bpe.encode(frame(spark, twice)).collect()) == sorted(2 * [r.n_tokens for r in bpe.encode(frame(spark, rows)).collect()])
    packed = packing.pack(frame(spark, twice)).collect()
    assert sum(p.length for p in packed) == 2 * sum(p.length for p in packing.pack(frame(spark, rows)).collect())
    same = exact_dedup.exact_dedup(frame(spark, twice)).collect()
    assert len(same) == 12 and {r.group_size for r in same if r.doc_id == 2} == {4} and all(r.kept for r in same if r.doc_id in (1, 3))


# --- the pipeline


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string, toxicity string"
    odd = [(1, None), (2, ""), (None, "alone"), (4, "same words in a row of eight or more"), (4, "same words in a row of eight or more"), (5, "é" * 120), (6, "w " * 30_000)]
    for rows in (odd, [(1, None)], []):
        table = spark.createDataFrame([(i, t, "en", "x", 0, "y", "z") for i, t in rows], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == corpus_pipeline.COLUMNS, name
            n = out.count()
            assert n == len(rows), name  # none is toxic, and rows that repeat a kept id stay with it
        pieces = corpus_pipeline.pack(spark, table, SF)
        assert pieces.filter("length < 1 OR offset < 0").count() == 0 and (pieces.count() > 0) == bool(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == corpus_pipeline.COLUMNS and len(left) > 0.8 * len(texts)
    assert sum(labels.get(i) == 0 and i not in left for i in texts) <= 2
    want = lines_brute(list(texts.items()))
    lined = corpus_pipeline.drop_lines(spark, docs, SF)
    assert {r.doc_id: r.text for r in lined.collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, [])) for i, t in texts.items()}
    near = near_brute(list(texts.items()))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {i for i, x in near.items() if x[2]}
    cut = corpus_pipeline.drop_repeated_bytes(spark, docs, SF)
    brute = bytes_brute(list(texts.items()))
    assert cut.columns == corpus_pipeline.COLUMNS and sum(r.n_chars for r in cut.collect()) <= sum(v[0] - v[1] for v in brute.values())
    with lineage.noted() as paths:
        assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(paths) > 20 and [p for p in paths if os.path.exists(p)] == paths[-1:]  # what the last stage reads


def test_pipeline_keeps_rows_without_id(spark):
    import corpus_pipeline

    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (None, "one two three four five six seven"), (None, "x " * 80 + "end"), (None, None), (3, "other words that stand alone here")]
    table = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table, SF).collect())
    assert got == Counter(r for r in rows if r[0] != 2)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_lines, corpus_pipeline.drop_repeated_bytes):
        assert stage(spark, table, SF).filter("doc_id IS NULL").count() == 3
