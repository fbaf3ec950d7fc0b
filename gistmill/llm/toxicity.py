"""Toxicity by class-conditional Kneser-Ney models of expressions.

An expression is a run without ASCII white space, lower-cased, without punctuation at
its ends.  Each class has a Kneser-Ney model of expressions that backs off from the whole
expression to its first 6, 5 and 4 letters, with the class's continuation counts (how many different
longer forms a shorter one has) below the top.  The classes share what rare expressions are smoothed through: the discounts,
the numbers of forms, those seen in either class and one unseen, among which a shorter form's probability is divided
evenly, and the distribution below the shortest forms.

* Ordinary: absolute discounts, and what they free goes to the shorter forms.
* Toxic: toxic text consists mostly of ordinary expressions, so each toxic count is discounted by what ordinary text of the
  same length would hold, plus ``MARGIN`` standard deviations; what that frees goes to the shorter forms, whose counts are discounted
  alike, and at last to the ordinary model.

Both sum to one.  Where no discounted toxic count is left at any level, their ratio is what the discounts free, a constant; so the
only counts that scoring needs are those at or below nodes with an excess, and of their shorter forms.

A document is compared by its length-normalised log-likelihoods under both models: over
the whole text (with ``PRIOR_LENGTH`` neutral expressions added) and over the window of
``WINDOW`` expressions where the toxic model gains most.  A logistic function of
the two, fitted on labelled rows that trained no counts, is the score.

Counts come from all labelled documents that are neither held out nor kept for the logistic function; only that function
is fitted on ``SAMPLE`` documents of each class at most, chosen by a hash of doc_id.  A model of at most ``NODES`` nodes goes
to the workers as sorted arrays of node hashes (64 bits) and counts, 32 bytes a node; a larger one stays a table, which the documents'
expressions are joined to.

Defined results: null and empty texts get the score of a text without expressions;
rows whose label is null or neither 0 nor 1 train nothing; doc_ids labelled both ways train nothing;
without training rows of both classes every score is 0; every input row is scored,
repeated ones each; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.lineage import written

FOLDS = 5
SAMPLE = 12_000
NODES = 4_000_000
#: Labels that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
LEVELS = (6, 5, 4)
#: What a node is known by; its own count is that of ordinary text.
COUNTS = ("own", "children", "excess")
MARGIN = 3.0
WINDOW, PRIOR_LENGTH = 32, 20
#: Log-ratios of single expressions are held within these.
LEAST, MOST = -2.0, 6.0
#: Texts whose expressions a task holds as Python objects at a time.
SLICE = 256
_EDGE = string.punctuation + "¿¡«»„“”‘’…–—"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def expression(run: bytes) -> str:
    return run.decode(errors="ignore").lower().strip(_EDGE)


def chain(word: str) -> list[str]:
    """The expression, marked at its end, and its shorter forms."""
    whole = word + "$"
    return [whole, *(whole[:n] for n in LEVELS)]


def _held(ratio: float) -> float:
    return min(MOST, max(LEAST, ratio))


class Model:
    """What scoring needs: counts at or below nodes with a toxic excess and of their shorter forms, and a few numbers for each level.

    ``levels`` holds the numbers, and counts by node where they are few (``named``); ``packed`` the counts as arrays by hashes of nodes; ``nodes`` the
    tables that documents are joined to where counts are too many for either.
    """

    def __init__(self, levels: list[dict], weights: list[float] | None = None, nodes: list[DataFrame] | None = None, packed: list[dict] | None = None):
        self.levels, self.weights, self.nodes, self.packed = levels, weights, nodes, packed
        self.plain = _held(sum(math.log(at["toxic_rest"]) for at in levels))

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-ratios of expressions; ``log_ratio`` for many at once, from ``packed``."""
        out = np.full(len(words), self.plain)
        if not self.packed or not words:
            return out
        chains = list(zip(*map(chain, words), strict=True))
        found = []
        for at, own in zip(self.packed, chains, strict=True):
            h = np.fromiter((xxhash.xxh64_intdigest(node.encode(), seed=42) for node in own), dtype=np.uint64, count=len(own)).view(np.int64)
            place = np.minimum(np.searchsorted(at["hash"], h), max(len(at["hash"]) - 1, 0))
            held = at["hash"][place] == h if len(at["hash"]) else np.zeros(len(h), dtype=bool)
            found.append({name: np.where(held, at[name][place], 0.0) if len(at["hash"]) else np.zeros(len(h)) for name in COUNTS})
        last = len(self.levels) - 1
        ordinary, forms = np.full(len(words), 1 / (self.levels[last]["types"] + 1)), [np.ones(len(words)) for _ in range(last + 2)]
        for k in range(last, -1, -1):
            at = self.levels[k]
            if k < last:
                forms[k] = found[k + 1]["children"] + 1
                ordinary = ordinary / forms[k]
            ordinary = np.maximum(found[k]["own"] - at["discount"], 0) / at["own_total"] + at["own_rest"] * ordinary
        toxic, share = ordinary, np.prod(forms[:last], axis=0)
        for k in range(last, -1, -1):
            at = self.levels[k]
            toxic = found[k]["excess"] / at["toxic_total"] / share + at["toxic_rest"] * toxic
            share = share / (forms[k - 1] if k else 1)
        near = np.any([x["excess"] > 0 for x in found], axis=0)
        out[near] = np.clip(np.log(toxic[near] / ordinary[near]), LEAST, MOST)
        return out

    def named(self, nodes: list[DataFrame]) -> Model:
        """The model with its counts by node, for models of few nodes."""
        for at, x in zip(self.levels, nodes, strict=True):
            found = x.collect()
            for name in COUNTS:
                at[name] = {r.node: r[name] for r in found if r[name]}
        return self

    def probabilities(self, nodes: list[str]) -> tuple[float, float]:
        """Ordinary and toxic probability of an expression, given from whole to shortest form."""
        last = len(self.levels) - 1
        ordinary, forms = 1 / (self.levels[last]["types"] + 1), [1] * (last + 2)
        for k in range(last, -1, -1):
            at = self.levels[k]
            if k < last:
                forms[k] = self.levels[k + 1]["children"].get(nodes[k + 1], 0) + 1
                ordinary /= forms[k]
            ordinary = max(at["own"].get(nodes[k], 0) - at["discount"], 0) / at["own_total"] + at["own_rest"] * ordinary
        toxic, share = ordinary, math.prod(forms[:last])
        for k in range(last, -1, -1):
            at = self.levels[k]
            toxic = at["excess"].get(nodes[k], 0) / at["toxic_total"] / share + at["toxic_rest"] * toxic
            share /= forms[k - 1] if k else 1
        return ordinary, toxic

    def log_ratio(self, word: str) -> float:
        """Log of the toxic over the ordinary probability of an expression."""
        nodes = chain(word)
        if not any(node in at["excess"] for at, node in zip(self.levels, nodes, strict=False)):
            return self.plain
        ordinary, toxic = self.probabilities(nodes)
        return _held(math.log(toxic / ordinary))

    def features(self, texts: list[str | None], memory: _Memory) -> np.ndarray:
        """The features of texts, a row for each."""
        runs = [(text or "").encode().split() for text in texts]
        memory.learn({x for own in runs for x in own})
        return np.array([self.summed(np.fromiter(map(memory.__getitem__, own), dtype=float, count=len(own))) for own in runs]).reshape(-1, 2)

    def summed(self, x: np.ndarray) -> tuple[float, float]:
        """The features of a text with these log-ratios."""
        if not len(x):
            return 0.0, 0.0
        sums = np.concatenate(([0.0], np.cumsum(x)))
        w = min(WINDOW, len(x))
        return (sums[w:] - sums[:-w]).max() / WINDOW, sums[-1] / (len(x) + PRIOR_LENGTH)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * features[:, 0] + b * features[:, 1] + c, -40, 40)))


class _Memory(dict):
    """Log-ratios of the runs that this worker has met of late."""

    def __init__(self, model: Model):
        self.model = model

    def learn(self, runs: set[bytes]) -> None:
        if len(self) > 500_000:
            self.clear()
        new = [x for x in runs if x not in self]
        words = [expression(x) for x in new]
        ratios = self.model.ratios(words)
        ratios[[not word for word in words]] = 0.0
        self.update(zip(new, ratios.tolist(), strict=True))


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, size) for i in range(0, batch.num_rows, size))


def _features(docs: DataFrame, model: Model, extra: str) -> DataFrame:
    """doc_id, the two features, and the column named ``extra``."""
    if model.nodes:
        return _joined_features(docs.select("doc_id", "text", extra), model, "text").select("doc_id", "best", "whole", extra)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memory = _Memory(shared.value)
        for batch in _slices(batches):
            found = shared.value.features(batch.column(1).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1]), batch.column(2)], names=["doc_id", "best", "whole", extra])

    return docs.select("doc_id", "text", extra).mapInArrow(run, f"doc_id long, best double, whole double, {extra} int")


def _joined_features(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The rows of ``docs`` with best and whole, where the model's nodes are tables: by joins with the documents' expressions."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    slim = Model(model.levels, model.weights)

    def expressions(batches):
        for batch in _slices(batches):
            out: list[list] = [[], [], []]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places: dict[str, list[int]] = {}
                for k, x in enumerate((text or "").encode().split()):
                    places.setdefault(expression(x), []).append(k)
                for column, x in zip(out, ([row] * len(places), places.keys(), places.values()), strict=True):
                    column.extend(x)
            types = [pa.int64(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["__row", "word", "places"])

    found = written(rows.select("__row", text_col).mapInArrow(expressions, "__row long, word string, places array<int>"))
    words = found.select("word").distinct()
    for k, nodes in enumerate(model.nodes):
        whole = F.concat("word", F.lit("$"))
        key = F.substring(whole, 1, LEVELS[k - 1]) if k else whole
        words = words.withColumn("node", key).join(nodes.select("node", F.struct(*COUNTS).alias(f"at{k}")), "node", "left").drop("node")

    def ratios(batches):
        for batch in batches:
            out = []
            for word, *at in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                own = [
                    numbers | {name: {node: x[name]} if x and x[name] else {} for name in COUNTS}
                    for numbers, node, x in zip(slim.levels, chain(word), at, strict=True)
                ]
                out.append(Model(own).log_ratio(word) if word else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["word", "ratio"])

    ratio = words.mapInArrow(ratios, "word string, ratio double")
    scored = found.join(ratio, "word").groupBy("__row").agg(F.collect_list(F.struct("places", "ratio")).alias("parts"))

    def features(batches):
        for batch in _slices(batches):
            out = []
            for parts in batch.column(1).to_pylist():
                x = np.zeros(sum(len(part["places"]) for part in parts))
                for part in parts:
                    x[part["places"]] = part["ratio"]
                out.append(slim.summed(x))
            both = np.array(out).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["__row", "best", "whole"])

    known = scored.mapInArrow(features, "__row long, best double, whole double")
    return rows.join(known, "__row", "left").drop("__row").fillna(0.0, ["best", "whole"])


def _counts(docs: DataFrame) -> DataFrame:
    """word, toxic, n: how many documents' worth of each expression a class holds."""

    def run(batches):
        from collections import Counter

        for batch in _slices(batches, 8 * SLICE):
            n: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((word, toxic) for x in (text or "").encode().split() if (word := expression(x)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["word", "toxic", "n"]
            )

    return docs.select("text", "toxic").mapInArrow(run, "word string, toxic int, n long")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
        .drop("most")
    )
    known = written(known.withColumn("part", fold(F.col("doc_id")).cast("int")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counting = known.filter(F.col("part") != FOLDS - 1)
    words = _counts(texts.join(F.broadcast(counting) if known.count() <= BROADCAST_LABELS else counting, "doc_id")).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("ordinary"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    levels = []
    table = words.select(F.concat("word", F.lit("$")).alias("node"), "ordinary", "toxic", F.lit(1).cast("long").alias("children"))
    for k in range(len(LEVELS) + 1):
        if k:
            table = table.groupBy(F.substring("node", 1, LEVELS[k - 1]).alias("node")).agg(
                F.sum((F.col("ordinary") > 0).cast("long")).alias("ordinary"), F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"), F.count("*").alias("children")
            )
        table = written(table)
        levels.append(_level(table))
        if levels[-1] is None:
            return Model([])
    nodes = []
    for k, at in enumerate(levels):
        table = at["table"].join(at["over"], "node", "left")
        near = F.col("excess").isNotNull()
        for j in range(k + 1, len(levels)):  # below a node with an excess
            above = levels[j]["over"].select(F.col("node").alias(f"above{j}"))
            table = table.join(above, F.substring("node", 1, LEVELS[j - 1]) == F.col(f"above{j}"), "left")
            near = near | F.col(f"above{j}").isNotNull()
        if k:  # or the shorter form of a node that is kept
            shorter = nodes[-1].select(F.substring("node", 1, LEVELS[k - 1]).alias("short")).distinct()
            table = table.join(shorter, F.col("node") == F.col("short"), "left")
            near = near | F.col("short").isNotNull()
        nodes.append(written(table.filter(near).select("node", F.col("ordinary").alias("own"), "children", "excess")))
    for at in levels:
        del at["table"], at["over"]
    if sum(x.count() for x in nodes) > NODES:
        model = Model(levels, nodes=nodes)
    else:
        model = Model(levels, packed=[_packed(x) for x in nodes])
    fitting = known.filter(F.col("part") == FOLDS - 1).orderBy(F.xxhash64("doc_id"), "doc_id")
    both = fitting.filter("toxic = 1").limit(SAMPLE).unionAll(fitting.filter("toxic = 0").limit(SAMPLE))
    held = _features(texts.join(F.broadcast(both), "doc_id"), model, "toxic").collect()  # rows of 2 * SAMPLE documents at most
    y = np.array([r.toxic for r in held])
    model.weights = _logistic(np.array([[r.best, r.whole] for r in held]), y) if 0 < y.sum() < len(y) else [25.0, 25.0, -6.0]
    return model


def _packed(nodes: DataFrame) -> dict:
    """Hashes of nodes in order, and their counts."""
    rows = nodes.select(F.xxhash64("node").alias("hash"), *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in COUNTS]).toArrow()
    columns = {name: rows.column(name).to_numpy() for name in rows.column_names}
    order = np.argsort(columns["hash"])
    return {name: x[order] for name, x in columns.items()}


def _level(table: DataFrame) -> dict | None:
    """Totals, the discount of both classes' counts, what discounts free in each class, and the nodes with a toxic excess, of a level."""
    x = table.agg(
        F.sum("ordinary").alias("o"),
        F.sum("toxic").alias("t"),
        F.count_if(F.col("ordinary") + F.col("toxic") == 1).alias("once"),
        F.count_if(F.col("ordinary") + F.col("toxic") == 2).alias("twice"),
        F.count("*").alias("nodes"),
        F.count_if(F.col("ordinary") > 0).alias("types"),
    ).first()
    if not x.o or not x.t:
        return None
    discount = max(x.once, 1) / (max(x.once, 1) + 2 * x.twice) if x.twice else 0.75
    expected = F.col("ordinary") * (x.t / x.o)
    over = table.select("node", (F.col("toxic") - discount - expected - MARGIN * F.sqrt(expected + 0.3)).alias("excess")).filter("excess > 0")
    over = written(over)
    left = over.agg(F.sum("excess")).first()[0] or 0.0
    return {
        "table": table,
        "over": over,
        "types": x.nodes,
        "own_total": float(x.o),
        "toxic_total": float(x.t),
        "discount": discount,
        "own_rest": discount * x.types / x.o,
        "toxic_rest": 1 - left / x.t,
    }


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a ridge logistic regression, by Newton steps."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        w = w - np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + 0.01 * np.eye(len(w)), a.T @ (p - y) + 0.01 * w)
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with ``toxicity`` (0 to 1) added in place of any column of that name."""
    rows = docs.drop("toxicity")
    if model.nodes:
        return _scored(rows, model, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text_col)
    out = T.StructType([*rows.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches):
        memory = _Memory(shared.value)
        for batch in _slices(batches):
            found = shared.value.features(batch.column(at).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(found))], names=[*batch.schema.names, "toxicity"])

    return rows.mapInArrow(run, out)


def _scored(rows: DataFrame, model: Model, text_col: str) -> DataFrame:
    found = _joined_features(rows, model, text_col)
    if not model.weights:
        return found.withColumn("toxicity", F.lit(0.0)).select(*rows.columns, "toxicity")
    a, b, c = model.weights
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("best") * a + F.col("whole") * b + c))
    return found.withColumn("toxicity", 1 / (1 + F.exp(-x))).select(*rows.columns, "toxicity")
