"""Full-text search: words of a text as stems, without stop words, and how closely together they hold what a query asks for."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import stemming

#: Words are runs of letters and digits.
WORD = r"(?U)([\p{L}\p{N}]+)"
REMEMBERED = 500_000
_STEMS: dict[str, str] = {}


def words(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), 1)


def _stem(word: str) -> str:
    found = _STEMS.get(word)
    if found is None:
        found = stemming.stem(word)
        if len(_STEMS) < REMEMBERED:
            _STEMS[word] = found
    return found


def _stems_of(found: pa.Array) -> pa.Array:
    """Stems of words, each distinct one of which is stemmed once."""
    flat = found.dictionary_encode()
    return pc.take(pa.array([_stem(x) for x in flat.dictionary.to_pylist()], pa.string()), flat.indices)


def _listed(found: pa.Array, items: pa.Array) -> pa.Array:
    """Lists of ``items`` where ``found`` has its own."""
    first = found.offsets[0].as_py() if len(found) else 0
    return pa.ListArray.from_arrays(pc.subtract(found.offsets, first), items, mask=found.is_null() if found.null_count else None)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(found: pa.Array) -> pa.Array:
    """Stems of lists of words."""
    return _listed(found, _stems_of(found.flatten()))


@F.arrow_udf(T.ArrayType(T.StructType().add("pos", T.IntegerType()).add("stem", T.StringType())))
def _placed(found: pa.Array) -> pa.Array:
    """Places and stems of lists of places and words."""
    each = found.flatten()
    return _listed(found, pa.StructArray.from_arrays([each.field("pos"), _stems_of(each.field("word"))], names=["pos", "stem"]))


def stop_words() -> list[str]:
    """Those that Spark ships for the two languages."""
    return sorted({w for language in ("english", "russian") for w in StopWordsRemover.loadDefaultStopWords(language) if w.isalpha()})


def stems(column: Column) -> Column:
    """The stems of a text's words in order, without stop words; null for null."""
    return _stemmed(F.filter(words(column), lambda w: ~w.isin(stop_words())))


def asked(query: str) -> list[list[str]]:
    """What a query asks for: of each of its terms the stems of its words, all of which a match holds; terms of stop words ask for nothing."""
    out: list[list[str]] = []
    stop = set(stop_words())
    for term in list(dict.fromkeys(x.casefold() for x in re.findall(r"[\w./:@#-]+", query)))[:32]:
        found = list(dict.fromkeys(stemming.stem(w) for w in re.findall(r"[^\W_]+", term) if w not in stop))
        if found and found not in out:
            out.append(found)
    return out


#: What a cover counts when nothing stands between its words; fixed value.
COVER = 0.1


def _may_match(word: Column, wanted: list[str]) -> Column:
    """Whether a word's stem may be one of some stems: stemming leaves a word's first letter as it is, but for ё."""
    return F.substring(word, 1, 1).isin(sorted({x for w in wanted for x in (("е", "ё") if w[0] in "её" else w[0])}))


def positions(column: Column, wanted: list[str] | None = None) -> Column:
    """array of (pos, stem): places from 1 of a text's words, stop words counted but left out; of ``wanted`` stems only, where given.

    Only words that may have a wanted stem leave the JVM, with their places, so that a text is split once.
    """
    placed = F.transform(words(column), lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word")))
    keep = F.filter(placed, lambda x: ~x["word"].isin(stop_words()) & (F.lit(True) if wanted is None else _may_match(x["word"], wanted)))
    both = _placed(keep)
    return both if wanted is None else F.filter(both, lambda x: x["stem"].isin(wanted))


def wanted(terms: list[list[str]]) -> list[str]:
    return sorted({stem for term in terms for stem in term})


def cover_density(found: Column, terms: list[list[str]]) -> Column:
    """The rank of a text by its covers: of ``found`` (array of pos, stem, in order), the smallest stretches that hold all words of one of the terms.

    A stretch counts ``COVER`` over one more than the words in it that nobody asked for.  Up to each place, a term's last complete stretch begins
    at the earliest of its words' last places, so one pass that remembers each word's last place finds all of them: a stretch is
    a smallest one when it begins later than any that ended before.  Null for null; 0 where no term is held whole.
    """
    stems = wanted(terms)
    if not stems:
        return F.when(found.isNotNull(), 0.0)
    number = {stem: k for k, stem in enumerate(stems)}
    nowhere = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("pos"))
    items = F.transform(found, lambda x, i: F.struct(i.alias("i"), x["pos"].cast("int").alias("pos"), x["stem"].alias("stem")))
    start = F.struct(F.array(*[nowhere] * len(stems)).alias("last"), nowhere.alias("begin"), F.lit(0.0).alias("rank"))

    def whole(last: Column, term: list[str]) -> Column:
        own = [F.get(last, F.lit(number[w])) for w in term]
        return F.least(*own) if len(own) > 1 else own[0]

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["i"].alias("i"), x["pos"].alias("pos"))
        last = F.transform(s["last"], lambda at, k: F.when(F.get(F.array(*map(F.lit, stems)), k) == x["stem"], here).otherwise(at))
        begun = F.transform(F.array(last), lambda held: F.struct(held.alias("last"), F.greatest(nowhere, *[whole(held, term) for term in terms]).alias("begin")))

        def after(b: Column) -> Column:
            begin = b["begin"]
            noise = x["pos"] - begin["pos"] - (x["i"] - begin["i"])
            more = F.when(begin["i"] > s["begin"]["i"], F.lit(COVER) / (1 + noise)).otherwise(0.0)
            return F.struct(b["last"].alias("last"), begin.alias("begin"), (s["rank"] + more).alias("rank"))

        return F.get(F.transform(begun, after), F.lit(0))

    return F.aggregate(items, start, step, lambda s: s["rank"])


def matches_all(stems: Column, query: str) -> Column:
    """Whether a text holds every word that a query asks for; none asked, none found."""
    wanted = sorted({w for term in asked(query) for w in term})
    return F.size(F.array_except(F.lit(wanted).cast("array<string>"), stems)) == 0 if wanted else F.lit(False)


def holds_all(column: Column, query: str) -> Column:
    """The same of a text itself: of its words only those that may have a wanted stem leave the JVM, each once."""
    own = wanted(asked(query))
    if not own:
        return F.lit(False)
    near = F.filter(words(column), lambda w: _may_match(w, own) & ~w.isin(stop_words()))
    return matches_all(_stemmed(F.array_distinct(near)), query)


#: Words that are put in order at once, and entries of one stored row, at most.
SLICE, ENTRIES = 1 << 22, 1 << 16


def _by_stem(ids: pa.Array, found: pa.Array, stop: frozenset[str]) -> pa.RecordBatch:
    """Of texts' ids and words: each stem with the ids and places where it stands, side by side, in the texts' order."""
    flat = found.flatten().dictionary_encode()
    n = pc.fill_null(pc.list_value_length(found), 0).to_numpy()
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    pos = np.arange(1, len(flat) + 1, dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    stems = pa.array([None if w in stop else _stem(w) for w in flat.dictionary.to_pylist()], pa.string()).dictionary_encode()
    stem = pc.fill_null(stems.indices, -1).to_numpy()[flat.indices.to_numpy()]
    order = np.argsort(stem, kind="stable")
    order = order[np.searchsorted(stem[order], 0) :]
    stem = stem[order]
    first = np.unique(np.concatenate([np.flatnonzero(np.diff(stem, prepend=-1)), np.arange(0, len(stem), ENTRIES)]))
    ends = pa.array(np.append(first, len(stem)), pa.int32())
    columns = [stems.dictionary.take(pa.array(stem[first])), pa.ListArray.from_arrays(ends, ids.take(pa.array(row[order]))), pa.ListArray.from_arrays(ends, pa.array(pos[order]))]
    return pa.RecordBatch.from_arrays(columns, names=["stem", "id", "pos"])


def write_postings(rows: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """Stores ids and places of every word of the rows; each task's file is in order of stems, so that a query reads its own stems' pages of it only.

    A stored row holds one stem of a slice of texts.  No word is shuffled.
    """
    stop = frozenset(stop_words())

    def run(batches):
        for batch in batches:
            ids, found = batch.columns
            number = np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy()) // SLICE
            for at in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if len(at):
                    yield _by_stem(ids.slice(at[0], len(at)), found.slice(at[0], len(at)), stop)

    each = rows.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    kept = T.StructType().add("stem", "string").add("id", T.ArrayType(each.schema["id"].dataType)).add("pos", T.ArrayType(T.IntegerType()))
    each.mapInArrow(run, kept).sortWithinPartitions("stem").write.mode("append").parquet(path)


def read_postings(spark: SparkSession, path: str, stems: list[str]) -> DataFrame:
    """stem, id, pos of some stems."""
    stored = spark.read.parquet(path)
    stored = stored.filter(F.col("stem").isin(stems)) if stems else stored.limit(0)
    return stored.select("stem", F.explode(F.arrays_zip("id", "pos")).alias("x")).select("stem", "x.id", "x.pos")


def ranked(postings: DataFrame, query: str) -> DataFrame:
    """id, rank of the texts that hold what a query asks for, by stem, id and pos of its stems."""
    terms = asked(query)
    of_one = postings.filter(F.col("stem").isin(wanted(terms))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("found"))  # a text's own words
    return of_one.select("id", cover_density(F.col("found"), terms).alias("rank")).filter("rank > 0")


def indexed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``stems``: what a stored search column holds, computed when a text is written."""
    return rows.withColumn("stems", stems(F.col(text_col)))
