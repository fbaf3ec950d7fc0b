"""MinHash near-dedup with a multi-index Hamming join.

A document's set holds its distinct 5-word shingles.  Of documents with equal sets one
represents the others.  A representative's signature has ``POSITIONS`` MinHash values
of ``BITS`` bits.  The join finds all pairs whose signatures differ in at most
``DISTANCE`` positions: the signature is split into ``CHUNKS`` chunks, and by the
pigeonhole principle some chunk of such a pair has at most DISTANCE // CHUNKS = 1
error, so each chunk is indexed once for each place where its error may be.  A pair
with similarity 0.75 differs in 16 of 64 positions on average (deviation 3.5), and all
chunks miss it with a probability under 1e-9.

Of the pairs found, only links that can matter for components are confirmed, on the
full sets.  First every member of an index bucket is held against the bucket's
smallest one, so a bucket with many copies costs as many comparisons as it has members.
Then the members of buckets that still hold several components are paired across
components, where length, prefix and position bounds of exact set joins allow a
similar pair.  Every pair in a bucket is thus confirmed, refused, or within one component already.

Defined results: words are runs without ASCII white space, A-Z lower-cased; texts with
fewer than five words have one shingle, the whole sequence; null texts and texts
without words have an empty set and link with nothing; doc_id names a document, so rows
that repeat one are decided alike, and each of their texts links the document with others; a row
without doc_id links with nothing; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.components import components
from gistmill.lineage import written
from gistmill.llm.shingles import WordHashes, shingle_set

POSITIONS, BITS, CHUNKS = 64, 16, 16
WIDTH = POSITIONS // CHUNKS
#: Signatures that differ in at most so many positions are all found: one error in each chunk, and one chunk with one more.
DISTANCE = 2 * CHUNKS - 1
SIMILAR, OF = 75, 100
#: Texts that a task turns into shingles at a time.
SLICE = 128


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """POSITIONS values of BITS bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * multipliers[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return ((least * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)).astype(np.uint16)


def signatures(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, sig (null for an empty set) of rows of doc_id, text, text_hash."""

    def run(batches):
        memory, multipliers = WordHashes(), _multipliers()
        for batch in batches:
            n, hashes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, memory)
                n.append(len(found))
                hashes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found, multipliers).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_hash", "sig"]
            )

    return texts.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, sig binary")


def index_keys(sets: DataFrame) -> DataFrame:
    """key, node: an entry for each chunk and each place in it that may be wrong."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(n, CHUNKS, WIDTH).astype(np.uint64)
            keys = np.empty((n, CHUNKS, WIDTH), dtype=np.uint64)
            for wrong in range(WIDTH):
                key = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(wrong)
                for place in range(WIDTH):
                    if place != wrong:
                        key = (key << np.uint64(BITS)) | sigs[:, :, place]
                keys[:, :, wrong] = key
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), CHUNKS * WIDTH)
            for i in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)[i : i + (1 << 16)].astype(np.int64)), pa.array(ids[i : i + (1 << 16)])], names=["key", "node"])

    return sets.select("node", "sig").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame) -> DataFrame:
    """Pairs of columns a, b, n_a, n_b, sig_a, sig_b that length and signature distance allow."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= DISTANCE))

    fits = F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * SIMILAR
    return pairs.filter(fits).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _same(pairs: DataFrame) -> DataFrame:
    """Pairs of columns a, b, text_a, text_b whose full sets are similar."""

    def run(batches):
        memory = WordHashes()
        last, known = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                keep = []
                for a, x, y in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if a != last:
                        last, known = a, shingle_set(x, memory)
                    other = shingle_set(y, memory)
                    both = len(np.intersect1d(known, other, assume_unique=True))
                    keep.append(OF * both >= SIMILAR * (len(known) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among distinct pairs a, b of nodes."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = written(_near(pairs.join(side("b"), "b").join(side("a"), "a")))
    place = lambda x: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "text_hash")])
    text = lambda x: texts.select(*[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "text_hash", "text")])
    with_text = lambda rows, x: rows.join(place(x), x).join(text(x), [f"doc_id_{x}", f"text_hash_{x}"]).drop(f"doc_id_{x}", f"text_hash_{x}")
    return written(_same(with_text(with_text(near, "b"), "a")))


def crossing(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a, b across components that may be similar; ``opened`` has node, component, n_shingles, doc_id, text_hash.

    Buckets of texts from one template hold pairs that are all somewhat similar.  They are not
    enumerated: each document's shingles are put in order of rarity among these documents, and only pairs
    that share a shingle early enough in that order to reach the similarity are made.
    """

    def run(batches):
        memory = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                found = [shingle_set(text, memory).view(np.int64) for text in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], names=["node", "shingle"])

    asked = opened.select("node", "doc_id", "text_hash").join(texts, ["doc_id", "text_hash"]).select("node", "text")
    rows = written(asked.mapInArrow(run, "node long, shingle long"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) - 1
    rows = rows.join(often, "shingle").withColumn("pos", place).filter("often > 1")
    rows = rows.join(opened.select("node", "component", F.col("n_shingles").alias("n")), "node")
    n, pos = F.col("n"), F.col("pos")
    # of a pair, the longer shares a shingle within this prefix, the shorter within the next
    longer = written(rows.filter(pos <= n - F.ceil(n * SIMILAR / OF)).drop("often"))
    shorter = longer.filter(pos <= n - F.ceil(n * 2 * SIMILAR / (OF + SIMILAR)))
    x, y = longer.alias("x"), shorter.alias("y")
    at = lambda k: F.col(k)
    order = (at("x.n") > at("y.n")) | ((at("x.n") == at("y.n")) & (at("x.node") > at("y.node")))
    fits = at("y.n") * OF >= at("x.n") * SIMILAR
    reach = F.least(at("x.n") - at("x.pos"), at("y.n") - at("y.pos")) * (OF + SIMILAR) >= (at("x.n") + at("y.n")) * SIMILAR
    apart = at("x.component") != at("y.component")
    pairs = x.join(y, (at("x.shingle") == at("y.shingle")) & order & fits & reach & apart)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def numbered(sets: DataFrame) -> DataFrame:
    """The sets with ``node``: the id of the document that stands for each; of the sets of one document all but the first have numbers beyond all ids.

    So the order of nodes is that of documents, and the hub of a bucket tends to be the text that the others were made from.
    """
    again = sets.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.head(1):
        return sets.withColumn("node", F.col("doc_id"))
    low, high = sets.agg(F.min("doc_id"), F.max("doc_id")).first()
    place, room = F.monotonically_increasing_id(), 1 << 62
    beyond = F.lit(high) + 1 + place if high < room else F.lit(low) - 1 - place
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("set_hash"))
    node = F.when(nth == 1, F.col("doc_id")).otherwise(beyond) if high < room or low > -room else place
    return written(sets.withColumn("node", node))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = written(signatures(texts))
    linkable = rows.filter("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    # a node for each set, which one text stands for
    first = linkable.groupBy("set_hash").agg(F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "sig"), F.struct("doc_id", "text_hash")).alias("rep"))
    sets = numbered(written(first.select("set_hash", "rep.*")))
    if linkable.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        texts = texts.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))  # equal rows, once
    keys = index_keys(sets)
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub < other").select("key", "hub")
    members = written(keys.join(shared, "key"))
    star = members.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    # documents that have several sets link these
    apart = linkable.groupBy("doc_id").agg(F.min("set_hash").alias("least"), F.max("set_hash").alias("most")).filter("least != most").select("doc_id", "least")
    number = lambda x, alias: sets.select(F.col("set_hash").alias(x), F.col("node").alias(alias))
    own = linkable.select("doc_id", "set_hash").distinct().join(apart, "doc_id").filter("set_hash != least")
    own = own.join(number("set_hash", "b"), "set_hash").join(number("least", "a"), "least").select("a", "b")
    links = confirmed(star, sets, texts).unionAll(written(own))
    first_parts = written(components(links))

    # what the stars leave open: pairs across components, in buckets that hold several
    part = members.join(first_parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = part.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    opened = part.join(several, "key", "left_semi").select("node", "component").distinct()
    cross = crossing(written(opened.join(sets.select("node", "n_shingles", "doc_id", "text_hash"), "node")), texts)
    more = confirmed(cross, sets, texts)
    parts = components(first_parts.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    # a component is named by its smallest doc_id
    placed = written(sets.select("set_hash", "node", "doc_id").join(parts, "node", "left").select("set_hash", "doc_id", F.coalesce("component", "node").alias("component")))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = placed.join(names, "component").select("set_hash", "component_id")
    out = rows.drop("sig", "text_hash").join(known, "set_hash", "left")
    # rows without words follow their document's other rows
    blank = rows.filter("set_hash IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    if linkable.join(blank, "doc_id", "left_semi").head(1):
        named = out.filter("component_id IS NOT NULL").join(blank, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("named"))
        out = out.join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "named"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
