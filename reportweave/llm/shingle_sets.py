"""Sets of word shingles as sorted 64-bit hashes, and the exact similarity of pairs of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import stored, with_few

SEED = 42
# Texts that a task holds as Python objects, and sets it holds before it hands them on.
TEXTS_AT_A_TIME = 64
# Buckets by which shingles of a crowd are counted.
BUCKETS = 1 << 18
# Bits that tell apart sets that share many shingles.
SKETCH_BITS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z in lower case; bytes.split() then takes the words ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def mixed_with(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence and one more word."""
    state = (state ^ (state >> np.uint64(29))) * _ODD
    return (state ^ (state >> np.uint64(32))) + word


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words, in ascending order; a shorter text is one run, an empty one none."""
    import xxhash

    words = lower_ascii(text or "").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = min(n, len(words))
    runs = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        runs = mixed_with(runs, each[i : len(words) - n + 1 + i])
    return np.unique(mixed_with(runs, np.uint64(0)))


def set_sketch(found: np.ndarray) -> np.ndarray:
    """For each of SKETCH_BITS groups of hashes whether the set has an odd number of them, as 64-bit numbers."""
    odd = np.bincount((found % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)


def differing_bits(a: Column, b: Column, bits: int) -> Column:
    """Bits that differ between two sketches, arrays of 64-bit numbers."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, bits // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def sketches_near(share: int) -> Callable[[Column, Column], Column]:
    """From sketches (a sketch, then the size of its set); false only for sets that are not similar.

    A shingle that only one of two sets has changes one bit, so no more bits differ than such shingles.  Of
    sets with ``share`` hundredths of their union in common, the other hundredths are the shingles of one only.
    """

    def holds(a: Column, b: Column) -> Column:
        sizes = a[SKETCH_BITS // 64] + b[SKETCH_BITS // 64]
        return F.lit(100 + share) * differing_bits(a, b, SKETCH_BITS) <= F.lit(100 - share) * sizes

    return holds


def slices(batches: Iterator[pa.RecordBatch], size: int = TEXTS_AT_A_TIME) -> Iterator[dict]:
    """Rows as Python values, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size).to_pydict()


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A column of lists of longs."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sets_by_id(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, digest, shingles)`` of whole texts, a few at a time."""
    import xxhash

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingle_set(text, words) for text in rows["text"]]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(digests, pa.binary()), lists(sets)],
                ["doc_id", "digest", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(of_task, "doc_id long, digest binary, shingles array<long>")


def sets_of_nodes(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(of_node, shingles)`` of the nodes in the column ``wanted``, made anew from their texts.

    ``classes`` has ``node``, ``digest`` and ``first_id``, the id of a row of ``docs`` with that set.
    """
    wanted = stored(nodes.join(classes, F.col("wanted") == F.col("node")).select(
        F.col("node").alias("of_node"), F.col("digest").alias("of_digest"), F.col("first_id").alias("of_id")))
    ids = stored(wanted.select(F.col("of_id").alias("text_id")).distinct())
    texts = with_few(docs.select("doc_id", "text"), ids, F.col("doc_id") == F.col("text_id"), "left_semi")
    # An id that is given twice may have two texts, so the digest is compared as well.
    made = sets_by_id(texts, words).join(wanted, (F.col("doc_id") == F.col("of_id")) & (F.col("digest") == F.col("of_digest")))
    return stored(made.select("of_node", "of_digest", "shingles").dropDuplicates(["of_node", "of_digest"]).drop("of_digest"))


def similar_pairs(docs: DataFrame, classes: DataFrame, words: int, share: int) -> Callable[[DataFrame], DataFrame]:
    """A function that takes candidates ``(a, b)`` and returns those whose sets have ``share`` hundredths of their union in common.

    Sets are made anew for the texts of candidates only, and compared as hashes.
    """

    def verify(candidates: DataFrame) -> DataFrame:
        pairs = stored(candidates)
        sets = sets_of_nodes(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), words)
        left, right = sets.toDF("left_node", "left_set"), sets.toDF("right_node", "right_set")
        both = pairs.join(left, F.col("a") == F.col("left_node")).join(right, F.col("b") == F.col("right_node"))
        shared = F.size(F.array_intersect("left_set", "right_set"))
        union = F.size("left_set") + F.size("right_set") - shared
        return both.where(F.lit(100) * shared >= F.lit(share) * union).select("a", "b")

    return verify


def may_be_similar(share: int) -> Callable[[Column, Column], Column]:
    """From marks (size of a set, place of a shared shingle); true for the first one that two similar sets share."""

    def holds(a: Column, b: Column) -> Column:
        size_a, size_b = F.shiftrightunsigned(a, 32), F.shiftrightunsigned(b, 32)
        left = F.least(size_a - a.bitwiseAND(F.lit(0xFFFFFFFF)), size_b - b.bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.lit(100 + share) * left >= F.lit(share) * (size_a + size_b)

    return holds


def prefix_of(shingles: np.ndarray, counts: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, rare ones first, that hold one of each similar set, and their places; none that nobody shares.

    ``counts`` are by buckets of shingles.  They only order shingles, and any order that holds for all sets will do.
    """
    n = counts[shingles & np.int64(len(counts) - 1)]
    order = np.lexsort((shingles, n))[: len(shingles) - (share * len(shingles) + 99) // 100 + 1]
    at = np.flatnonzero(n[order] > 1)
    return shingles[order[at]], at


def prefixes_of_crowd(docs: DataFrame, classes: DataFrame, words: int, share: int):
    """For nodes that share keys with many others: members by the shingles of their prefixes, rare ones first.

    Shingles are counted among these nodes, by buckets of a table of fixed size, so those that only one node has come first and meet
    nobody.  Two similar sets share a shingle of both prefixes, so no link is lost.
    """

    def crowd(nodes: DataFrame) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
        sets = sets_of_nodes(docs, classes, nodes.select(F.col("node").alias("wanted")).distinct(), words)
        bucket = F.col("shingle").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
        found = sets.select(F.explode("shingles").alias("shingle")).groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).toPandas()
        table = np.zeros(BUCKETS, dtype=np.int64)
        table[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        counts = sets.sparkSession.sparkContext.broadcast(table)

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, TEXTS_AT_A_TIME):
                    some = batch.slice(start, TEXTS_AT_A_TIME)
                    each = [s.values.to_numpy(zero_copy_only=False) for s in some.column("shingles")]
                    first = [prefix_of(s, counts.value, share) for s in each]
                    marks = [(len(s) << 32) + at for s, (_, at) in zip(each, first, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("of_node"), lists([keys.view(np.uint64) for keys, _ in first]), lists([m.astype(np.uint64) for m in marks])],
                        ["node", "keys", "marks"])

        kind = sets.schema["of_node"].dataType.simpleString()
        placed = sets.select("of_node", "shingles").mapInArrow(of_task, f"node {kind}, keys array<long>, marks array<long>")
        members = placed.select("node", F.explode(F.arrays_zip("keys", "marks")).alias("m")).select(
            F.col("m.keys").alias("key"), "node", F.col("m.marks").alias("mark"))
        return members, may_be_similar(share)

    return crowd
