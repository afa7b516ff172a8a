"""Near-duplicates by min-max hashing of shingle sets.

Every permutation of the hashes gives two values of a set, its smallest and its largest, so 128
values cost 64 permutations.  Each of the two agrees between two sets with the probability of their
Jaccard similarity.  Bands of ROWS values are keys: bands of minima and bands of maxima, none
with both values of one permutation.  What meets in a key is verified on the full sets.  Where
many sets that are not linked share keys, their candidates come from exact prefixes instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import FIRST_OWN_ID, stored, with_own_ids
from reportweave.llm.components import linked_through_keys
from reportweave.llm.shingle_sets import (
    lists, mixed_with, prefixes_of_crowd, set_sketch, shingle_set, similar_pairs, sketches_near, slices,
)

SHINGLE, SHARE = 3, 85
# 32 bands of four values: a pair at similarity 0.85 shares no band with probability 5e-11.
PERMUTATIONS, ROWS = 64, 4
# Hashes that are permuted at a time: a block of 1 MB.
_BLOCK = 2048


def permutations(n: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets; a hash times its factor plus its offset modulo 2^64 is a new order."""
    numbers = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
    return numbers[0] | np.uint64(1), numbers[1]


def min_max(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a set that is not empty under every permutation."""
    low, high = np.full(len(factors), ~np.uint64(0)), np.zeros(len(factors), dtype=np.uint64)
    for start in range(0, len(hashes), _BLOCK):
        values = hashes[start : start + _BLOCK, None] * factors + offsets
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band; the number of the band is part of it."""
    values = np.concatenate([low, high]).reshape(-1, rows)
    keys = np.arange(len(values), dtype=np.uint64)
    for i in range(rows):
        keys = mixed_with(keys, values[:, i])
    return mixed_with(keys, np.uint64(0))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, keys, sketch)``: size, digest and sketch of the set, and its band keys, none for an empty set."""
    import xxhash

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = permutations(PERMUTATIONS)
        nothing = np.empty(0, dtype=np.uint64)
        for rows in slices(batches, 1024):
            sizes, digests, keys, sketches = [], [], [], []
            for text in rows["text"]:
                found = shingle_set(text, words)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(set_sketch(found))
                keys.append(band_keys(*min_max(found, factors, offsets)) if len(found) else nothing)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(keys), lists(sketches)],
                ["doc_id", "n_shingles", "digest", "keys", "sketch"])

    columns = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>"
    return docs.select("doc_id", "text").mapInArrow(of_task, columns)


def shingle_components(docs: DataFrame, words: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    Rows are linked if their sets of word shingles have ``share`` hundredths of their union in common.
    component_id is the smallest id reachable, and the document of that id is kept.  Texts
    without a word, null ones included, have empty sets and are linked with nothing.  Equal sets
    are one node, so copies make no pairs.  Rows that repeat an id are returned each and judged by their
    own texts.  Rows without an id are linked like others; where no row of a component has an id,
    component_id is null and kept is true.  Ids are whole numbers below 2^62.  Further columns
    are not read.
    """
    return with_own_ids(docs.select("doc_id", "text"), lambda named: _components(named, words, share))


def _components(docs: DataFrame, words: int, share: int) -> DataFrame:
    marked = stored(signatures(docs, words))
    # Ids that rows were given because they had none do not name a component.
    real_id = F.when(F.col("doc_id") < FIRST_OWN_ID, F.col("doc_id"))
    filled = marked.where("n_shingles > 0")
    classes = stored(filled.groupBy("digest").agg(
        F.first("digest").alias("node"), F.min("doc_id").alias("first_id"), F.min(real_id).alias("real_id"), F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))

    def sizes_allow(a: Column, b: Column) -> Column:
        """No intersection is larger than the smaller set, no union smaller than the larger one."""
        return F.lit(100) * F.least(a, b) >= F.lit(share) * F.greatest(a, b)

    members = classes.select(F.explode("keys").alias("key"), "node", F.col("n").alias("mark"))
    similar, crowd = similar_pairs(docs, classes, words, share), prefixes_of_crowd(docs, classes, words, share)
    sketches = classes.select("node", F.array_append("sketch", F.col("n")).alias("sketch"))
    roots = linked_through_keys(members, sizes_allow, similar, crowd, sketches=sketches, near=sketches_near(share))
    rooted = stored(classes.join(roots, classes["node"] == roots["node"], "left").select(
        "digest", "real_id", F.coalesce("root", "digest").alias("root")))
    least = rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("real_id").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("of_root")).select(F.col("digest").alias("of_digest"), "component_id")
    linked = filled.join(named, F.col("digest") == F.col("of_digest")).select("doc_id", "n_shingles", "component_id")
    alone = marked.where("n_shingles = 0").select("doc_id", "n_shingles", real_id.alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    result = linked.union(alone).select("*", kept)
    return result.withColumn("_unnamed", F.col("doc_id") >= FIRST_OWN_ID) if "_unnamed" in docs.columns else result
