"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into segments of two bits, and each segment is replaced by the number
of its bits that are set.  Two fingerprints that differ in d bits have counts that differ by
d or less in sum (Manhattan distance), so the counts bound the Hamming distance from below.
At a distance of 3 or less, one half of the counts differs by 1 or less.  Each half is a cell
of a grid; a fingerprint looks into its own cell and those at Manhattan distance 1, together with a group
of counts of the other half that cannot differ as well, so that chance meetings stay rare.
What is found is verified bit by bit.  No link is lost, and no cell is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import stored, with_few, with_own_ids
from reportweave.llm.components import linked_through_keys
from reportweave.llm.shingle_sets import (
    TEXTS_AT_A_TIME, lists, lower_ascii, may_be_similar, prefixes_of_crowd, set_sketch, shingle_set, similar_pairs, sketches_near, slices,
)

RADIUS = 3
SEED = 42
_EVERY_SECOND = 0x55555555


def shingles(text: str, n: int) -> list[bytes]:
    """Runs of n words joined by a space, repeats included; a shorter text is one, an empty one none."""
    words = lower_ascii(text).split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(n)), strict=False)]


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in more than half of the hashes."""
    n = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[start : start + (1 << 16)], dtype="<u8").view(np.uint8)
        n += np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n > len(hashes), bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fp)``: fingerprints of whole texts as signed 64-bit numbers; without words it is zero."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def of(text: str | None) -> int:
            runs = shingles(text or "", words)
            return majority(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs)))

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_A_TIME):
                some = batch.slice(start, TEXTS_AT_A_TIME)
                fps = np.array([of(text) for text in some.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of_task, f"doc_id {kind}, fp long")


def _counts(half: Column) -> Column:
    """The counts of a half of a fingerprint, 16 of two bits each."""
    return half.bitwiseAND(F.lit(_EVERY_SECOND)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(_EVERY_SECOND))


def _neighbours(cell: Column) -> Column:
    """Cells at Manhattan distance 1: one count of 0, 1 or 2 is one less or one more."""
    steps = []
    for place in range(0, 32, 2):
        count = F.shiftrightunsigned(cell, place).bitwiseAND(F.lit(3))
        steps.append(F.when(count < 2, cell + F.lit(1 << place)))
        steps.append(F.when(count > 0, cell - F.lit(1 << place)))
    return F.array_compact(F.array(*steps))


def _groups(counts: Column, cuts: list[int], kind: int) -> Column:
    """Keys without their cell: consecutive counts of a half, with the number of the group and the kind."""
    return F.array(*[
        F.shiftleft(F.shiftrightunsigned(counts, 2 * low).bitwiseAND(F.lit((1 << 2 * (high - low)) - 1)), 35) + F.lit((group << 1 | kind) << 32)
        for group, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))
    ])


def grid_keys(fp: Column) -> Column:
    """Keys of a fingerprint: two fingerprints within RADIUS bits share one.

    Their counts differ by 3 or less in sum.  If one half does not differ, the other has one of four
    groups of counts that does not; the key is the cell of the first and that group.  Else one half differs by 1
    and the other by 2 or less, so that one of three groups does not differ.  Cells at distance 1 have sums that
    differ by 1, so those of even sum look into their neighbours, and the others stay where they are.
    """
    low, high = _counts(fp.bitwiseAND(F.lit(0xFFFFFFFF))), _counts(F.shiftrightunsigned(fp, 32))
    return F.concat(*_half_keys(low, high, 0), *_half_keys(high, low, 1))


def _half_keys(cell: Column, other: Column, side: int) -> list[Column]:
    # Bit 62 tells the halves apart.
    mark = F.lit(side << 62)
    ones, twos = cell.bitwiseAND(F.lit(_EVERY_SECOND)), cell.bitwiseAND(F.lit(2 * _EVERY_SECOND))
    even = (F.bit_count(ones) + 2 * F.bit_count(twos)) % 2 == 0
    looks = F.when(even, _neighbours(cell)).otherwise(F.array(cell))
    unlike = _groups(other, [0, 5, 10, 16], 1)

    def at(look: Column) -> Column:
        return F.transform(unlike, lambda group: mark + look + group)

    same = F.transform(_groups(other, [0, 4, 8, 12, 16], 0), lambda group: mark + cell + group)
    return [same, F.flatten(F.transform(looks, at))]


def fingerprint_components(fingerprints: DataFrame) -> DataFrame:
    """``(node, root)`` of the fingerprints (column ``fp``) that have others within RADIUS bits."""
    looks = fingerprints.select(F.explode(grid_keys(F.col("fp"))).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("mark"))
    # The bits decide by themselves, so nothing is left to verify.
    return linked_through_keys(looks, RADIUS, lambda pairs: pairs)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: documents linked through near fingerprints.

    Texts without a word, null ones included, have fingerprint zero, which links like any
    other.  Documents of the same fingerprint are one node, so copies make no pairs.
    component_id is the smallest doc_id reachable; null ids come last and stay null where no
    document of the component has one.  Repeated rows are returned each; further columns
    are not read.
    """
    marked = stored(simhashes(docs, words))
    each = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = fingerprint_components(each)
    # Fingerprints without links are their own roots.
    rooted = each.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted)
    least = rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("of_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """One document of each component of :func:`near_duplicates`, that of the smallest doc_id, with all its columns.

    Rows without an id are documents of their own, after those with one; rows that repeat an id are one document.
    """

    def first_of_components(named: DataFrame) -> DataFrame:
        linked = near_duplicates(named, words)
        gone = stored(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct())
        return with_few(named, gone, named["doc_id"] == gone["_gone_id"], "left_anti")

    return with_own_ids(docs, first_of_components)


# Near-duplicate texts: word shingles, and the Jaccard similarity of their sets that links two texts.
SHINGLE, SIMILARITY = 5, 0.8
# Texts whose shingles are counted, the fewest of them that make a shingle common, and how many common ones
# are kept.  The counts only order shingles: any order of all shingles gives the same links.
SAMPLED, COMMON_FROM, MOST_COMMON = 20_000, 3, 200_000


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], share: int) -> np.ndarray:
    """The first shingles of a set, rare ones first, one of which a set of at least that similarity has among its own.

    Similar sets have ``share`` hundredths of the larger one in common, so no more than the rest can come before
    the first shared one.  ``common`` has the common hashes in ascending order and their counts.
    """
    known, counts = common
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    kept = len(hashes) - (share * len(hashes) + 99) // 100 + 1
    return hashes[np.lexsort((hashes, rank))][:kept] if len(hashes) else hashes


def _common_shingles(texts: DataFrame, n_texts: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several of the sampled texts have, and in how many of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingle_set(text, words) for text in rows["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    # The ids decide, so that a task that is run again takes the same texts.
    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_texts))) < SAMPLED)
    counts = sampled.select("text").mapInArrow(counted, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    most = counts.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toPandas()
    hashes = most["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], most["n"].to_numpy(np.int64)[order]


def _prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, share: int) -> DataFrame:
    """``(doc_id, digest, n, keys, sketch)``: digest, size and sketch of the set of shingles, and its prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows in slices(batches, TEXTS_AT_A_TIME):
            sets = [shingle_set(text, words) for text in rows["text"]]
            # Texts without a word are alike only if they are equal.
            digests = [xxhash.xxh3_128_digest(found.tobytes() or (text or "").encode()) for found, text in zip(sets, rows["text"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(digests, pa.binary()), pa.array([len(found) for found in sets], pa.int64()),
                 lists([prefix(found, shared.value, share) for found in sets]), lists([set_sketch(found) for found in sets])],
                ["doc_id", "digest", "n", "keys", "sketch"])

    columns = "doc_id long, digest binary, n long, keys array<long>, sketch array<long>"
    return texts.select("doc_id", "text").mapInArrow(of_task, columns)


def text_groups(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, group_id)``: documents of equal texts, or linked by a shingle similarity from ``similarity`` on.

    The similarity is the Jaccard similarity of the sets of word shingles, in whole hundredths, and no link is lost: two
    similar sets share a shingle of their prefixes, and what shares one is verified on the full sets.
    group_id is the smallest doc_id of the group.  Equal sets are one node, so copies make
    no pairs; null texts are empty ones, and texts without a word are linked if they are equal.  Rows without an id are left
    out; rows that repeat an id are one document.
    """
    share = round(100 * similarity)
    known = docs.where("doc_id is not null").select("doc_id", "text")
    marked = stored(_prefixes(known, _common_shingles(known, known.count(), words), words, share))
    classes = stored(marked.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sketch").alias("sketch")))
    placed = classes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    members = placed.select("key", "node", (F.shiftleft(F.col("n"), 32) + F.col("at")).alias("mark"))
    similar, crowd = similar_pairs(docs, classes, words, share), prefixes_of_crowd(docs, classes, words, share)
    sketches = classes.select("node", F.array_append("sketch", F.col("n")).alias("sketch"))
    roots = linked_through_keys(members, may_be_similar(share), similar, crowd, sketches=sketches, near=sketches_near(share))
    # The smallest node of a component is its root, so the root names the group.
    named = classes.join(roots, classes["node"] == roots["node"], "left").select(
        F.col("digest").alias("of_digest"), F.coalesce("root", classes["node"]).alias("group_id")
    )
    return marked.join(named, F.col("digest") == F.col("of_digest")).select("doc_id", "group_id")


def without_near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns.

    Rows without an id are documents of their own, after those with one.
    """

    def first_of_groups(named: DataFrame) -> DataFrame:
        groups = text_groups(named, words, similarity)
        gone = stored(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("_gone_id")).distinct())
        return with_few(named, gone, named["doc_id"] == gone["_gone_id"], "left_anti")

    return with_own_ids(docs, first_of_groups)
