"""Benchmark decontamination by spaced seeds.

A seed is a run of tokens of which a fixed mask ignores some, so that a passage with
substituted tokens still shares seeds with its benchmark item.  Seeds of benchmark items
and of documents are joined by hash; around each hit, the overlap is verified token by
token and may have substitutions.

No passage is lost: wherever the tokens that differ lie in 13 to 25 tokens, up to a fifth of
them, one of the masks fits between them, and a longer passage has a part of 13 to 25 tokens
that differs no more than the whole.  An item of fewer tokens is cut into one piece more
than it may have substitutions, so one piece is untouched; the pieces are its seeds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import stored, whole_text, with_few, with_own_ids

# Fixed masks: 1 tokens count, 0 tokens are ignored.
MASKS = ("1111011", "1110100011", "10011111", "1000101111")
# An overlap counts from this many tokens, or from the whole item if that is shorter,
MIN_OVERLAP = 13
# with this share of equal tokens.
MIN_SHARE = 0.8
# Bits of the filter that documents test their seeds against: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24
WORDS_KEPT = 100_000
LONGEST_KEPT = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Seeds:
    """Hashed tokens and seeds of texts."""

    def __init__(self, masks: tuple[str, ...] = MASKS):
        self.masks = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
        self.spans = [len(m) for m in masks]
        self.cache: dict[str, int] = {}

    def token(self, word: str) -> int:
        import xxhash

        found = self.cache.get(word)
        if found is None:
            found = xxhash.xxh64_intdigest(word.encode(), 6)
            if len(word) <= LONGEST_KEPT:
                if len(self.cache) >= WORDS_KEPT:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def tokens(self, text: str) -> np.ndarray:
        """Hashes of the words (letters and digits, lower case)."""
        words = re.findall(r"[^\W_]+", text.lower())
        return np.fromiter(map(self.token, words), np.uint64, len(words))

    def seeds(self, tokens: np.ndarray) -> Iterator[np.ndarray]:
        """For each mask, the seed hash at each place where the mask fits."""
        for k, (places, span) in enumerate(zip(self.masks, self.spans, strict=True)):
            n = len(tokens) - span + 1
            if n <= 0:
                continue
            seed = np.full(n, k + 1, dtype=np.uint64)
            for place in places:
                seed = (seed ^ tokens[place : place + n]) * _ODD
                seed ^= seed >> np.uint64(29)
            yield seed

    def runs(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """Seed of n consecutive tokens from each place, for the pieces of short items."""
        seed = np.full(max(0, len(tokens) - n + 1), 97, dtype=np.uint64)
        for place in range(n):
            seed = (seed ^ tokens[place : place + len(seed)]) * _ODD
        return seed


def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """Places and lengths of the pieces of n tokens: one more than tokens may differ, as equal as can be."""
    parts = n - math.ceil(share * n - 1e-9) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def longest_overlap(equal: np.ndarray, least: int, share: float) -> tuple[int, int]:
    """``(tokens, equal tokens)`` of the longest run of at least ``least`` tokens, ``share`` of them equal; else zeros."""
    if len(equal) < least:
        return 0, 0
    gain = np.concatenate([[0.0], np.cumsum(equal - share)])
    # Greatest gain from each place on falls to the right; the last place that still reaches a start's gain ends its run.
    rest = np.maximum.accumulate(gain[::-1])[::-1]
    last = len(gain) - 1 - np.searchsorted(rest[::-1], gain - 1e-9, side="left")
    at = int((last - np.arange(len(gain))).argmax())
    end = int(last[at])
    return (end - at, int(equal[at:end].sum())) if end - at >= least else (0, 0)


def seed_hits(docs: DataFrame, tests: DataFrame, masks: tuple[str, ...], least: int, share: float) -> DataFrame:
    """``(doc_id, item_id, n_item, shift)``: where a document shares a seed with an item laid at ``shift``.

    Documents test their seeds against a filter of a fixed size, and only those that pass
    are shuffled.
    """
    slots = tests.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("slot")).distinct()
    filled = np.zeros(1 << FILTER_BITS, dtype=bool)
    filled[np.array([r.slot for r in slots.toLocalIterator()], dtype=np.int64)] = True
    # Lengths below that of a passage, so there are few.
    short = tests.select("n_item").where(F.col("n_item") < least).distinct()
    runs = sorted({length for r in short.collect() for _, length in pieces(r.n_item, share)})
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(filled), runs))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, lengths = shared.value
        filled, make = np.unpackbits(packed).view(bool), Seeds(masks)
        shift = np.uint64(64 - FILTER_BITS)
        for batch in batches:
            ids, found, places = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = make.tokens(text)
                for seed in [*make.seeds(tokens), *(make.runs(tokens, n) for n in lengths)]:
                    at = np.flatnonzero(filled[(seed >> shift).astype(np.int64)])
                    if len(at):
                        ids += [doc_id] * len(at)
                        found.append(seed[at].view(np.int64))
                        places.append(at)
            if ids:
                yield pd.DataFrame({"doc_id": ids, "hit": np.concatenate(found), "doc_at": np.concatenate(places)})

    texts = docs.where("doc_id is not null").select("doc_id", whole_text(F.col("text")).alias("text"))
    met = texts.mapInPandas(hits, "doc_id long, hit long, doc_at int").join(tests, F.col("hit") == F.col("seed"))
    return met.select("doc_id", "item_id", "n_item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS,
                 least: int = MIN_OVERLAP, share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, item_id, n_overlap, n_equal)``: documents that hold a passage of a benchmark item.

    The passage is ``least`` consecutive tokens of the item, or the whole item if it is
    shorter, of which ``share`` or more are equal; the longest one counts.  Null texts and
    texts without a word hold nothing, and rows with a null id are left out.  Repeated
    rows give one row.  Further columns are not read.
    """

    @F.pandas_udf("array<long>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Seeds(masks)
        for batch in batches:
            yield pd.Series([make.tokens(v).view(np.int64) for v in batch])

    def seeds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Seeds(masks)
        for batch in batches:
            for item_id, item in zip(batch["item_id"], batch["item"], strict=True):
                item = np.asarray(item, dtype=np.int64).view(np.uint64)
                if len(item) >= least:
                    seeds = [(np.arange(len(seed)), seed) for seed in make.seeds(item)]
                else:
                    seeds = [([at], make.runs(item[at : at + n], n)) for at, n in pieces(len(item), share) if n]
                for places, seed in seeds:
                    yield pd.DataFrame({"seed": seed.view(np.int64), "item_id": item_id,
                                        "item_at": places, "n_item": len(item)})

    named = benchmark.where("item_id is not null").select("item_id", tokens(whole_text(F.col("text"))).alias("item"))
    items = stored(named)
    tests = stored(items.mapInPandas(seeds_of, "seed long, item_id long, item_at int, n_item int"))
    candidates = stored(seed_hits(docs, tests, masks, least, share).withColumnRenamed("doc_id", "of_doc"))

    @F.pandas_udf("array<long>")
    def passage(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        """Tokens of the document beside those of the item."""
        make = Seeds(masks)
        for texts, shifts, lengths in batches:
            yield pd.Series([make.tokens(t)[max(0, s) : s + n].view(np.int64)
                             for t, s, n in zip(texts, shifts, lengths, strict=True)])

    @F.pandas_udf("n_overlap int, n_equal int")
    def verified(item: pd.Series, beside: pd.Series, shift: pd.Series) -> pd.DataFrame:
        found = []
        for one, text, by in zip(item, beside, shift, strict=True):
            first = max(0, -by)
            equal = np.asarray(one)[first : first + len(text)] == np.asarray(text)
            found.append(longest_overlap(equal, min(least, len(one)), share))
        return pd.DataFrame(found, columns=["n_overlap", "n_equal"])

    texts = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    beside = with_few(texts, candidates, texts["doc_id"] == candidates["of_doc"], "inner").select(
        "doc_id", "item_id", "shift", passage("text", "shift", "n_item").alias("beside")
    )
    of_item = items.withColumnRenamed("item_id", "of_item")
    checked = beside.join(of_item, F.col("item_id") == F.col("of_item")).select(
        "doc_id", "item_id", verified("item", "beside", "shift").alias("v")
    )
    best = checked.where("v.n_overlap > 0").groupBy("doc_id", "item_id").agg(F.max("v").alias("v"))
    return best.select("doc_id", "item_id", "v.n_overlap", "v.n_equal")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of a benchmark item, with all their columns, also those without an id."""

    def clean(named: DataFrame) -> DataFrame:
        found = stored(contaminated(named, benchmark).select(F.col("doc_id").alias("_held_id")).distinct())
        return with_few(named, found, named["doc_id"] == found["_held_id"], "left_anti")

    return with_own_ids(docs, clean)
