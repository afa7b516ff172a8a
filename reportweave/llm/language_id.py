"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent character n-grams in order of rank.  A text
gets the language whose profile is nearest by out-of-place distance: the sum, over the
text's own most frequent n-grams, of how far their ranks differ.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.llm.common import in_held_out, whole_text

PROFILE = 300
LONGEST_GRAM = 3
# Scale of the score: distances differ by a few tenths between languages.
SHARPNESS = 20.0
# Numbers of n-grams that a task keeps for reuse, and counted n-grams that it adds up at once.
GRAMS_KEPT, GRAMS_HELD = 500_000, 2_000_000
# Characters that are counted at once, and texts that are ranked at once unless a single one is longer.
SLICE, SLICE_TEXTS = 1 << 18, 1 << 10
# An n-gram is a number: its code points side by side, the last one lowest.
POINT_BITS = 21
MARK = ord("_")

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def gram_of(code: int) -> str:
    points = [code >> POINT_BITS * i & (1 << POINT_BITS) - 1 for i in reversed(range(LONGEST_GRAM))]
    return "".join(chr(p) for p in points if p)


def code_of(gram: str) -> int:
    return reduce(lambda code, c: code << POINT_BITS | ord(c), gram, 0)


def added_up(parts: list[Counts]) -> Counts:
    """Counts ``(group, code, n)`` of several parts as one, in order of group and code."""
    group, code, n = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((code, group))
    group, code, n = group[order], code[order], n[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]))[: len(code)])
    return group[first], code[first], np.add.reduceat(n, first) if len(first) else n


def counted_piece(piece: str, groups: np.ndarray) -> Counts:
    """Counts of the n-grams around every character but the first and the last, which give context only.

    Words are runs of letters and number signs, and both ends of a word are marked.  So each
    letter gives itself, itself with the one before, and itself with both neighbours; the last
    of a word gives itself with the mark as well.
    """
    points, at = np.unique(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    letter = np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, points.tolist())), bool, len(points))
    # Numbers of the characters of this piece from 2 on, 1 is the mark, 0 is nothing.
    number = np.where(letter, np.cumsum(letter) + 1, 1).astype(np.uint64)
    point = np.append([0, MARK], points[letter]).astype(np.uint64)
    bits = np.uint64(len(point).bit_length())
    here = number[at]
    is_letter = letter[at]
    mid = np.flatnonzero(is_letter[1:-1]) + 1
    y, before, after = here[mid], here[mid - 1], here[mid + 1]
    head = groups[mid - 1].astype(np.uint64) << (np.uint64(LONGEST_GRAM) * bits)
    two = head | (before << bits) | y
    last = np.flatnonzero(after == 1)
    keys = np.concatenate([
        head | y, two, head | (((before << bits) | y) << bits) | after, head[last] | (y[last] << bits) | np.uint64(1)
    ])
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    n = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    code = np.zeros(len(keys), np.uint64)
    for i in reversed(range(LONGEST_GRAM)):
        code = (code << np.uint64(POINT_BITS)) | point[((keys >> (np.uint64(i) * bits)) & mask).astype(np.int64)]
    return keys >> (np.uint64(LONGEST_GRAM) * bits), code, n


def gram_counts(texts: list[str], groups: list[int]) -> Counts:
    """``(group, code, n)`` in order of group: how often each n-gram occurs in the texts of a group.

    Up to 1024 groups.  However long the texts are, a piece of SLICE characters is counted at once.
    """
    lower = [t.lower() for t in texts]
    joined = "\n" + "\n".join(lower) + "\n"
    owner = np.repeat(np.array(groups, np.uint16), [len(t) + 1 for t in lower])
    parts = [
        counted_piece(joined[i : i + SLICE + 2], owner[i : i + SLICE]) for i in range(0, len(joined) - 1, SLICE)
    ]
    return parts[0] if len(parts) == 1 else added_up(parts)


def slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, up to SLICE_TEXTS of SLICE characters at once; a longer text is alone."""
    some, size = [], 0
    for text in texts:
        if some and (size + len(text) >= SLICE or len(some) == SLICE_TEXTS):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text) + 1
    if some:
        yield some


def language_profiles(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """Languages in order of their names, each with its n-grams by rank.

    Learned from all texts with a language outside the held-out rows.  Every task adds up
    its counts; the table has a row per language, n-gram and task, or more if a task meets very many.
    What comes to the driver is PROFILE rows per language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[Counts]] = defaultdict(list)

        def rows() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                _, code, n = added_up(parts)
                yield pd.DataFrame({"lang": lang, "gram": [gram_of(c) for c in code.tolist()], "n": n})
            held.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for some in slices(texts):
                    held[lang].append(gram_counts(some, [0] * len(some)))
                    if sum(len(n) for parts in held.values() for _, _, n in parts) > GRAMS_HELD:
                        held.update({each: [added_up(parts)] for each, parts in held.items()})
                        if sum(len(n) for parts in held.values() for _, _, n in parts) > GRAMS_HELD // 2:
                            yield from rows()
        yield from rows()

    known = docs.where(F.col("lang").isNotNull() & ~in_held_out(F.col("doc_id")))
    counted = known.select("lang", whole_text(F.col("text")).alias("text")).mapInPandas(
        count, "lang string, gram string, n long"
    )
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[str]] = defaultdict(list)
    for row in sorted(top.collect(), key=lambda r: (r.lang, r["rank"])):
        profiles[row.lang].append(row.gram)
    return sorted(profiles.items())


class GramNumbers(dict):
    """Numbers of n-grams by their codes; those of the profiles come first, others have their checksum behind these.

    Numbers made on demand are kept up to a bound.
    """

    def __init__(self, known: list[str]):
        self.known = {code_of(gram): i for i, gram in enumerate(known)}
        super().__init__(self.known)

    def __missing__(self, code: int) -> int:
        if len(self) >= GRAMS_KEPT + len(self.known):
            self.clear()
            self.update(self.known)
        self[code] = number = len(self.known) + zlib.crc32(gram_of(code).encode())
        return number


class Ranker:
    """Out-of-place distances of texts to all profiles, up to SLICE_TEXTS texts at once."""

    def __init__(self, profiles: list[tuple[str, list[str]]]):
        self.langs = [lang for lang, _ in profiles]
        known = sorted({g for _, grams in profiles for g in grams})
        self.numbers = GramNumbers(known)
        # The last row is for n-grams of no profile.
        self.ranks = np.full((len(known) + 1, len(profiles)), -1, dtype=np.int32)
        for k, (_, grams) in enumerate(profiles):
            for rank, gram in enumerate(grams):
                self.ranks[self.numbers[code_of(gram)], k] = rank
        self.checksum = np.array([zlib.crc32(g.encode()) for g in known], dtype=np.uint64)

    def top(self, texts: list[str]) -> Counts:
        """``(text, place, number)``: the most frequent n-grams of each text in order of rank.

        Equal counts go in order of a checksum.  Texts without a letter have none.
        """
        text, code, n = gram_counts(texts, list(range(len(texts))))
        distinct, where = np.unique(code, return_inverse=True)
        # Runs may consist of number signs such as ½ alone.
        alpha = np.zeros(len(distinct), bool)
        single = distinct[distinct < 1 << POINT_BITS].tolist()
        alpha[: len(single)] = [chr(c).isalpha() for c in single]
        lettered = np.bincount(text[alpha[where]].astype(np.int64), minlength=len(texts)) > 0
        kept = lettered[text.astype(np.int64)]
        gram = np.fromiter(map(self.numbers.__getitem__, distinct.tolist()), np.uint64, len(distinct))[where][kept]
        text, n = text[kept], n[kept].astype(np.uint64)
        if not len(text):
            return text, n, gram
        known = gram < len(self.checksum)
        checksum = gram - np.uint64(len(self.checksum))
        checksum[known] = self.checksum[gram[known].astype(np.int64)]
        # Text, count and checksum share 64 bits: 10 + 19 + 32, or 0 + 32 + 32 for a single long text.
        most = n.max()
        order = (((text << np.uint64(int(most).bit_length())) | (most - n)) << np.uint64(32)) | checksum
        order = np.argsort(order, kind="stable")
        text, gram = text[order], gram[order]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        best = place < PROFILE
        return text[best], place[best], gram[best]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The nearest language of each text and its share of ``exp(-SHARPNESS * distance)``."""
        result = [("und", 0.0)] * len(texts)
        text, place, gram = self.top(texts)
        if not len(text) or not self.langs:
            return result
        ranks = self.ranks[np.minimum(gram, len(self.checksum)).astype(np.int64)]
        near = np.where(ranks >= 0, PROFILE - np.abs(ranks - place[:, None].astype(np.int32)), 0)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        whole = np.diff(np.append(first, len(text)))[:, None] * PROFILE
        distance = (whole - np.add.reduceat(near, first, axis=0, dtype=np.int64)) / whole
        shares = np.exp(-SHARPNESS * (distance - distance.min(axis=1, keepdims=True)))
        best = distance.argmin(axis=1)
        scores = shares[np.arange(len(best)), best] / shares.sum(axis=1)
        for t, k, score in zip(text[first].tolist(), best.tolist(), scores.tolist(), strict=True):
            result[t] = self.langs[k], score
        return result


def identify_language(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document.

    ``und`` with score 0 for a null text, a text without a letter, or if there is nothing
    to learn from.  Equal distances go to the language that comes first by name.  A
    null doc_id is not held out.  Repeated rows are predicted each; further columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(language_profiles(docs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(shared.value)
        for batch in batches:
            predicted = [p for some in slices(batch) for p in ranker.predict(some)]
            yield pd.DataFrame(predicted, columns=["lang_pred", "score"])

    predicted = docs.select(
        "doc_id", in_held_out(F.col("doc_id")).alias("held_out"), predict(whole_text(F.col("text"))).alias("p")
    )
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score")
