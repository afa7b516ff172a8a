"""Language identification against a plain count of every n-gram of every text."""

import re
import zlib
from collections import Counter

import numpy as np

from reportweave.llm import language_id


def plain_counts(text):
    grams = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{word}_"
        for n in range(1, 4):
            grams.update(padded[i : i + n] for i in range(len(padded) - n + 1) if n > 1 or padded[i] != "_")
    return grams


def plain_prediction(text, profiles):
    counts = plain_counts(text)
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    top = sorted(counts, key=lambda g: (-counts[g], zlib.crc32(g.encode())))[: language_id.PROFILE]
    far = []
    for _, grams in profiles:
        rank = {g: i for i, g in enumerate(grams)}
        far.append(sum(abs(rank[g] - i) if g in rank else language_id.PROFILE for i, g in enumerate(top)))
    distance = np.array(far) / (len(top) * language_id.PROFILE)
    near = np.exp(-language_id.SHARPNESS * (distance - distance.min()))
    return profiles[int(distance.argmin())][0], near[distance.argmin()] / near.sum()


ODD = ["", None, "½ ² 7", "_a_ b_", "a½ İstanbul ŞIŞLI straße", "日本語のテキスト と 単語、", "é é ǅ \U0001d400", "x" * 700, "one\x1ctwo three"]


def test_counts_of_pieces_are_those_of_the_text(monkeypatch):
    texts = [t or "" for t in ODD] + ["the cat, the dog; " * 40]
    for size in (7, 64, 1 << 18):
        monkeypatch.setattr(language_id, "SLICE", size)
        text, code, n = language_id.gram_counts(texts, list(range(len(texts))))
        found = {}
        for t, c, times in zip(text.tolist(), code.tolist(), n.tolist(), strict=True):
            found.setdefault(t, {})[language_id.gram_of(c)] = times
        assert found == {i: dict(c) for i, t in enumerate(texts) if (c := plain_counts(t))}


def test_ranks_and_distances(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(ODD)], docs.schema)
    docs = docs.unionByName(odd).cache()
    rows = docs.collect()
    counts = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(plain_counts(r.text or ""))
    profiles = [
        (lang, sorted(c, key=lambda g: (-c[g], g.encode()))[: language_id.PROFILE]) for lang, c in sorted(counts.items())
    ]
    assert language_id.language_profiles(docs) == profiles
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(docs).collect()}
    for r in rows:
        lang, score = plain_prediction(r.text or "", profiles)
        assert found[r.doc_id][0] == lang and abs(found[r.doc_id][1] - score) < 1e-9, r.doc_id
