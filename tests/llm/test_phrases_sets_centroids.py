"""Collocations, min-max near-duplicates and centroids against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportweave.llm import centroids, collocations, min_max, shingle_sets
from reportweave.llm.automata import CountAutomaton, compose, union

SCHEMA = "doc_id long, text string, lang string, source string, n string, key string, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The cat sat, the cat sat! THE CAT sat", "en", "a", "x", "y", "z"), (2, None, "en", None, None, None, None),
        (3, "", None, None, "x", "y", "z"), (None, "no id here", "en", "b", "x", "y", "z"),
        (None, "no id here", "en", "b", "x", "y", "z"), (4, long, "en", "b", "x", "y", "z"),
        (5, "no ID here", None, None, None, None, None), (5, "no ID here", None, None, None, None, None),
        (5, "another text of this id", "fr", None, None, None, None), (7, "!!! ...", "fr", "c", "x", "y", "z"),
        (None, "nobody else says this", None, None, None, None, None), (8, "\t \x0b", "fr", "c", "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


# --- automata -------------------------------------------------------------------


def some_paths(rng, n):
    words = [b"a", b"b", b"\x01", "ä".encode(), b"bb"]
    return {tuple(rng.choice(words) for _ in range(rng.randint(1, 5))): rng.randint(1, 3) for _ in range(n)}


def test_automata_keep_all_paths_and_share_states():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        paths = some_paths(rng, n)
        automaton = CountAutomaton.from_bytes(CountAutomaton.build(sorted(paths.items())).to_bytes())
        assert list(automaton.items()) == sorted(paths.items())
    # Words that are followed alike end in the same states: here one state per word of a path.
    alike = sorted(((bytes([65 + i]), b"x", b"y"), 7) for i in range(20))
    assert len(CountAutomaton.build(alike)) == 4
    assert list(CountAutomaton.build([((), 3)]).items()) == [((), 3)]


def test_union_adds_weights_and_composition_looks_up():
    rng = random.Random(2)
    shards = [some_paths(rng, 60) for _ in range(5)]
    total = Counter()
    for shard in shards:
        total.update(shard)
    automata = [CountAutomaton.build(sorted(s.items())) for s in shards]
    assert dict(union(automata).items()) == total
    assert dict(union(automata, 4).items()) == {p: n for p, n in total.items() if n >= 4}
    assert list(union([]).items()) == []
    asked = some_paths(rng, 80)
    hits = dict(compose(CountAutomaton.build(sorted(asked.items())), union(automata)))
    assert hits == {p: total[p] for p in asked if p in total}


# --- collocations ---------------------------------------------------------------


def brute_collocations(rows, longest, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p)
                      and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 100 * a for b in longer):
                score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations_match_brute_force(spark):
    rng = random.Random(3)
    words = ["of", "the", "new", "york", "stock", "Exchange", "ça", "x\x01y", "\x85", "a\x1cb"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text + rng.choice(["", "new york stock exchange"])))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = brute_collocations(rows, 5, 6, 30)
    assert len(expected) > 60
    assert result(collocations.collocations(docs, least=6, top=30)) == expected


class TaskOnly:
    """Keeps the function that a task runs."""

    def mapInArrow(self, function, schema):
        return function


def test_a_chunk_costs_what_it_holds(monkeypatch):
    """Many languages make many small chunks, each of which adds to tables of millions of counts."""
    rows = pa.RecordBatch.from_pylist([{"lang": f"l{i}", "text": "a b c d e " * 3} for i in range(60)])
    of_task = collocations._first_pass(TaskOnly(), 5, 2)
    began = time.process_time()
    found = [row for batch in of_task(iter([rows])) for row in batch.to_pylist()]
    assert time.process_time() - began < 5
    assert sum(row["number"] for row in found if row["kind"] == 0) == 60 * 15
    # Counts that are cut in between are those that are cut at the end.
    monkeypatch.setattr(collocations, "CUT", 20)
    assert found == [row for batch in of_task(iter([rows])) for row in batch.to_pylist()]


def test_collocations_of_many_ranges(spark):
    """Bounds in the middle of the paths, with parts looked up in other ranges."""
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(50))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    bounds = [(b"en", b"b"), (b"en", b"c", b"d"), (b"en", b"f", b"a", b"b")]
    first = collocations._first_pass(docs, 3, 10)
    frequent = collocations._frequent_buckets(first, 3, 10)
    united = collocations._united(collocations._shard_automata(docs, frequent, bounds, 3), 10)
    assert united.count() == 4
    counts = Counter()
    for _, text in rows:
        words = text.split()
        for n in range(1, 4):
            counts.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    wanted = {p: f for p, f in counts.items() if f >= 10}
    parts = spark.createDataFrame([("en", p) for p in [*wanted, "z z", "a z"]] + [("xx", "a")], "lang string, words string")
    found = {r.words: r.f for r in collocations._looked_up(united, parts, bounds).collect()}
    assert found == wanted


def test_collocations_of_odd_and_empty_tables(spark, odd):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert result(collocations.collocations(odd, least=2)) == brute_collocations(rows, 5, 2, 2000)
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd, least=100_000).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(odd, least=0)


# --- near-duplicates ------------------------------------------------------------


def brute_components(rows, n, share):
    def shingles(text):
        words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= share * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    named = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            named[find(i)].append(doc_id)
    found = []
    for i, (doc_id, _) in enumerate(rows):
        component = min(named[find(i)], default=None)
        found.append((doc_id, len(sets[i]), component, component is None or doc_id == component))
    return sorted(found, key=str)


def edited(rng, words, share):
    return [rng.choice("klmnop") + str(rng.random()) if rng.random() < share else w for w in words]


def test_min_max_components_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for base in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 8, 30, 120, 400]))]
        for share in [0, 0, *[rng.choice([0.002, 0.01, 0.02, 0.05]) for _ in range(rng.choice([0, 3, 20]))]]:
            rows.append((len(rows) * 7 % 1009, " ".join(edited(rng, words, share)).title()))
    # Cut to just above and below the limit.
    words = [f"v{i}" for i in range(202)]
    rows += [(2000 + n, " ".join(words[:n])) for n in (202, 173, 172, 171)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((tuple(r) for r in min_max.shingle_components(docs).collect()), key=str)
    assert found == brute_components(rows, 3, 85)


def test_crowds_of_similar_texts_lose_no_link(spark):
    """Many texts around one, most pairs of them just below the limit: their candidates come from prefixes."""
    rng = random.Random(8)
    rows = []
    for base in range(2):
        words = [f"c{base}x{i}" for i in range(120)]
        for i in range(70):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice([0.015, 0.025, 0.04])))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_components(rows, 3, 85)
    assert 10 < len({r[2] for r in expected}) < 130
    assert sorted((tuple(r) for r in min_max.shingle_components(docs).collect()), key=str) == expected


def test_crowds_that_are_not_similar_are_not_compared_in_full(spark, monkeypatch):
    """Texts that share three quarters of their shingles are candidates of each other, but their full sets are not joined."""
    rng = random.Random(9)
    words = [f"d{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.045 else f"x{rng.random()}" for w in words)) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(5)]
    candidates = []
    similar = min_max.similar_pairs

    def counted(*args):
        verify = similar(*args)

        def counting(pairs):
            candidates.append(pairs.count())
            return verify(pairs)

        return counting

    monkeypatch.setattr(min_max, "similar_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_components(rows, 3, 85)
    assert sorted((tuple(r) for r in min_max.shingle_components(docs).collect()), key=str) == expected
    assert sum(candidates) < 1500  # of 7,750 pairs


def test_min_max_of_odd_and_empty_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted((tuple(r) for r in min_max.shingle_components(odd).collect()), key=str)
    assert found == brute_components(rows, 3, 85)
    assert min_max.shingle_components(odd.limit(0)).count() == 0
    assert {r.kept for r in min_max.shingle_components(odd.where("doc_id is null")).collect()} == {True}


def test_many_equal_rows_without_an_id(spark):
    docs = spark.range(0, 4000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"))
    rows = min_max.shingle_components(docs).collect()
    assert len(rows) == 4000 and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(None, 2, None, True)}


def test_signature_values_agree_with_the_similarity():
    rng = np.random.default_rng(6)
    everything = rng.integers(0, 1 << 64, size=1150, dtype=np.uint64)
    a, b = np.unique(everything[:1000]), np.unique(everything[150:])
    factors, offsets = min_max.permutations(512)
    low_a, high_a = min_max.min_max(a, factors, offsets)
    low_b, high_b = min_max.min_max(b, factors, offsets)
    assert low_a[3] == min(int(x) * int(factors[3]) + int(offsets[3]) & (1 << 64) - 1 for x in a)
    agree = (np.mean(low_a == low_b) + np.mean(high_a == high_b)) / 2
    assert abs(agree - 850 / 1150) < 4 * math.sqrt(0.74 * 0.26 / 1024)
    assert len(set(min_max.band_keys(low_a[:64], high_a[:64]).tolist())) == 32


def test_shingle_sets():
    assert len(shingle_sets.shingle_set("a b c a b c a b c", 3)) == 3
    assert shingle_sets.shingle_set(None, 3).size == shingle_sets.shingle_set(" \t\x0b", 3).size == 0
    assert shingle_sets.shingle_set("A b", 3).tolist() == shingle_sets.shingle_set("a  B", 5).tolist()
    assert shingle_sets.shingle_set("a\x1cb c", 3).tolist() != shingle_sets.shingle_set("a b c", 3).tolist()


# --- centroids ------------------------------------------------------------------


def brute_clusters(rows, k, rounds, scale, dimensions, seed):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if groups[j] else c for j, c in enumerate(centers)]
    assigned = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in assigned:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted([(i, j, d, inertia[j], inertia.total(), digest[j]) for i, j, d in assigned], key=str)


def clusters(df, **settings):
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **settings).collect()), key=str)


def test_clusters_match_brute_force(spark):
    rng = random.Random(7)
    for spread in (0.002, 0.5, 3000.0):
        rows = [(i if rng.random() < 0.9 else i // 2, [rng.choice([rng.gauss(0, spread), 0.0, spread]) for _ in range(64)]) for i in range(300)]
        rows += [(1000, [None] * 64), (1001, [float("nan")] * 64), (1002, [0.0] * 63), (1003, None), (1004, []),
                 (1005, [0.0] * 63 + [float("-inf")]), (1006, [0.0] * 65), (None, [0.25] * 64), (None, [0.25] * 64), (4, [-0.3] * 64)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("cluster", F.lit("x"))
        expected = brute_clusters(rows, 8, 10, 1024, 64, 3)
        assert clusters(df) == expected


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5, -0.5]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters(df, k=8, dimensions=2) == brute_clusters(rows, 8, 10, 1024, 2, 3)
    # All are as far from every centroid, so the smallest number wins.
    assert {r[1] for r in clusters(df, k=3, dimensions=2)} == {0}
    assert clusters(df.limit(0), dimensions=2) == [] and clusters(df, dimensions=3) == []
    # Too large for whole numbers of 64 bits.
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r[0] for r in clusters(huge, dimensions=2)] == [2]


def test_tournament_on_the_bisector():
    center = np.array([[0, 0], [4, 0], [2, 0], [2, 0]], dtype=np.int64)
    normals, thresholds = centroids.bisectors(center)
    points = np.array([[1, 5], [3, -7], [2, 0], [9, 9], [-1, 0]], dtype=np.int64)
    assert centroids.tournament(points, normals, thresholds).tolist() == [0, 1, 2, 1, 0]
