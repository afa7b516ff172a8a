"""Each operation against a brute-force version, and the edge cases: nulls, empty and long texts, ties, repeats."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from reportweave.llm import decontaminate, fingerprints, language_id, license_scan, line_dedup, mixing, near_dedup
from reportweave.llm import quality, token_counts, toxicity
from reportweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, an empty and a long text, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and All Rights Reserved.\nsame line here for all of us", "en", "a", 1, "x", "y"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, "x", "y"),
        (None, "no id here", "en", "b", 3, "x", "y"),
        (4, long, "en", "b", 4, "x", "y"),
        (5, "ça va très bien\nsame line here for all of us", None, None, 5, None, None),
        (5, "ça va très bien\nsame line here for all of us", None, None, 5, None, None),
        (7, "!!! ...", "fr", "c", 7, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    return spark.createDataFrame([(1, words), (2, None), (3, "tiny item"), (None, "x")], "item_id long, text string")


def operations(labels, benchmark):
    import public_tokenizers

    return {
        "lines": line_dedup.line_report,
        "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
        "language": language_id.identify_language,
        "mix": mixing.mix_sizes,
        "licenses": license_scan.scan_licenses,
        "near": near_dedup.near_duplicates,
        "quality": lambda d: quality.judge_quality(d, labels, F.col("source"), F.col("lang")),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "fingerprints": fingerprints.document_fingerprints,
    }


@pytest.mark.parametrize("name", ["lines", "tokens", "language", "mix", "licenses", "near", "quality", "toxicity", "fingerprints"])
def test_odd_and_empty_tables(spark, odd, labels, benchmark, name):
    operation = operations(labels, benchmark)[name]
    assert operation(odd).count() == odd.count()
    assert operation(odd.limit(0)).count() == 0


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "Hello  world\n\n x", "a<|endoftext|>b", "日本 123", "　x\x85y", "it's we'LL", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(path)
    for row in token_counts.count_tokens(docs, path).collect():
        assert row.n_tokens == len(tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert row.n_bytes == len(texts[row.doc_id].encode())


def test_licenses(spark):
    texts = {
        1: "CC-BY here, cc by cc by. All RIGHTS reserved", 2: "Gnu general publik license", 3: "Released under the MIT Licence.",
        4: None, 5: "rights reserved all",
    }
    found = {r.doc_id: r for r in license_scan.scan_licenses(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (4, 0, 7, "cc-by,reserved")
    assert found[2].n_base == 0 and found[2].labels == "gpl" and 0.9 < found[2].score < 1
    assert found[3].labels == "mit" and found[3].spans[0].found.startswith("released")
    assert found[4].n_words == 0 and found[4].labels == "" and found[5].n_base == 0


def test_adjacent_notices():
    """Places of one notice in one window, of differing errors: each is found, at its best."""
    scanner = license_scan.Scanner({}, (("gpl", "general public license", 2), ("reserved", "all rights reserved", 2)))

    def places(text):
        return [(s["label"], s["start_word"], s["errors"], s["found"]) for s in scanner.scan(text)[-1]]

    wrong, right = ("gpl", 1, "general publik license"), ("gpl", 0, "general public license")
    for order in ([wrong, right], [right, wrong], [wrong, wrong, right, wrong], [right, right]):
        text = " ".join(found for _, _, found in order)
        assert places(text) == [(label, 3 * i, errors, found) for i, (label, errors, found) in enumerate(order)]
    assert places("al rights reserved all rights reserved all rigts reservd") == [
        ("reserved", 0, 1, "al rights reserved"), ("reserved", 3, 0, "all rights reserved"), ("reserved", 6, 2, "all rigts reservd")]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (200, 200)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 103: 100, 105: 100}


def test_fingerprint_components(spark):
    base = [0x0123456789ABCDEF, 0x7000000000000001, 0x2AAAAAAAAAAAAAAA]
    values = {b for b in base} | {b ^ (1 << i) ^ (1 << (63 - i) >> 1) for b in base for i in range(0, 30, 3)} | {base[0] ^ 0xFF}
    found = near_dedup.fingerprint_components(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r.node: r.root for r in found.collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 3:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert {v: roots.get(v, v) for v in values} == {v: find(v) for v in values}


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = spark.createDataFrame([(1, f"{long}\nunique one"), (2, f"{long.upper()}!\n...\n\nOther"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"{long}\nunique one", 2: "...\n\nOther", 3: None}


def test_near_duplicate_texts(spark):
    words = [f"w{i}x{i * i}" for i in range(300)]
    changed = [*words[:150], "other", *words[151:]]
    rows = [(4, " ".join(words)), (2, " ".join(changed)), (9, " ".join(words)), (7, " ".join(words[:40])), (8, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()} == {2, 7, 8}


def test_near_duplicate_texts_just_above_the_limit(spark):
    """Every pair of shingle similarity 0.8 or more: cut, prefixed, edited in a block, edited word by word."""
    rows, wanted = [], set()
    for n in (12, 60, 300, 1500):
        for k in range(12):
            base = [f"n{n}k{k}w{i * i % 997}x{i}" for i in range(n)]
            cut = base[: n - (n - 4) // 5 + 1]
            prefixed = [f"f{i}k{k}n{n}" for i in range((n - 4) // 4)] + base
            block = [*base[: n // 2], *(f"b{i}k{k}n{n}" for i in range((n - 4) // 9 - 4)), *base[n // 2 + max(0, (n - 4) // 9 - 4) :]]
            single = [f"s{i}k{k}n{n}" if i % 100 == 7 + k and n >= 300 else w for i, w in enumerate(base)]
            for words in (base, cut, prefixed, block, single, base[: n * 3 // 4]):
                rows.append((len(rows), " ".join(words)))
    sets = [set(near_dedup.shingles(text, 5)) for _, text in rows]
    parent = list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                wanted.add((b, a))
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert len(wanted) > 150
    found = near_dedup.text_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in found} == {v: find(v) for v in range(len(rows))}


def test_contaminated(spark, benchmark):
    item = benchmark.first().text.split()
    swapped = " ".join("zzz" if i in (4, 9) else w for i, w in enumerate(item))
    docs = spark.createDataFrame(
        [(1, f"start {swapped} end"), (2, " ".join(reversed(item))), (3, "a Tiny, item!"), (4, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_overlap, r.n_equal) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1): (15, 13), (3, 3): (2, 2)}


def test_masks_and_pieces_reach_every_placement():
    """Up to a fifth of the tokens differ, in all placements: a mask fits between them, or a piece is untouched."""
    def hit(n, places, seeds):
        return any(not any(at + i in places for i in seed) for span, seed in seeds for at in range(n - span + 1))

    masks = [(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in decontaminate.MASKS]
    for n in range(13, 26):
        missed = [p for p in itertools.combinations(range(n), n // 5) if not hit(n, p, masks)]
        assert not missed, (n, len(missed))
    for n in range(1, 13):
        for p in itertools.combinations(range(n), n // 5):
            assert any(not any(at <= i < at + length for i in p) for at, length in decontaminate.pieces(n, 0.8)), (n, p)


def test_contaminated_wherever_tokens_differ(spark):
    """Every placement of a fifth of the tokens, for items of 1 to 13 tokens, and some of 15 and 20."""
    items, docs = [], []
    for n in [*range(1, 14), 15, 20]:
        item = [f"item{n}word{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for places in list(itertools.combinations(range(n), n // 5))[:: 1 if n < 14 else 13]:
            words = ["zzz" if i in places else w for i, w in enumerate(item)]
            docs.append((10_000 * n + len(docs), f"before {' '.join(words)} after"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i // 10_000) for i, _ in docs}
    assert all(r.n_equal >= 0.8 * r.n_overlap for r in found)


def test_rows_without_an_id(spark, benchmark):
    """They are deduplicated, decontaminated and mixed like any other."""
    line = "this line is in several documents of the corpus and stays in one"
    texts = [" ".join(f"d{d}w{i}" for i in range(60)) for d in range(4)]
    rows = [
        (1, texts[0], "a"), (None, texts[0] + " more", "a"), (None, texts[1], "b"), (None, texts[1], "b"),
        (None, None, None), (None, texts[2] + " " + benchmark.first().text, "a"), (2, texts[3], "b"),
        (None, texts[2], "a"), (None, f"only {line}\n{line}", "b"), (None, f"x y z\n{line}", "b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    unique = near_dedup.without_near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in unique) == sorted(
        (i or 0, t or "") for k, (i, t, _) in enumerate(rows) if k not in (1, 3))
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted(
        (i or 0, t or "") for k, (i, t, _) in enumerate(rows) if k != 5)
    lines = "\n".join(r.text or "" for r in line_dedup.dedup_lines(docs).collect()).split("\n")
    assert lines.count(line) <= 1 and lines.count(texts[1]) == 1
    mix = mixing.mixed(docs).collect()
    plan = mixing.mix_plan(docs).collect()
    assert sum(len((r.text or "").split()) for r in mix) >= 0.8 * sum(r["size"] for r in plan)
    assert sum(r.doc_id is None for r in mix) >= 5
    assert [tuple(r) for r in mixing.mixed(docs.repartition(3)).collect()] == [tuple(r) for r in mix]


def test_edited_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(docs).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    for k, (doc_id, text) in enumerate(texts):
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[(k + 1) % len(texts)][1][:half]
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_simhash_is_exact(spark):
    import xxhash

    texts = ["", "one", "A b c d e", " ".join(f"t{i % 7} u{i}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in near_dedup.near_duplicates(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id].lower())
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        assert int(row.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_language_needs_a_letter(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "½ ² 7", "en"), (3, "a½", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs).collect()}
    assert got == {1: "en", 2: "und", 3: "en"}


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count()
    good = quality.judge_quality(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").where("held_out")
    assert good.where("keep = (quality = 1)").count() >= 0.9 * good.count()
    toxic = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    assert toxic.where("predicted = 1 and toxic = 0").count() <= 0.02 * toxic.count()
    assert toxic.where("predicted = 1 and toxic = 1").count() >= 0.5 * toxic.where("toxic = 1").count()


def test_line_dedup_with_columns_of_its_own_names(spark):
    rows = [(1, "same line here for all\nfirst text", "x", 5, "k"), (2, "same line here for all\nanother one", "y", 6, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string, of_doc int, key string")
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert found[1].text == rows[0][1] and found[2].text == "another one" and found[None].text is None
    assert (found[2].dropped, found[2].of_doc, found[1].key) == ("y", 6, "k")
