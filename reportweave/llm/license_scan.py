"""License scans: exact phrases, and short notices with a few errors.

A notice of length n that occurs with k errors or fewer leaves one of k + 1 pieces of it
untouched (pigeonhole).  All pieces are searched at once; where one is found, bounded-error
matching of the whole notice decides on the text around it and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import whole_text

# Phrases, and the labels that they stand for.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Short notices to find with errors: label, words, errors allowed (characters).
NOTICES = (
    ("apache", "licensed under the apache license", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 9),
    ("cc-by", "licensed under a creative commons attribution", 5),
    ("cc-by", "licensed under cc by", 2),
    ("cc-by-nc", "licensed under cc by nc", 2),
    ("gpl", "gnu general public license", 3),
    ("gpl", "general public license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 8),
    ("mit", "released under the mit license", 3),
    ("mpl", "mozilla public license", 2),
    ("proprietary", "proprietary and confidential", 3),
    ("reserved", "all rights reserved", 2),
)

MATCHES = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label: string, start_word: long, end_word: long, errors: int, found: string>>"
)
# Everything but digits, letters and bytes of non-ASCII characters separates words.
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
TO_WORDS = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123))
)


def pieces_of(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces with their places, as equal in length as can be."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Exact phrases and bounded-error notices in one text."""

    def __init__(self, phrases: dict[str, str], notices: tuple[tuple[str, str, int], ...]):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [
            (label, words, errors, *(regex.compile(f"{flag}(?:{regex.escape(words)}){{e<={errors}}}") for flag in ("", "(?b)")))
            for label, words, errors in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words, errors) in enumerate(notices):
            for at, piece in pieces_of(words, errors):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def exact(self, line: bytes) -> list[tuple[int, int, str]]:
        """``(first word, after the last word, label)`` of all places of all phrases; places may overlap."""
        found = []
        for phrase, label in self.phrases:
            n = phrase.count(b" ") - 1
            at, words, counted = line.find(phrase), 0, 0
            while at >= 0:
                words += line.count(b" ", counted, at)
                counted = at
                found.append((words, words + n, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int, str]]:
        """``(start, end, label, errors, found text)`` in characters, from the windows around seeds.

        Windows of one notice that touch are searched as one, and whole texts of nothing but
        seeds cost no more than their length: a window is searched once, from left to right, for
        the next place, and only the text from there on that one notice can take for the best one.
        """
        windows: dict[int, list[list[int]]] = {}
        for end, (n, places) in self.seeds.iter(line):
            start = end + 1 - n
            for k, at in places:
                _, words, errors, *_ = self.notices[k]
                left = max(0, start - at - errors)
                right = min(len(line), start - at + len(words) + errors)
                own = windows.setdefault(k, [])
                if own and left <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], right)
                    own[-1][0] = min(own[-1][0], left)
                else:
                    own.append([left, right])
        found = []
        for k, own in windows.items():
            label, _, errors, any_place, best_place = self.notices[k]
            for left, right in own:
                while first := any_place.search(line, left, right):
                    m = best_place.search(line, first.start(), min(right, first.end() + errors))
                    found.append((m.start(), m.end(), label, sum(m.fuzzy_counts), m.group()))
                    left = m.end()
        return sorted(found)

    def scan(self, text: str) -> tuple:
        words = text.encode().translate(TO_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        exact = self.exact(line)
        starts = [e[0] for e in exact]
        base = sorted({e[2] for e in exact})
        fuzzy, spans = self.fuzzy(as_text := line.decode()), []
        score = 1.0 if exact else 0.0
        lengths = {label: max(len(w) for x, w, *_ in self.notices if x == label) for _, _, label, _, _ in fuzzy}
        done = at = 0
        for start, end, label, errors, found in fuzzy:
            at += as_text.count(" ", done, start)
            done = start
            first = at - (as_text[start] != " ")
            spans.append({"label": label, "start_word": first, "errors": errors, "found": found,
                          "end_word": first + len(found.split())})
            score = max(score, 1.0 - errors / max(lengths[label], len(found)))
        labels = sorted({*base, *(s["label"] for s in spans)})
        return (len(words), len(exact), min(starts, default=None), max(starts, default=None),
                ",".join(base), ",".join(labels), score, spans)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """``doc_id`` and what is found in the whole text, word places counted from 0.

    A null or empty text has no words, no places and empty labels.  Repeated rows are
    scanned each; further columns are not read.  ``score`` is 1 for an exact phrase, else
    one minus the share of characters that differ in the best notice, else 0.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    @F.pandas_udf(MATCHES)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            found = pd.DataFrame([scanner.scan(v) for v in batch], columns=names)
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan(whole_text(F.col("text"))).alias("found")).select("doc_id", "found.*")
