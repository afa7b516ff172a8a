"""Token counts of whole texts by table lookup of pre-tokens.

A byte-level BPE text is as long as its pre-tokens together.  The lengths of the most
frequent pre-tokens are looked up in one broadcast table; any other pre-token is encoded
once per task and kept in a bounded cache.  No pre-token is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import whole_text

# The pre-token pattern of byte-level BPE, with Unicode white space spelled out.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{L}\p{N}" + WHITE + r"]+"
    r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)
# Letters and digits beyond these differ between Unicode versions: such texts go to the library whole.
SETTLED = r"[^\x00-\u052f\u2000-\u206f\u20a0-\u20bf]"

# Files beyond this size are no tokenizer to broadcast.
LARGEST_FILE = 64_000_000
LONGEST_KEPT = 64
SAMPLE_CHARS = 20_000


class Lengths(dict):
    """Token count by pre-token; what is missing is encoded and kept, up to a limit."""

    def __init__(self, frequent: dict, encode, limit: int):
        super().__init__(frequent)
        self.frequent, self.encode, self.limit = frequent, encode, limit

    def __missing__(self, pre_token: str) -> int:
        n = self.encode(pre_token)
        if len(pre_token) <= LONGEST_KEPT:
            if len(self) >= self.limit + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[pre_token] = n
        return n


def _loaded(source: str):
    """The tokenizer, and the strings that it takes as one token each."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return (lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)), special


def _splitters(special: list[str]):
    import regex

    pieces = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or "(?!)")
    return regex.compile(PRE_TOKEN), regex.compile(SETTLED), pieces


def frequent_pre_tokens(docs: DataFrame, text: str, source: str, size: int, sample_rows: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample.

    The table only decides what is looked up and what is encoded, never a count, so a
    sample will do: up to ``sample_rows`` texts of up to ``SAMPLE_CHARS`` characters, as
    they are read first, and ``size`` entries of up to 64 characters.
    """
    import regex

    short = docs.select(F.col(text).alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    pattern, seen = regex.compile(PRE_TOKEN), Counter()
    for row in short.take(sample_rows):
        seen.update(p for p in pattern.findall(row.t) if len(p) <= LONGEST_KEPT)
    encode, _ = _loaded(source)
    return {p: encode(p) for p, _ in seen.most_common(size)}


def token_count(docs: DataFrame, text: str, tokenizer_file: str, table_size: int = 40_000,
                sample_rows: int = 2_000, cache_size: int = 200_000) -> Column:
    """Column with the number of tokens of each text, as the library counts them.

    No begin, end or added special tokens, no truncation; strings of special tokens
    inside a text count as the library takes them by default.  Null counts as empty.
    """
    path = Path(tokenizer_file)
    if path.stat().st_size > LARGEST_FILE:
        raise ValueError(f"{tokenizer_file} is too large to broadcast")
    context = docs.sparkSession.sparkContext
    source = path.read_text(encoding="utf-8")
    shared = context.broadcast((source, frequent_pre_tokens(docs, text, source, table_size, sample_rows)))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        source, frequent = shared.value
        encode, special = _loaded(source)
        pattern, unsettled, pieces = _splitters(special)
        lengths = Lengths(frequent, encode, cache_size)
        find, look = pattern.findall, lengths.__getitem__

        def count(value: str) -> int:
            if unsettled.search(value):
                return encode(value)
            parts = pieces.split(value)
            return len(parts) - 1 + sum(sum(map(look, find(part))) for part in parts)

        for batch in batches:
            yield pd.Series([count(v) for v in batch], dtype="int64")

    return tokens(whole_text(F.col(text)))


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, **settings) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every document.

    A null text is an empty one: 0 bytes, 0 tokens.  Repeated rows are counted each, a
    null doc_id stays null, further columns are not read.  No row gives no row.
    """
    counted = docs.select(
        "doc_id",
        F.octet_length(whole_text(F.col("text"))).cast("long").alias("n_bytes"),
        token_count(docs, "text", tokenizer_file, **settings).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
