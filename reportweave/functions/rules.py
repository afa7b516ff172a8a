"""Ordered rules as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(col: Column, parts) -> Column:
    """Whether the text holds at least one of the parts."""
    return reduce(or_, (F.contains(col, F.lit(p)) for p in parts))


def first_match(col: Column, rules, default=None) -> Column:
    """Label of the first rule one of whose parts occurs in the text.

    ``rules`` is an ordered list of ``(parts, label)``; labels and ``default`` may be
    values or Columns.  For any-case matching pass a lower-cased text.
    """
    chain = None
    for parts, label in rules:
        test = contains_any(col, [parts] if isinstance(parts, str) else parts)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    default = default if isinstance(default, Column) else F.lit(default)
    return default if chain is None else chain.otherwise(default)


def keyword_category(col: Column, categories: dict, default: str = "unknown") -> Column:
    """First category with a keyword in the text, in any case; a null text gets the default."""
    return first_match(F.lower(col), [(words, name) for name, words in categories.items()], default)


def exact_map(col: Column, mapping) -> Column:
    """Replace whole values: ``mapping`` is an ordered list of ``(values, replacement)``."""
    chain = None
    for values, replacement in mapping:
        test = col.isin(list(values))
        new = F.lit(replacement).cast("string")
        chain = F.when(test, new) if chain is None else chain.when(test, new)
    return col if chain is None else chain.otherwise(col)


def default_if_blank(col: Column, default: str) -> Column:
    """Default for null and ``''``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))
