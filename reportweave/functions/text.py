"""Text functions as native column expressions.

Every function takes and returns a Column and stays in the JVM, apart from :func:`slugify`
with ``allow_unicode``, whose composition of characters has no built-in.  What :func:`let`
binds is evaluated outside whole-stage code generation.

Nothing here names an intermediate column, so the functions can be nested and
filtered on freely; see :func:`let`.

Regular expressions carry inline flags so that Java reads them as intended:
``(?U)`` Unicode classes, ``(?d)`` only a newline stops a dot, ``(?i)`` any case.
A missing match and an empty capture both come back as ``''`` from
``regexp_extract``; :func:`capture` tells them apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed_values as V


def strip(col: Column) -> Column:
    """Drop Unicode white space, line breaks included, at both ends."""
    return F.btrim(col, F.lit(V.WHITESPACE))


def text_or_empty(col: Column) -> Column:
    """A missing text reads as an empty one."""
    return F.coalesce(col, F.lit(""))


def regex(pattern: str, flags: str = "Ud") -> str:
    """Pattern with inline flags; ``\\s`` also covers the four ASCII separators."""
    return f"(?{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def extract(col: Column, pattern: str, group: int, flags: str = "Ud") -> Column:
    """Group of the first match; ``''`` without a match."""
    return F.regexp_extract(col, regex(pattern, flags), group)


def capture(col: Column, pattern: str, group: int, flags: str = "Ud") -> Column:
    """Group of the first match, null without a match."""
    return F.get(F.regexp_extract_all(col, F.lit(regex(pattern, flags)), F.lit(group)), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` reads it.

    Naming a value by a further column would do the same, until a filter on the
    result is pushed down: the optimizer then puts the full expression in the
    place of every mention, level by level.  Here the value occurs only once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(col: Column, pattern: str, flags: str = "Ud") -> Column:
    return F.rlike(col, F.lit(regex(pattern, flags)))


def extract_answer(col: Column, question: int) -> Column:
    """Answer to one numbered question of a response, ``''`` when absent.

    The answer starts after the first ``.`` or ``:`` behind ``Q<n>`` (no ``*`` in
    between) and ends before a line that opens ``Q<n+1>``, bold or not.
    """
    # Whole lines at a time, and possessive: no backtracking and no recursion, so
    # that long answers neither slow down nor exhaust the stack.
    body = rf"((?:[^\n]++|\n(?!(?:\*\*)?Q{question + 1}))*+)"
    return strip(F.regexp_extract(text_or_empty(col), rf"Q{question}[^*]*?[.:]{body}", 1))


def labelled_field(col: Column, label: str, stop: str = r"*\n.") -> Column:
    """Value behind a bold ``**Label:**`` up to the first stop character.

    Null when the label is absent; may be ``''`` when only blanks follow it.
    """
    name = re.escape(label).replace(r"\ ", " ")
    return strip(capture(col, rf"\*\*{name}:\*\*\s*([^{stop}]+)", 1))


def rewrite(col: Column, pairs) -> Column:
    """Replace literal texts one after the other, in the given order."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def unify(col: Column, phrases, heading: str) -> Column:
    """Replace each of the phrases by one heading."""
    return rewrite(col, [(phrase, heading) for phrase in phrases])


def rewrite_patterns(col: Column, pairs) -> Column:
    """Replace patterns one after the other, in the given order."""
    return reduce(lambda c, p: F.regexp_replace(c, regex(p[0]), p[1]), pairs, col)


def cut_tail(col: Column, marker: str, ending: str = "") -> Column:
    """Cut everything from the first ``marker`` on, put ``ending`` there, strip."""
    if not ending:
        return strip(F.substring_index(col, marker, 1))
    return strip(F.regexp_replace(col, f"(?s){re.escape(marker)}.*", ending))


def split_keep(col: Column, separator: str = ",") -> Column:
    """Split at a separator, strip the pieces, keep empty ones."""
    return F.transform(F.split(col, re.escape(separator)), strip)


def split_list(col: Column, separators: str = V.FACTORS_SEPARATORS, drop_empty: bool = True) -> Column:
    """Split at a pattern, strip the pieces and drop empty ones."""
    pieces = F.transform(F.split(col, f"(?U){separators}"), strip)
    return F.filter(pieces, lambda p: p != "") if drop_empty else pieces


def presence_flag(present: Column, absent: Column) -> Column:
    """True where ``present`` holds, else False where ``absent`` holds, else null."""
    return F.when(present, F.lit(True)).when(absent, F.lit(False))


def choice_flag(captured: Column, positive: str) -> Column:
    """Whether a captured choice is ``positive``; null where nothing was captured."""
    return F.lower(captured) == positive


def pretty_label(col: Column) -> Column:
    """Underscores to blanks, first letter title case and the rest lower case."""
    words = F.replace(col, F.lit("_"), F.lit(" "))
    first = F.substring(words, 1, 1)
    upper = F.upper(first)
    # Some letters are several in upper case; only the first of these stays so.
    several = F.concat(F.substring(upper, 1, 1), F.lower(F.substr(upper, F.lit(2))))
    return F.concat(F.when(F.length(upper) > 1, several).otherwise(F.initcap(first)), F.lower(F.substr(words, F.lit(2))))


@cache
def _ascii_parts() -> tuple[dict[str, str], dict[str, str]]:
    """ASCII characters that other characters decompose to (NFKD): those with one, and those with several."""
    parts = {c: "".join(p for p in unicodedata.normalize("NFKD", c) if p < "\x80") for c in map(chr, range(128, 0x110000))}
    return {c: p for c, p in parts.items() if len(p) == 1}, {c: p for c, p in parts.items() if len(p) > 1}


def _ascii_form(col: Column) -> Column:
    """Compatibility decomposition without what is not ASCII.

    Characters decompose one by one, and the marks that decomposition would put in order are all dropped, so a
    table of characters does it.  Of those that become several, only the ones in the text are replaced.
    """
    one, several = _ascii_parts()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    beyond = F.array_distinct(F.regexp_extract_all(col, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    found = F.filter(beyond, lambda c: F.map_contains_key(table, c))
    written_out = F.aggregate(found, col, lambda text, c: F.replace(text, c, F.element_at(table, c)))
    return F.regexp_replace(F.translate(written_out, "".join(one), "".join(one.values())), r"[^\x00-\x7F]+", "")


@F.pandas_udf(StringType())
def _composed_form(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


# ASCII characters that a slug drops: no letter, digit, blank, underscore or hyphen.
_DROPPED = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c.isspace() or c in "_-"))


def slugify(col: Column, allow_unicode: bool = False) -> Column:
    """Lower-case name of letters, digits, ``_`` and single ``-``."""
    if allow_unicode:
        kept = F.regexp_replace(F.lower(_composed_form(col)), regex(r"[^\p{L}\p{N}_\s-]"), "")
    else:
        kept = F.translate(F.lower(_ascii_form(col)), _DROPPED, "")
    return F.btrim(F.regexp_replace(kept, regex(r"[-\s]+"), "-"), F.lit("-_"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without folder and extension; leading dots belong to the name."""
    return F.regexp_extract(file_name(path), r"(?s)\A(\.*+.*?)(?:\.[^.]*)?\z", 1)
