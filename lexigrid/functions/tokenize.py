"""Tokenisers as functions from a string Column to an array Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Explicit classes: the engines differ in what a bare \w matches.
WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters and runs of marks, split at white space."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def boundary_tokens(text: Column) -> Column:
    """Lower-cased pieces between word boundaries, trimmed, blanks dropped; a run of marks keeps its inner white space."""
    pieces = F.transform(F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def display_tokens(text: Column, glue: str = "before") -> Column:
    """As many tokens as word_tokens gives, in original case, with the white space before or after each."""
    pattern = {"before": rf"\s*(?:{WORDS})", "after": rf"(?:{WORDS})\s*"}[glue]
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
