"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the data.
LINE_BREAK = r"\r\n|\r|\n"
TOKEN_SEPARATOR = " "
OUTER_NON_LETTERS = r"^[^\p{L}]+|[^\p{L}]+$"
KEY_SEPARATOR = "_"
KEY = "^(.*)_([0-9]{1,9})$"

# The stretch from the first to the last letter of one space-separated token.
WORD = r"(\p{L}(?:[^ ]*\p{L})?)"


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def tokens(text: Column) -> Column:
    return F.split(text, TOKEN_SEPARATOR, -1)


def clean(token: Column) -> Column:
    """Strip non-letters from both ends and lower-case; '' if nothing is left."""
    return F.lower(F.regexp_replace(token, OUTER_NON_LETTERS, ""))


def words(text: Column) -> Column:
    """All cleaned tokens of a line in one pass: same as cleaning every token
    and dropping the empty ones."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.lower)


def sense_key(word: Column, sense: Column) -> Column:
    return F.concat_ws(KEY_SEPARATOR, word, sense.cast("string"))


def key_word(key: Column) -> Column:
    """The word of a key: all before the last separator, as words have some too."""
    return F.regexp_extract(key, KEY, 1)


def key_sense(key: Column) -> Column:
    return F.regexp_extract(key, KEY, 2).cast("int")
