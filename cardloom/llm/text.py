"""Text rules that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    """The lines of a text, split at line feeds; an empty text has one empty line."""
    return F.split(text, "\n", -1)


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "")


def byte_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: bytes.split() parts at the white space that WORD excludes, byte for byte."""
    return text.split()
