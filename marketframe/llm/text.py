"""Column helpers shared by the text operators (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the white-space kind, and what lies between two of them.
SPACE = r"[\x20\x09-\x0D]+"
#: What lies between two words of letters, digits and non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  A text of as many bytes as characters is ASCII, and
    there the quick built-in does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, between: str = SPACE) -> Column:
    """The words of a text, null texts having none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
