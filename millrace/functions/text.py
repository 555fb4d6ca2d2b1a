"""Tokenising expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything between words: a backslash with a letter, blanks, ASCII punctuation.
BETWEEN_WORDS = r"(?:\\[a-zA-Z]|[\s!-/:-@\[-`{-~])+"
NOT_PLAIN = r"[^A-Za-z0-9 ]"
NOISE = r"^([0-9]+|[a-z])$"


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits, split at blanks; may hold ''."""
    return F.split(F.regexp_replace(F.lower(text), NOT_PLAIN, " "), " ", -1)


def content_words(text: Column) -> Column:
    """Lower-case words between blanks and punctuation; may hold ''."""
    return F.split(F.lower(text), BETWEEN_WORDS, -1)


def listed(text: Column) -> Column:
    """Parts of a comma-separated list; full-width commas count too."""
    return F.split(F.trim(text), r"\s*[,，]\s*", -1)
