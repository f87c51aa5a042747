"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation taken off both ends of a word, the marker of an output
# without any word, and every character that counts as white space.
EDGE_PUNCTUATION = ".,;:!?\"'()[]{}<>"
EMPTY_MARK = "[empty]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def last_token(text: Column) -> Column:
    """Last run of non-space characters, ``""`` if there is none.

    Searches from the end of the text, once per kind of space; after the first cut only the last few
    characters are left, so no pattern has to run over the text.
    """
    rest = F.rtrim(text, F.lit(WHITESPACE))
    for space in (" ", *WHITESPACE):
        rest = F.substring_index(rest, space, -1)
    return rest


def last_word(text: Column) -> Column:
    """Last token without punctuation at its ends; ``""`` for blank or punctuation-only text."""
    return F.btrim(last_token(text), F.lit(EDGE_PUNCTUATION))


def strip_prompt_echo(text: Column, prompt: Column) -> Column:
    """Drop an echoed prompt: a leading one only once, else every occurrence; then trim."""
    prompt = F.coalesce(prompt, F.lit(""))
    rest = F.when(
        F.startswith(text, prompt), F.substring(text, F.length(prompt) + 1, F.length(text))
    ).otherwise(F.replace(text, prompt, F.lit("")))
    return trim_space(rest)


def format_ok(word: Column) -> Column:
    """One word: not blank, and neither a space nor a hyphen inside."""
    word = trim_space(word)
    return (
        (F.length(word) > 0) & ~F.contains(word, F.lit(" ")) & ~F.contains(word, F.lit("-"))
    )
