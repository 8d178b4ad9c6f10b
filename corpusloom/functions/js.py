"""Text functions with the semantics of the web platform: white space, trimming, truncation, word boundaries, rounding.

Lengths and cuts count code points; a web browser counts UTF-16 units, which differs beyond the basic plane.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What \s matches there. Java's \s is ASCII only.
WS = r"[ \t\n\u000b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same characters, each by itself.
SPACES = " \t\n\u000b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: ASCII word boundaries; Java's \b is Unicode-aware.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def text(c: Column | str) -> Column:
    """The string, or '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def or_else(*choices: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def _parts(c: Column | str) -> Column:
    """The parts of a text between white space, without patterns, which take several times as long on whole texts. A lambda keeps
    the plan's node out of whole-stage code: there loops over words stand in one method with all else, often too large to be compiled."""
    return F.filter(F.split(F.translate(text(c), SPACES, " " * len(SPACES)), " "), lambda x: x != "")


def clean(c: Column | str) -> Column:
    """White space collapsed and trimmed; null becomes ''."""
    return F.array_join(_parts(c), " ")


def word_count(c: Column | str) -> Column:
    """words(clean(c)), without making the cleaned text."""
    return F.size(_parts(c))


def trim(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    """How many words a cleaned text has."""
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def cut(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def shorten(c: Column, most: int) -> Column:
    """Cleaned, and with an ellipsis where it is longer."""
    return shorten_cleaned(clean(c), most)


def shorten_cleaned(t: Column, most: int) -> Column:
    """The same of a text that is cleaned already."""
    return F.when(F.length(t) > most, F.concat(F.trim(cut(t, most - 1)), F.lit("…"))).otherwise(t)


def shorten_at_word(c: Column, most: int) -> Column:
    """Cut at the last space if that keeps more than 60 %."""
    head = cut(c, most)
    space = F.lit(most) - F.locate(" ", F.reverse(head))  # 0-based; most where there is none
    by_word = F.when((F.locate(" ", head) > 0) & (space > most * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(c) > most, F.concat(by_word, F.lit("…"))).otherwise(c)


def rounded(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + F.lit(0.5))


def any_word(pattern: str) -> str:
    """A case-insensitive pattern of whole ASCII words."""
    return f"(?i){WORD_START}(?:{pattern}){WORD_END}"
