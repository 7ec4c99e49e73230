"""Text normalisation as column expressions.

All functions take a column (or its name) and return a column; none leaves the
JVM.  White space means the Unicode set of the host language of the data
(tabs, line ends, U+001C-U+001F, NBSP, the general-punctuation blanks), because
the engine's ``\\s`` and ``trim`` cover fewer characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class body for the regular expressions below.
BLANK = r"\t-\r\x1c-\x20\x{85}\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), rf"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank, ends are stripped."""
    return F.trim(F.regexp_replace(col(c), rf"[{BLANK}]+", " "))


def name_text(c: Column | str) -> Column:
    """Lower case; ``_``, ``-`` and punctuation become blanks, squeezed. Null gives the empty text."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "_-", "  "), r"[^\p{L}\p{N}]", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def surface_text(c: Column | str) -> Column:
    """Lower case, white space squeezed, punctuation kept. Null gives ``none``, as its printed form would."""
    return squeeze(F.lower(F.coalesce(col(c), F.lit("None"))))


def compact_text(c: Column | str) -> Column:
    """surface_text without blanks, hyphens and underscores."""
    return F.translate(surface_text(c), " -_", "")


def entropy_key(c: Column | str) -> Column:
    """Stripped lower case: the key of molecules in entropy tables and evidence."""
    return F.lower(strip(c))


def tokens(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits; other letters separate. Null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^0-9A-Za-z]+"), lambda t: t != "")


def clean_prediction(c: Column | str) -> Column:
    """Without ``[``, ``]``, ``*``, stripped."""
    return strip(F.translate(col(c), "[]*", ""))


def synonym_parts(c: Column | str) -> Column:
    """Parts of a list separated by ``;``, ``,`` or ``|``, stripped, without blanks. Null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[;,|]"), strip), lambda p: p != "")


def functional_groups(c: Column | str) -> Column:
    """The groups of a molecule, distinct, in order.

    Tokens are separated by single blanks and empty ones count (so a null or
    empty text has the one group ``""``).  A token with ``@`` gives its second
    part if it has ``compound`` in it and its first if it has ``primary``, both
    if both, none if neither; other tokens stand for themselves.
    """

    def parsed(t: Column) -> Column:
        second = F.when(t.contains("compound"), F.array(F.element_at(F.split(t, "@"), 2))).otherwise(F.array().cast("array<string>"))
        first = F.when(t.contains("primary"), F.array(F.element_at(F.split(t, "@"), 1))).otherwise(F.array().cast("array<string>"))
        return F.when(t.contains("@"), F.concat(second, first)).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(col(c), F.lit("")), " "), parsed)))


def category_head(c: Column | str) -> Column:
    """The part of a category before its first hyphen."""
    return F.substring_index(col(c), "-", 1)


def first_truthy(*cols: Column | str) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))
