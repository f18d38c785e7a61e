"""Token patterns and Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_BREAK = "</s>"

#: White space that separates tokens, as a regex class body (fixed values).
#: Java's and RE2's \s differ from it and from each other.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: The same characters but newline, one by one.
BLANKS = "\t\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def token_pattern(period_is_whitespace: bool = False) -> str:
    """Matches one token: a break (newline or leading full stop) or a word."""
    return rf"[\n.]|[^{WHITE}{'.' if period_is_whitespace else ''}]+"


def _spaced(text: Column) -> Column:
    """The text with every blank as a plain space.

    Java tests a class of many ranges range by range for each character;
    after this pass two characters decide, which is over ten times faster.
    """
    return F.translate(text, BLANKS, " " * len(BLANKS))


def _spaced_pattern(period_is_whitespace: bool) -> Column:
    return F.lit(r"[\n.]|[^ \n.]+" if period_is_whitespace else r"[\n.]|[^ \n]+")


def tokens_of(text: Column, period_is_whitespace: bool = False) -> Column:
    """The tokens of a text; newlines and leading full stops become breaks.

    Null for a null text, an empty array for one without tokens.
    """
    found = F.regexp_extract_all(_spaced(text), _spaced_pattern(period_is_whitespace), F.lit(0))
    return F.transform(found, lambda t: F.when(t.isin("\n", "."), F.lit(CONTEXT_BREAK)).otherwise(t))


def token_count(text: Column, period_is_whitespace: bool = False) -> Column:
    """How many tokens tokens_of() finds, without making them."""
    return F.regexp_count(_spaced(text), _spaced_pattern(period_is_whitespace)).cast("bigint")
