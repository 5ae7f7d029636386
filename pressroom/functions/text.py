"""Text functions: every one is a Column expression that runs in the JVM; those with lambdas are interpreted, not generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space stripped at the ends, and the ASCII white space collapsed inside a line.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ASCII_SPACE = r"[\t\n\f\r ]"
# Fixed value: a word is a run of letters, decimal digits or underscores.
WORD = r"[\p{L}\p{Nd}_]+"

MIN_WORDS = 80


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A Column is a tree: without this, functions that use their argument many times grow exponentially when nested.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, name: str, body: str) -> Column:
    """:func:`let` with the body as SQL text: one call into the JVM, where a Column body costs one per operator."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


_SPACE_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in UNICODE_SPACE) + "'"


def trim_sql(text: str) -> str:
    return f"btrim({text}, {_SPACE_LITERAL})"


def trim_space(text: Column | str) -> Column:
    """Strip Unicode white space at both ends (Spark's plain trim only strips U+0020)."""
    return F.trim(col(text), F.lit(UNICODE_SPACE))


def clean_text(text: Column | str) -> Column:
    """One line per paragraph: collapse white space, drop blank lines, join with an empty line between."""
    lines = F.transform(
        F.split(col(text), "\n"), lambda line: trim_space(F.regexp_replace(line, f"{ASCII_SPACE}+", " "))
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n\n")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(WORD))


def first_nonblank(*values: Column | str) -> Column:
    """First value that is not blank, trimmed; '' when all are blank."""
    trimmed = f"filter(transform(v, x -> {trim_sql('x')}), x -> x != '')"
    return let_sql(F.array(*[col(v) for v in values]), "v", f"coalesce(get({trimmed}, 0), '')")


def optional(text: Column | str) -> Column:
    """The empty string means NULL for optional fields."""
    return F.nullif(col(text), F.lit(""))


def content_hash(text: Column | str) -> Column:
    """Hex SHA-256 of the cleaned text."""
    return F.sha2(col(text), 256)


def article_gate(words: Column | str, title: Column | str, min_words: int = MIN_WORDS) -> Column:
    """NULL when the article passes; the word gate is tested before the title gate."""
    return (
        F.when(col(words) < min_words, F.lit("too_short"))
        .when(F.coalesce(trim_space(title), F.lit("")) == "", F.lit("no_title"))
        .otherwise(F.lit(None).cast("string"))
    )
