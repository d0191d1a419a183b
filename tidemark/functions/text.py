"""Text and array column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import to_column


def clean_text(c: Column | str, keep_commas: bool = False) -> Column:
    """Lower case, symbols to blanks, blanks squeezed, ends trimmed.

    Every run of symbols and white space becomes one blank, so a single pattern does both steps.
    The pattern lists the replaced characters as ranges, which Java matches several times faster
    than the negation of the kept ones (letters, digits, ``+``, ``#`` and perhaps the comma).
    """
    after_plus = "\\x2D-\\x2F" if keep_commas else "\\x2C-\\x2F"
    replaced = f"[\\x00-\\x22\\x24-\\x2A{after_plus}\\x3A-\\x60\\x7B-\\x{{10FFFF}}]+"
    return F.trim(F.regexp_replace(F.lower(to_column(c)), replaced, " "))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read without computing it again.

    A filter on a plain projected column is pushed below the projection together with a copy of
    the expression; it does not move below a generator.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def split_commas(c: Column | str) -> Column:
    return F.split(to_column(c), "\\s*,\\s*")


def count_non_blank(items: Column | str) -> Column:
    return F.size(F.filter(to_column(items), lambda x: F.trim(x) != ""))


def capture(c: Column | str, pattern: str) -> Column:
    """First regex group, null when there is no match."""
    return F.nullif(F.regexp_extract(to_column(c), pattern, 1), F.lit(""))


def spaced_title(c: Column | str) -> Column:
    """Dashes to blanks, lower case, trimmed; null becomes empty."""
    return F.trim(F.lower(F.replace(F.coalesce(to_column(c), F.lit("")), F.lit("-"), F.lit(" "))))


def join_text(*parts: Column | str) -> Column:
    """Parts joined by one blank with null as empty text, ends trimmed."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(to_column(p), F.lit("")) for p in parts]))


def normal_code(c: Column | str, default: str = "UNKNOWN") -> Column:
    return F.trim(F.upper(F.coalesce(to_column(c), F.lit(default))))


def escape_literal(phrase: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else f"\\{ch}" for ch in phrase)


def phrase_pattern(phrases: Iterable[str], word_boundary: bool = False) -> str:
    """Alternation of literal phrases, longest first, equal lengths in alphabetical order."""
    ordered = sorted(set(phrases), key=lambda p: (-len(p), p))
    body = "|".join(escape_literal(p) for p in ordered)
    return f"\\b(?:{body})\\b" if word_boundary else body


def contains_any(c: Column | str, phrases: Iterable[str], word_boundary: bool = False) -> Column:
    return F.coalesce(
        to_column(c).rlike(phrase_pattern(phrases, word_boundary)), F.lit(False)
    )


def count_phrases(
    c: Column | str,
    phrases: Iterable[str],
    word_boundary: bool = False,
    lowered: bool = False,
) -> Column:
    """Number of non-overlapping matches, ignoring case; ``lowered`` says that the text has no
    upper case, so lower-case phrases match it directly."""
    if lowered:
        pattern = phrase_pattern({p.lower() for p in phrases}, word_boundary)
    else:
        pattern = f"(?i){phrase_pattern(phrases, word_boundary)}"
    return F.regexp_count(to_column(c), F.lit(pattern))


def words_in(words: Column | str, phrases: Iterable[str]) -> Column:
    """The words that are phrases of a category."""
    return F.array_intersect(to_column(words), F.array(*[F.lit(p) for p in sorted(set(phrases))]))


def category_tag(names: Column | str, default: str) -> Column:
    """Category names joined by ``+``; the default when there are none."""
    names = to_column(names)
    return F.when(F.size(names) > 0, F.concat_ws("+", names)).otherwise(F.lit(default))


def word_tokens(clean: Column | str, min_length: int = 2) -> Column:
    """Word tokens of cleaned text without the short ones."""
    words = F.split(to_column(clean), "[ +#,]+")
    return F.filter(words, lambda w: F.length(w) >= min_length)


def run_starts(items: Column) -> Column:
    """Positions in a sorted array at which a new value begins."""
    marked = F.transform(
        items,
        lambda x, i: F.when((i == 0) | (x != F.get(items, i - 1)), i).otherwise(F.lit(-1)),
    )
    return F.filter(marked, lambda p: p >= 0)


def run_counts(items: Column, starts: Column) -> Column:
    """Every distinct value of a sorted array with its count."""
    return F.transform(
        starts,
        lambda s, i: F.struct(
            F.get(items, s).alias("term"),
            (F.coalesce(F.get(starts, i + 1), F.size(items)) - s).alias("tf"),
        ),
    )
