"""Functions on method names: subwords, n-grams, overlaps, characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a subword ends before an upper-case letter that follows a lower-case
# one, before the last capital of an acronym, or at the end of the name. (?d) makes
# only \n a line end.
SUBWORD = "(?d).+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$)"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def split_camel_case(name: Column | str) -> Column:
    """Lower-cased subwords of a camelCase name."""
    return F.transform(
        F.regexp_extract_all(_col(name), F.lit(SUBWORD), F.lit(0)), F.lower
    )


def spaced_name(name: Column | str) -> Column:
    """Subwords joined by spaces."""
    return F.array_join(split_camel_case(name), " ")


def ngrams(words: Column | str, n: int) -> Column:
    """Runs of ``n`` consecutive words; empty when there are fewer words."""
    words = _col(words)
    # sequence() counts downwards when its end is below its start, hence the guard
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    grams = F.transform(starts, lambda i: F.slice(words, i, n))
    return F.when(F.size(words) >= n, grams).otherwise(F.slice(F.array(words), 1, 0))


def multiset_overlap(left: Column | str, right: Column | str) -> Column:
    """Size of the multiset intersection of two arrays.

    Pass columns that already exist: an expression would be evaluated once per item.
    """
    left, right = _col(left), _col(right)

    def times(array: Column, item: Column) -> Column:
        return F.size(F.filter(array, lambda other: other == item))

    return F.aggregate(
        F.array_intersect(left, right),
        F.lit(0),
        lambda total, item: total + F.least(times(left, item), times(right, item)),
    )


def levenshtein(left: Column | str, right: Column | str) -> Column:
    """Case-sensitive edit distance in code points."""
    return F.levenshtein(_col(left), _col(right))


def char_tokens(text: Column | str) -> Column:
    """Lower-cased letters and digits, one token each."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]"), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
