"""Functions on source text, list literals and generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NO_PREDICTION, NULL_TOKENS
from .names import split_camel_case

_LITERAL_JSON = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
}


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 where valid, else ISO-8859-1; line ends become ``\\n``.

    ISO-8859-1 accepts every byte, so no further encoding can ever be reached.
    """
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def null_tokens(df: DataFrame, cols: list[str], tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Replace the tokens that stand for a missing value by null."""
    if not tokens:
        return df
    return df.withColumns(
        {name: F.when(~F.col(name).isin(tokens), F.col(name)) for name in cols}
    )


def _unescape(match_letter: str, digits: int) -> str:
    # an escape counts only after an even number of backslashes
    return rf"(?<!\\)((?:\\\\)*)\\{match_letter}([0-9a-fA-F]{{{digits}}})"


def parse_list_literal(cell: Column) -> Column:
    """A printed list of strings (``['a', "b"]``) to ``array<string>``.

    The literal is read as lenient JSON. Two escapes JSON lacks are handled first:
    ``\\xNN`` becomes ``\\u00NN`` and ``\\UNNNNNNNN`` the character itself.
    """
    wide = _unescape("U", 8)
    hexes = F.regexp_extract_all(cell, F.lit(wide), F.lit(2))
    heads = F.regexp_extract_all(cell, F.lit(wide), F.lit(1))
    parts = F.split(cell, wide)
    glued = F.array_join(
        F.transform(
            F.arrays_zip(parts.alias("part"), heads.alias("head"), hexes.alias("hex")),
            lambda x: F.concat(
                x["part"],
                F.coalesce(x["head"], F.lit("")),
                F.coalesce(F.decode(F.unhex(x["hex"]), "UTF-32"), F.lit("")),
            ),
        ),
        "",
    )
    narrow = F.when(cell.contains("\\U"), glued).otherwise(cell)
    json = F.regexp_replace(narrow, _unescape("x", 2), r"$1\\u00$2")
    return F.from_json(json, T.ArrayType(T.StringType()), _LITERAL_JSON)


def render_list_literal(items: Column) -> Column:
    """``array<string>`` to the printed list form, with its quoting rules."""

    def escaped(item: Column) -> Column:
        plain = item
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            plain = F.replace(plain, F.lit(raw), F.lit(shown))
        coded = F.array_join(
            F.transform(
                F.split(plain, ""),
                lambda c: F.when(
                    c.rlike("[\\x00-\\x1f\\x7f-\\xa0\\xad]"),
                    F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0"))),
                ).otherwise(c),
            ),
            "",
        )
        return F.when(plain.rlike("[\\x00-\\x1f\\x7f-\\xa0\\xad]"), coded).otherwise(plain)

    def quoted(item: Column) -> Column:
        body = escaped(item)
        double = item.contains("'") & ~item.contains('"')
        single = F.replace(body, F.lit("'"), F.lit("\\'"))
        return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), single, F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def annotations(modifiers: Column) -> Column:
    return F.filter(modifiers, lambda m: m.startswith("@"))


def keywords(modifiers: Column) -> Column:
    return F.filter(modifiers, lambda m: ~m.startswith("@"))


def format_annotations(modifiers: Column) -> Column:
    """Annotations one per line, single quotes removed."""
    return F.replace(F.array_join(annotations(modifiers), "\n"), F.lit("'"), F.lit(""))


def format_keywords(modifiers: Column) -> Column:
    """Other modifiers on one line, single quotes and commas removed."""
    return F.regexp_replace(F.array_join(keywords(modifiers), " "), "[',]", "")


def strip_comments(code: Column) -> Column:
    """Remove block comments, then line comments together with their newline.

    Strings are not recognised: ``//`` inside one starts a comment. A line comment
    on a last line without newline stays.
    """
    without_blocks = F.regexp_replace(code, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(without_blocks, r"//[^\n]*\n", "")


def body_text(block: Column, missing_body: str = "nan") -> Column:
    """Body as text; a missing one reads ``nan`` (pass ``""`` to leave it empty)."""
    return F.coalesce(block, F.lit(missing_body))


def clean_generated_name(text: Column) -> Column:
    """Longest run of ASCII letters, the first of equals, else an empty string."""
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0))
    return F.aggregate(
        words,
        F.lit(""),
        lambda best, word: F.when(F.length(word) > F.length(best), word).otherwise(best),
    )


def rebuild_generated_name(text: Column) -> Column:
    """All different subwords of a generated text as one camelCase name, else an empty string.

    Models repeat words to fill their length; only the first of equal ones stays, in order.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0))
    words = F.array_distinct(F.flatten(F.transform(runs, split_camel_case)))
    return F.array_join(F.transform(
        words, lambda word, at: F.when(at == 0, word).otherwise(F.initcap(word))), "")


def fill_missing_prediction(name: Column) -> Column:
    """Blank or null names become the no-prediction marker."""
    blank = name.isNull() | name.rlike(r"^\s*$")
    return F.when(blank, F.lit(NO_PREDICTION)).otherwise(name)
