"""Scalar text functions whose exact results matter, one definition each."""

from __future__ import annotations

import re
import unicodedata
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions import fixed_values as fixed

if TYPE_CHECKING:
    from collections.abc import Mapping

# Unicode white space plus the four ASCII separators U+001C-U+001F.
_SPACE = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)^{_SPACE}+|{_SPACE}+\z"
_WORD_BREAK = r"[^\p{L}\p{N}]+"
# Everything a Python string literal shows as an escape, besides quotes and backslash.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (Spark's `trim` removes spaces only)."""
    return F.regexp_replace(text, _STRIP, "")


def round_half_even(number: Column, digits: int = 2) -> Column:
    """Round half to even on the scaled double."""
    scale = float(10**digits)
    return F.rint(number * F.lit(scale)) / F.lit(scale)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), _WORD_BREAK), lambda t: t != "")


def file_type(url: Column) -> Column:
    """The text after the last dot of the last path segment; the whole segment if it has no dot."""
    return F.element_at(F.split(F.element_at(F.split(url, "/"), -1), "[.]"), -1)


def target_file_name(name: Column, url: Column) -> Column:
    """The name without slashes, plus the type of the URL."""
    return F.concat(F.replace(name, F.lit("/"), F.lit("")), F.lit("."), file_type(url))


def clean_document_name(name: Column) -> Column:
    """Strip the file suffix, then every noise phrase, then white space, in this order."""
    no_suffix = F.regexp_replace(name, fixed.NAME_SUFFIX_PATTERN, "")
    return strip(F.replace(no_suffix, F.lit(fixed.NAME_NOISE), F.lit("")))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC. Spark has no built-in for it; ASCII strings come back untouched."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def parse_score(reply: Column) -> Column:
    """A judge's reply as an int between 1 and 10, else null."""
    stripped = strip(reply)
    digits = F.when(stripped.rlike(r"^[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(stripped, F.lit("_"), F.lit("")))
    number = digits.try_cast("int")
    return F.when(number.between(fixed.SCORE_MIN, fixed.SCORE_MAX), number)


def parse_score_strict(reply: Column) -> Column:
    """As `parse_score`, but a bad reply fails the job and shows the reply."""
    score = parse_score(reply)
    message = F.concat(F.lit(fixed.SCORE_ERROR), F.coalesce(strip(reply), F.lit("None")), F.lit("'"))
    return F.when(score.isNotNull(), score).otherwise(F.raise_error(message).cast("int"))


def _escape_character(char: Column) -> Column:
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    short = F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))
    medium = F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))
    long = F.concat(F.lit("\\U"), F.lpad(digits, 8, "0"))
    escaped = F.when(code <= 0xFF, short).when(code <= 0xFFFF, medium).otherwise(long)
    return F.when(char.rlike(_UNPRINTABLE), escaped).otherwise(char)


def python_literal(text: Column) -> Column:
    """The text as a Python string literal, as it prints inside a list or dict."""
    body = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    # Character by character only for the few texts that need it.
    body = F.when(
        body.rlike(_UNPRINTABLE), F.array_join(F.transform(F.split(body, ""), _escape_character), "")
    ).otherwise(body)
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single_quoted = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    quoted = F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single_quoted)
    return F.coalesce(quoted, F.lit("None"))


def python_list(texts: Column) -> Column:
    """An array of strings as a Python list prints it."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, python_literal), ", "), F.lit("]"))


def python_dict(entries: Column) -> Column:
    """The entries of a map of strings (`map_entries`) as a Python dict prints them."""
    shown = F.transform(
        entries,
        lambda e: F.concat(python_literal(e["key"]), F.lit(": "), python_literal(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenate a template's text with columns in place of its `{name}` marks."""
    parts = re.split(r"\{(\w+)\}", template)
    columns = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*columns)
