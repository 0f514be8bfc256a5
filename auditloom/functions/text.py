"""Scalar functions on texts, as Spark expressions. A null text gives null unless said otherwise."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.config import DEFAULT

# Role prefixes of captions.
ROLE_PREFIXES = ("Assistant:", "ASSISTANT:", "assistant:", "A:")
PROMPT = "Describe this image."


def words(text: Column | str) -> Column:
    """Whitespace-separated words, none empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def question(text: str) -> Column:
    return F.get(F.split(text, "\n", 2), F.lit(0))


def answer_or_empty(text: str) -> Column:
    """What follows the first newline, else the empty string."""
    return F.when(F.col(text).isNotNull(), F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit("")))


def answer_or_text(text: str) -> Column:
    """What follows the first newline, else the whole text."""
    return F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.col(text))


def first_words(text: Column | str, n: int) -> Column:
    """The first n words, one blank between."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def caption(text: str, n: int = DEFAULT.caption_words) -> Column:
    """The answer without blanks at its ends and without one role prefix, cut to n words."""
    stripped = F.regexp_replace(answer_or_text(text), r"^\s+|\s+$", "")
    return first_words(F.regexp_replace(stripped, "^(" + "|".join(ROLE_PREFIXES) + ")", ""), n)


def first_chars(text: Column | str, n: int = DEFAULT.clip_chars) -> Column:
    """P5: the first n characters."""
    return F.substring(text, 1, n)


def unique_ratio(text: Column | str) -> Column:
    """P10: distinct words over words; 0 without words."""
    w = words(text)
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).when(F.size(w) == 0, F.lit(0.0))


def record_length(*columns: str) -> Column:
    """Length of the record as JSON, nulls included."""
    return F.length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def joined_length(*columns: str) -> Column:
    """Length of the string fields joined by blanks, without blanks at the ends."""
    return F.length(F.trim(F.concat_ws(" ", *columns)))


def chat_prompt(text: str, own_question: bool = True) -> Column:
    """The prompt of a pair: its own question or the constant one, then the answer."""
    asked = question(text) if own_question else F.lit(PROMPT)
    return F.format_string("USER: <image>\n%s\nASSISTANT: %s", asked, answer_or_empty(text))


def guarded_ratio(a: Column, b: Column) -> Column:
    """A / (b + 1e-8)."""
    return a / (b + F.lit(DEFAULT.epsilon))


def cleaned(c: str) -> Column:
    """Null, NaN and infinite values as 0."""
    return F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(0.0)).otherwise(F.col(c))


def present(df, columns: list[str]) -> list[str]:
    """The columns that df has."""
    return [c for c in columns if c in df.columns]


def zlib_length(text: Column | str) -> Column:
    """Bytes of the zlib-compressed UTF-8 text (no built-in does this); null for null."""

    @F.pandas_udf("int")
    def length(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else len(zlib.compress(t.encode("utf-8", "surrogatepass")))).astype("Int32")

    return length(text)
