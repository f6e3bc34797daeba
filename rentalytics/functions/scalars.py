"""Scalar and aggregate column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentalytics import constants as C


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning -----------------------------------------------------------------
def rescale(c: str | Column, factor: float) -> Column:
    return _col(c) * F.lit(float(factor))


def map_bool(c: str | Column) -> Column:
    """Mixed truth texts to 1/0; anything else becomes null."""
    text = _col(c).cast("string")
    return (
        F.when(text.isin(*C.TRUE_TEXTS), F.lit(1)).when(text.isin(*C.FALSE_TEXTS), F.lit(0))
    )


def to_flag(c: str | Column) -> Column:
    """1/0 of a flag written as a number, a truth value or a text; anything else is null."""
    text = F.trim(_col(c).cast("string"))
    return F.coalesce(map_bool(text), F.lower(text).try_cast("boolean").cast("int"), to_number(text).cast("int"))


def flag_gt(c: str | Column, threshold: float) -> Column:
    """1 where the value exceeds the threshold, else 0 (also for null)."""
    return F.coalesce((_col(c) > F.lit(threshold)).cast("int"), F.lit(0))


def round_fill(c: str | Column, digits: int = 1, fill: float = 0.0) -> Column:
    """Round half to even, then fill nulls."""
    scale = float(10**digits)
    return F.coalesce(F.rint(_col(c) * F.lit(scale)) / F.lit(scale), F.lit(float(fill)))


def to_number(c: str | Column) -> Column:
    """Numeric value, or null where the text is no number. NaN counts as missing."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_pct(c: str | Column) -> Column:
    return to_number(F.replace(_col(c), F.lit("%"), F.lit("")))


def parse_date(c: str | Column, formats: Sequence[str] = C.DATE_FORMATS) -> Column:
    """Date of the first format that reads the text, month before day; a time of day is cut off.

    A text that no format reads gives null. ``T`` between date and time is a blank, and a
    zone or offset behind the time is not looked at: the date is the one written.
    """
    text = F.trim(_col(c).cast("string"))
    text = F.regexp_replace(text, r"(?<=\d)T(?=\d)", " ")
    text = F.regexp_replace(text, r"(?<=\d:\d\d)(:\d\d)?(?:\.\d+)?\s*(?:Z|UTC|[+-]\d\d:?\d\d)?$", "$1")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def contains_word(c: str | Column, word: str) -> Column:
    """1 where the text holds the word, ignoring case; null text gives 0."""
    return F.coalesce(F.lower(_col(c)).contains(word), F.lit(False)).cast("int")


# --- keys ---------------------------------------------------------------------
def key_text(c: str | Column) -> Column:
    """The text a value contributes to a key; missing values read ``nan``."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


def key_number(c: str | Column, kind: str | None = None) -> Column:
    """The text of a number or flag, the same from every type that can hold it.

    Whole numbers have no fraction, true and false (also as texts) are 1 and 0. ``kind``, the
    type's simple name, spares whole numbers, truth values and doubles the way through a text.
    """
    if kind in ("tinyint", "smallint", "int"):
        return key_text(c)
    if kind == "boolean":
        return key_text(_col(c).cast("int"))
    if kind == "double":
        value = _col(c)
        whole = F.when(F.abs(value) < 1e15, F.when(value == F.floor(value), value.cast("long").cast("string")))
        return F.coalesce(whole, value.cast("string"), F.lit("nan"))
    text = _col(c).cast("string")
    flag = F.when(F.lower(text) == "true", F.lit("1")).when(F.lower(text) == "false", F.lit("0"))
    value = text.try_cast("double")
    whole = F.when(F.abs(value) < 1e15, F.when(value == F.floor(value), value.try_cast("long").cast("string")))
    return F.coalesce(flag, whole, value.cast("string"), text, F.lit("nan"))


def hash_id(*cols: str | Column, hex_digits: int | None = None) -> Column:
    """MD5 of the joined values: all of it as text, or its leading hex digits as a number.

    Two different tuples share all 128 bits with a chance that no table size makes likely.
    Short keys are for readers that need numbers: ten digits are 40 bits and collide near
    certainly at ten million distinct tuples, fifteen at some hundred million.
    """
    digest = F.md5(F.concat_ws("_", *[key_text(c) for c in cols]))
    if hex_digits is None:
        return digest
    if not 1 <= hex_digits <= 15:
        raise ValueError("hex_digits must be between 1 and 15")
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")


# --- arithmetic ---------------------------------------------------------------
def difference(x: str | Column, base: str | Column) -> Column:
    return _col(x) - _col(base)


def percent_difference(x: str | Column, base: str | Column) -> Column:
    """Percent above the base; null where the base is 0 or null."""
    b = _col(base)
    return F.lit(100.0) * (_col(x) - b) / F.nullif(b, F.lit(0.0))


def flag_count(cols: Sequence[str] = C.AMENITIES) -> Column:
    """Number of set flags; null if any flag is null."""
    return reduce(add, [F.col(c).cast("int") for c in cols])


def weighted_score(weights: Mapping[str, float]) -> Column:
    return reduce(add, [F.col(c) * F.lit(w) for c, w in weights.items()])


def grid_cell(c: str | Column, size: float = C.GRID_DEGREES) -> Column:
    return F.round(_col(c) / F.lit(size), 0).cast("int")


# --- aggregates ---------------------------------------------------------------
def avg_if(condition: Column, x: str | Column) -> Column:
    return F.avg(F.when(condition, _col(x)))


def int_avg(c: str) -> Column:
    """Average of an integer column with the fraction cut off."""
    return F.expr(f"sum({c}) div count({c})")
