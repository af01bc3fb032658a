"""Text to number, time and truth value, without ANSI errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs which only look like content.
INVISIBLE = " ​‌‍﻿­⁠"
BLANK = rf"^[\s{INVISIBLE}]*$"

# Spellings of the two truth values.
TRUE_WORDS = ["yes", "y", "true", "1", "available", "open", "on", "enabled"]
FALSE_WORDS = ["no", "n", "false", "0", "not available", "closed", "off", "disabled"]

# Date formats after the ISO cast, by the shape of the text; first match wins.
DATE_SHAPES = {
    r"^\d{1,2}/\d{1,2}/\d{4}$": ["MM/dd/yyyy", "dd/MM/yyyy"],
    r"^\d{1,2}/\d{1,2}/\d{4} ": ["MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss"],
    r"^\d{4}/": ["yyyy/MM/dd"],
    r"^\d{1,2}-\d{1,2}-\d{4}$": ["dd-MM-yyyy"],
    r"^\d{1,2} [A-Za-z]{3} \d{4}$": ["d MMM yyyy"],
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$": ["MMM d, yyyy"],
    r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$": ["MMMM d, yyyy"],
}

# Texts which may be read as a whole number or a double; a failed parse is
# slow, so others are not tried.
WHOLE_SHAPE = r"^\W*\d+\W*$"
NUMBER_SHAPE = r"(?is)^[\x00-\x20]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?[df]?[\x00-\x20]*$|0x|inf|nan)"
# The beginnings of all shapes above and of ISO text.
DATE_START = r"^(?:\d{4}[-/]|\d{1,2}[-/ ]|[A-Za-z]{3,9} \d)"


def whole(value: Column) -> Column:
    """The bigint which ``try_cast`` makes of text."""
    return F.when(value.rlike(WHOLE_SHAPE), value.try_cast("bigint"))


def double(value: Column) -> Column:
    """The double which ``try_cast`` makes of text."""
    return F.when(value.rlike(NUMBER_SHAPE), value.try_cast("double"))


def number(value: Column, kind: T.DataType | None = None) -> Column:
    """Double or null; NaN and the infinities count as missing."""
    if kind is not None and isinstance(kind, T.NumericType) and not isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.cast("double")
    as_double = value.try_cast("double")
    return F.when(~as_double.isin(float("nan"), float("inf"), float("-inf")), as_double)


def timestamp(value: Column, kind: T.DataType | None = None, shapes=DATE_SHAPES) -> Column:
    """Timestamp or null, over ISO text and the known formats.  A format is
    tried only on text of its shape, since a failed parse is slow."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(kind, T.NumericType):
        return F.lit(None).cast("timestamp")
    text = F.trim(value.cast("string"))
    # A bare number such as "2024" is not taken for a date.
    parsed = F.when(text.rlike(r"^\d{4}-\d"), text.try_cast("timestamp"))
    for shape, formats in shapes.items():
        parsed = parsed.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))
    return F.when(text.rlike(DATE_START), parsed) if shapes is DATE_SHAPES else parsed


def truth(value: Column) -> Column:
    """True, false, or null for a word outside the vocabulary."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(BLANK)


def is_missing(value: Column, kind: T.DataType) -> Column:
    """Null, NaN or whitespace text."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (F.trim(value) == "") | value.rlike(r"^\s*$")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def squeezed(value: Column) -> Column:
    """Trim, drop zero-width signs, one blank between words."""
    visible = F.regexp_replace(value, "[​‌‍﻿­⁠]", "")
    return F.trim(F.regexp_replace(visible, "[\\s ]+", " "))
