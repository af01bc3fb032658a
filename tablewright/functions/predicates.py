"""Filter conditions as Column expressions.

Three families treat missing values differently, as their users expect:

* ``plan_condition``     SQL meaning: a comparison with null drops the row.
* ``cleaning_condition`` keeps a row under ``not_equals`` when its value is
  missing or not a number.
* ``role_condition``     knows truth-value columns; an unknown word is false.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted, resolve
from .parsing import FALSE_WORDS, TRUE_WORDS, number, truth

COMPARISONS = {
    "equals": lambda a, b: a == b,
    "not_equals": lambda a, b: a != b,
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "greater_than_equal": lambda a, b: a >= b,
    "less_than_equal": lambda a, b: a <= b,
}
AVERAGES = {"above_average": "greater_than", "below_average": "less_than"}


def as_number(value) -> float | None:
    """The value as a finite number, if its text reads as one."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        found = float(str(value))
    except ValueError:
        return None
    return found if math.isfinite(found) else None


def literal_for(value, kind: T.DataType) -> Column:
    """Literal typed by the column, so that the comparison pushes down."""
    if value is None:
        return F.lit(None).cast(kind)
    numeric = as_number(value)
    if isinstance(kind, T.IntegralType) and numeric is not None and numeric == int(numeric):
        return F.lit(int(numeric)).cast("long")
    if isinstance(kind, T.NumericType):
        if numeric is None:
            raise ValueError(f"{value!r} is not a number")
        return F.lit(numeric)
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    return F.lit(str(value)).cast(kind)


def compare(column: Column, kind: T.DataType, operator: str, value) -> Column:
    if operator not in COMPARISONS:
        raise ValueError(f"unsupported comparison {operator!r}")
    # Text equals text; only an order asked for a number reads text as numbers.
    if isinstance(kind, T.StringType) and operator not in ("equals", "not_equals") and as_number(value) is not None:
        return COMPARISONS[operator](number(column), F.lit(as_number(value)))
    return COMPARISONS[operator](column, literal_for(value, kind))


def plan_condition(df: DataFrame, condition: dict) -> Column:
    """One plan filter.  ``above_average``/``below_average`` compare with the
    mean of ``df`` itself, so pass the table before any other filter."""
    name = resolve(condition.get("column"), df.columns)
    column, kind = quoted(name), df.schema[name].dataType
    operator, value = condition.get("operator"), condition.get("value")
    if operator == "contains":
        return F.contains(F.lower(column.cast("string")), F.lower(F.lit(str(value))))
    if operator == "between":
        return compare(column, kind, "greater_than_equal", value) & compare(
            column, kind, "less_than_equal", condition.get("value2")
        )
    if operator in AVERAGES:
        # An uncorrelated scalar subquery: one partial aggregate, no join.
        mean = df.select(F.avg(column)).scalar()
        return COMPARISONS[AVERAGES[operator]](column, mean)
    return compare(column, kind, operator, value)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def cleaning_condition(df: DataFrame, name: str, operator: str, value=None) -> Column:
    name = resolve(name, df.columns)
    column, kind = quoted(name), df.schema[name].dataType
    if operator == "is_null":
        return column.isNull()
    if operator == "not_null":
        return column.isNotNull()
    if operator == "contains":
        return F.coalesce(F.contains(F.lower(column.cast("string")), F.lit(str(value).lower())), F.lit(False))
    if operator not in COMPARISONS:
        raise ValueError(f"unsupported filter {operator!r}")
    numeric = as_number(value)
    if numeric is not None:
        left, right = number(column, kind), F.lit(numeric)
    else:
        left, right = column.cast("string"), F.lit(str(value))
    return F.coalesce(COMPARISONS[operator](left, right), F.lit(operator == "not_equals"))


BOOLEAN_ROLES = {"boolean_capability", "delivery_capability", "table_booking_capability"}


def truth_of(value) -> bool:
    """A condition's truth value, also from its word."""
    word = str(value).strip().lower()
    if isinstance(value, (bool, int, float)):
        return bool(value)
    if word in TRUE_WORDS or word in FALSE_WORDS:
        return word in TRUE_WORDS
    raise ValueError(f"{value!r} is no truth value")


def role_condition(df: DataFrame, role: str, condition: dict) -> Column:
    name = resolve(condition["column"], df.columns)
    column, kind = quoted(name), df.schema[name].dataType
    operator, value, value2 = condition["operator"], condition.get("value"), condition.get("value2")
    if operator in ("equals", "not_equals"):
        if role in BOOLEAN_ROLES:
            hit = F.coalesce(truth(column), F.lit(False)) == F.lit(truth_of(value))
        else:
            hit = F.coalesce(compare(column, kind, "equals", value), F.lit(False))
        return hit if operator == "equals" else ~hit
    text = column.cast("string")
    missing_false = lambda c: F.coalesce(c, F.lit(False))
    if operator == "contains":
        return missing_false(F.contains(F.lower(text), F.lit(str(value).lower())))
    if operator == "starts_with":
        return missing_false(F.startswith(text, F.lit(str(value))))
    if operator == "ends_with":
        return missing_false(F.endswith(text, F.lit(str(value))))
    if operator == "is_null":
        return column.isNull()
    if operator == "is_not_null":
        return column.isNotNull()
    low = F.lit(float(value))
    if operator == "between":
        return missing_false(number(column, kind).between(low, F.lit(float(value2))))
    return missing_false(COMPARISONS[operator](number(column, kind), low))


def folded_condition(df: DataFrame, condition: dict) -> Column:
    """Case-folded equals, and gt/lt/gte/lte on numbers."""
    name = resolve(condition["column"], df.columns)
    column, value = quoted(name), condition["value"]
    operator = condition["operator"]
    if operator in ("eq", "equals"):
        return F.lower(column.cast("string")) == F.lit(str(value).lower())
    short = {"gt": "greater_than", "lt": "less_than", "gte": "greater_than_equal", "lte": "less_than_equal"}
    if operator not in short:
        raise ValueError(f"unsupported operator {operator!r}")
    return COMPARISONS[short[operator]](number(column, df.schema[name].dataType), F.lit(float(value)))
