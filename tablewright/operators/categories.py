"""Standard values for truth words, countries, cities, regions and genders.

A value is standardised where it lies, by an expression of its column; what a
column holds is decided from its distinct values.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted, text_columns
from .profile import boolean_like
from .roles import column_operations

UNKNOWN = "Unknown"
# Fixed values.
EMPTY_WORDS = ["", "none", "null", "na", "n/a", "unknown"]
YES = ["yes", "y", "ye", "true", "t", "1"]
NO = ["no", "n", "false", "f", "0"]
COUNTRY_NAMES = {
    "india": "India", "ind": "India", "in": "India", "idnia": "India", "indai": "India",
    "uae": "United Arab Emirates", "unitedarabemirates": "United Arab Emirates", "arab": "United Arab Emirates",
    "singapore": "Singapore", "singapor": "Singapore", "uk": "United Kingdom", "us": "United States", "usa": "United States",
    "bangladesh": "Bangladesh", "bangladsh": "Bangladesh", "bd": "Bangladesh", "russia": "Russia", "russina": "Russia",
    "canada": "Canada", "canad": "Canada", "china": "China", "japan": "Japan", "germany": "Germany", "france": "France",
    "australia": "Australia",
}
COUNTRIES = ["India", "United Arab Emirates", "Singapore", "United Kingdom", "United States", "Bangladesh", "Russia", "Canada"]
CITY_NAMES = {
    "new delhi": "New Delhi", "delhi": "Delhi", "newdelhi": "New Delhi", "mumbai": "Mumbai", "bombay": "Mumbai",
    "kolkata": "Kolkata", "calcutta": "Kolkata", "gurgaon": "Gurgaon", "gurugram": "Gurgaon", "bangalore": "Bangalore",
    "bengaluru": "Bangalore", "hyderabad": "Hyderabad", "chennai": "Chennai", "madras": "Chennai", "pune": "Pune",
    "noida": "Noida", "faridabad": "Faridabad", "jaipur": "Jaipur", "ahmedabad": "Ahmedabad", "dubai": "Dubai",
    "abu dhabi": "Abu Dhabi", "abudhabi": "Abu Dhabi", "london": "London", "singapore": "Singapore", "dhaka": "Dhaka",
    "moscow": "Moscow", "new york": "New York", "newyork": "New York", "nyc": "New York", "toronto": "Toronto",
}
REGION_NAMES = {
    "asia": "Asia", "asia pacific": "Asia", "apac": "Asia", "ncr": "NCR", "middle east": "Middle East",
    "middleeast": "Middle East", "eu": "Europe", "europe": "Europe", "north america": "North America",
    "northamerica": "North America", "south america": "South America", "southamerica": "South America", "africa": "Africa",
    "oceania": "Oceania",
}
GENDER_NAMES = {
    "m": "Male", "male": "Male", "malee": "Male", "mlae": "Male", "mal": "Male", "f": "Female", "female": "Female",
    "femalee": "Female", "femle": "Female", "femaile": "Female", "t": "Transgender", "transgender": "Transgender",
    "trans": "Transgender",
}
GENDERS = ["Male", "Female", "Transgender", "Non-binary", "Other", "Unknown"]
GENDER_MORE = ["nb", "nonbinary", "non-binary", "non binary"]


def lookup(value: Column, names: Mapping[str, str]) -> Column:
    """Name for an alias, null for an unknown one."""
    pairs = [F.lit(part) for pair in names.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def fuzzy(token: Column, names: Mapping[str, str], canonical: Sequence[str], most: int = 2) -> Column:
    """Alias hit, else the one canonical name nearest by edit distance, at
    most ``most`` away.  Two names equally near match nothing."""
    bare = [re.sub(r"[^a-z0-9]", "", c.lower()) for c in canonical]
    near = F.transform(F.array(*[F.lit(b) for b in bare]), lambda b: F.levenshtein(token, b))
    least = F.array_min(near)
    unique = F.size(F.filter(near, lambda d: d == least)) == 1
    nearest = F.when((least <= most) & unique, F.get(F.array(*[F.lit(c) for c in canonical]), F.array_position(near, least).cast("int") - 1))
    return F.when(token != "", F.coalesce(lookup(token, names), nearest))


def _words(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text.cast("string"), F.lit(""))))


def _token(text: Column) -> Column:
    return F.regexp_replace(_words(text), r"[^a-z0-9]+", "")


def _titled(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(_words(text), r"\s+", " ")))


def truth_word(text: Column) -> Column:
    low = _words(text)
    # A repeated last letter is a typing slip: "yess", "nooo".
    short = F.regexp_replace(low, r"(.)\1+$", "$1")
    return F.when(low.isin(YES) | short.isin(YES), "Yes").when(low.isin(NO) | short.isin(NO), "No").otherwise(UNKNOWN)


def country(text: Column) -> Column:
    known = fuzzy(_token(text), COUNTRY_NAMES, COUNTRIES)
    return F.coalesce(known, F.when(_words(text).isin(EMPTY_WORDS), UNKNOWN).otherwise(_titled(text)))


def _aliased(names: Mapping[str, str]):
    def standard(text: Column) -> Column:
        key = F.trim(F.regexp_replace(_words(text), r"\s+", " "))
        return F.coalesce(lookup(key, names), F.when(key.isin(EMPTY_WORDS), UNKNOWN).otherwise(F.initcap(key)))

    return standard


def gender(text: Column) -> Column:
    known = fuzzy(_token(text), GENDER_NAMES, GENDERS)
    return F.coalesce(known, F.when(_words(text).isin(GENDER_MORE), "Non-binary").otherwise(UNKNOWN))


def title_text(text: Column) -> Column:
    low = _titled(text)
    return F.when(low == "", UNKNOWN).otherwise(low)


KINDS = {
    "boolean": truth_word, "country": country, "city": _aliased(CITY_NAMES), "region": _aliased(REGION_NAMES),
    "gender": gender, "text": title_text,
}


# Headers of each kind: the whole, a beginning, an end, a part.
KIND_HEADERS = {
    "boolean": (["bool", "boolean", "flag", "binary", "binaryflag", "boolcolumn"], ("is", "has"), ("flag",), []),
    "country": (["nation"], (), (), ["country"]),
    "city": (["town"], (), (), ["city"]),
    "region": (["area", "zone", "territory"], (), (), ["region"]),
    "gender": (["sex"], (), (), ["gender"]),
}


def kind_of_column(name: str, boolean_like: bool = False) -> str:
    """Which standardiser a column gets, by its header (or its values)."""
    low = re.sub(r"[^a-z0-9]", "", name.lower())
    kinds = [kind for kind, (equal, begin, end, part) in KIND_HEADERS.items()
             if low in equal or low.startswith(begin or ("\0",)) or low.endswith(end or ("\0",)) or any(p in low for p in part)]
    return "boolean" if boolean_like else (kinds or ["text"])[0]


def value_mapping(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(column, source, target, n): each distinct value with its standard."""
    result = None
    for name, kind in columns.items():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; there are {list(KINDS)}")
        distinct = df.groupBy(quoted(name).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
        part = distinct.select(F.lit(name).alias("column"), "source", KINDS[kind](F.col("source")).alias("target"), "n")
        result = part if result is None else result.unionByName(part)
    return result


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, new_column: str, fallback: str = "Other") -> DataFrame:
    """Label of each value from a (source, target) table.  A null value is
    looked up as the empty text; an unmapped one gets the fallback."""
    table = mapping.select(F.coalesce("source", F.lit("")).alias("__source"), F.col("target").alias("__target")).dropDuplicates(["__source"])
    key = F.coalesce(quoted(column).cast("string"), F.lit(""))
    joined = df.join(table, key == F.col("__source"), "left")
    return joined.withColumn(new_column, F.coalesce("__target", F.lit(fallback))).drop("__source", "__target")


def standardise(df: DataFrame, columns: Mapping[str, str], suffix: str = "_standard") -> DataFrame:
    """Add the standard value of each column, in the order given: a projection,
    without grouping or join.  ``value_mapping`` shows the values for a report."""
    for name, kind in columns.items():
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; there are {list(KINDS)}")
        value = quoted(name).cast("string")
        # A gap is looked up as the empty text.
        df = df.withColumn(f"{name}{suffix}", F.when(value.isNull(), UNKNOWN).otherwise(F.coalesce(KINDS[kind](value), F.lit(UNKNOWN))))
    return df


def categorise(df: DataFrame, columns: Sequence[str], request: str = "", suffix: str = "_standard") -> tuple[DataFrame, DataFrame]:
    """Standardise the columns which allow it and leave the others alone:
    (table, status).  Status rows are (column, operation, status)."""
    known = {r["column"]: r["operation"] for r in column_operations(df.select(*[quoted(c) for c in columns if c in df.columns]), request).collect()}
    truths = {r["column"] for r in boolean_like(df, [c for c in columns if c in text_columns(df)]).filter("boolean_like").collect()} if known else set()
    rows = []
    for c in columns:
        operation = known.get(c, "unknown")
        allowed = operation == "categorical_normalization"
        rows.append((c, operation, "done" if allowed else "missing" if c not in known else "protected"))
        if allowed:
            df = standardise(df, {c: kind_of_column(c, c in truths)}, suffix)
    return df, df.sparkSession.createDataFrame(rows, "column string, operation string, status string")
