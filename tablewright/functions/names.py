"""Column names: lookup, cleaning, aliases and schema comparison.

Everything here works on names and schemas only; no job is started.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownColumn(ValueError):
    """A request names a column the table does not have."""


def resolve(name: str, columns: Sequence[str]) -> str:
    """Real column for a requested name: equal ignoring case, else the first
    column which contains it or is contained in it."""
    wanted = str(name or "").strip().lower()
    if not wanted:
        raise UnknownColumn("an empty column name was given")
    exact = next((c for c in columns if c.lower() == wanted), None)
    if exact is not None:
        return exact
    loose = next((c for c in columns if wanted in c.lower() or c.lower() in wanted), None)
    if loose is None:
        raise UnknownColumn(f"no column matches {name!r}; the table has {list(columns)}")
    return loose


def resolve_all(names: Iterable[str], columns: Sequence[str]) -> list[str]:
    return [resolve(n, columns) for n in names]


def quoted(name: str):
    """Column by exact name, also when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def alias_of(text: str) -> str:
    """Output name of a metric or derived column."""
    return re.sub(r"\W+", "_", text.strip().lower()).strip("_")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Blank headers become ``Unnamed_i``; a repeat gets ``_2``, ``_3`` …"""
    seen: dict[str, int] = {}
    out = []
    for position, raw in enumerate(names, start=1):
        base = str(raw).strip() if raw is not None and str(raw).strip() else f"Unnamed_{position}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def standard_name(name: str) -> str:
    """Lower case, blanks and hyphens to ``_``, other signs dropped."""
    text = re.sub(r"[\s\-]+", "_", str(name).strip().lower())
    text = re.sub(r"[^a-z0-9_]", "", text)
    return re.sub(r"_+", "_", text).strip("_")


def header_name(name: str, case: str | None = "lower", trim: bool = True, blank: str | None = "_") -> str:
    text = str(name).strip() if trim else str(name)
    if case not in (None, "lower", "upper", "title"):
        raise ValueError(f"unknown header case {case!r}")
    if case:
        text = getattr(text, case)()
    return re.sub(r"\s+", lambda _: blank, text) if blank is not None else text


def numbered_aliases(columns: Sequence[str], prefix: str = "FIELD_", width: int = 2) -> dict[str, str]:
    """Positional stand-ins for real column names, real name → alias."""
    return {c: f"{prefix}{i:0{width}d}" if width else f"{prefix}{i}" for i, c in enumerate(columns, start=1)}


def anonymise_columns(df: DataFrame, prefix: str = "FIELD_", width: int = 2) -> tuple[DataFrame, dict[str, str]]:
    """Table under positional names and the map back to the real names."""
    aliases = numbered_aliases(df.columns, prefix, width)
    return df.toDF(*aliases.values()), {alias: real for real, alias in aliases.items()}


def restore_names(value, real_names: dict[str, str]):
    """Replace aliases by real names in every string of a plan."""
    if isinstance(value, dict):
        return {k: restore_names(v, real_names) for k, v in value.items()}
    if isinstance(value, list):
        return [restore_names(v, real_names) for v in value]
    return real_names.get(value, value) if isinstance(value, str) else value


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 over (name, type) pairs, whatever their order and case."""
    return columns_fingerprint(df.dtypes)


def columns_fingerprint(columns: Sequence[tuple[str, str]]) -> str:
    pairs = sorted(f"{name.strip().lower()}:{kind.lower()}" for name, kind in columns)
    return hashlib.sha256("|".join(pairs).encode()).hexdigest()


def schema_changes(spark: SparkSession, before: T.StructType, after: T.StructType) -> DataFrame:
    """One row per column which was added, removed or changed its type."""
    old = {f.name: f.dataType.simpleString() for f in before}
    new = {f.name: f.dataType.simpleString() for f in after}
    rows = [(c, "added", None, new[c]) for c in new if c not in old]
    rows += [(c, "removed", old[c], None) for c in old if c not in new]
    rows += [(c, "retyped", old[c], new[c]) for c in new if c in old and old[c] != new[c]]
    return spark.createDataFrame(rows, "column string, change string, type_before string, type_after string")


LOCATION_NAMES = {  # fixed values: header spellings of the place fields
    "city": ["city", "town", "municipality", "locality"],
    "country": ["country", "country_name", "nation"],
    "region": ["region", "state", "state_province", "province", "administrative_area", "state_name"],
    "latitude": ["latitude", "lat", "latitude_center", "lat_center", "y"],
    "longitude": ["longitude", "long", "lon", "longitude_center", "lng", "lon_center", "x"],
    "location_id": ["locationid", "location_id", "location id", "id"],
}


def location_columns(columns: Sequence[str]) -> dict[str, str]:
    """Which columns carry city, country, region, coordinates and place id.

    A spelling which equals the header (letters and digits only) wins over one
    of three letters or more which is part of it or holds it.
    """
    bare = {c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in columns}
    found = {}
    for part, listed in LOCATION_NAMES.items():
        spellings = [re.sub(r"[^a-z0-9]", "", s) for s in listed]
        equal = [c for s in spellings for c in reversed(columns) if bare[c] == s]
        partial = [c for c in columns if any(len(s) > 2 and bare[c] and (s in bare[c] or bare[c] in s) for s in spellings)]
        hit = (equal or partial or [None])[0]
        if hit is not None:
            found[part] = hit
    return found
