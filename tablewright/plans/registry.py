"""Named transformations ``(DataFrame, params) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.names import resolve_all
from ..operators import binning, cleaning, projection


@dataclass(frozen=True)
class Transformation:
    name: str
    apply: Callable[[DataFrame, dict], DataFrame]
    required: tuple[str, ...] = ()

    def validate(self, df: DataFrame, params: dict) -> None:
        """Checks on names and parameters only; starts no job."""
        absent = [p for p in self.required if params.get(p) in (None, "", [], {})]
        if absent:
            raise ValueError(f"{self.name} needs {absent}")
        named = params.get("column")
        if named is not None and named not in df.columns:
            raise ValueError(f"no such column: {named!r}")

    def preview(self, df: DataFrame, params: dict, rows: int = 10) -> DataFrame:
        self.validate(df, params)
        return self.apply(df.limit(rows), params)


class Registry:
    def __init__(self) -> None:
        self._entries: dict[str, Transformation] = {}

    def register(self, entry: Transformation) -> Transformation:
        if entry.name in self._entries:
            raise ValueError(f"{entry.name!r} is registered already")
        self._entries[entry.name] = entry
        return entry

    def get(self, name: str) -> Transformation:
        if name not in self._entries:
            raise KeyError(f"unknown transformation {name!r}; there are {sorted(self._entries)}")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)

    def run(self, df: DataFrame, name: str, params: dict) -> DataFrame:
        entry = self.get(name)
        entry.validate(df, params)
        return entry.apply(df, params)

    def replay(self, df: DataFrame, recorded: list[tuple[str, dict]], up_to: int | None = None) -> DataFrame:
        """Apply a recorded list of (name, params) to a new table."""
        for name, params in recorded[:up_to]:
            df = self.run(df, name, params)
        return df


TRANSFORMATIONS = Registry()
for _entry in (
    Transformation("rename_columns", lambda d, p: projection.rename_columns(d, p["mapping"]), ("mapping",)),
    Transformation("drop_columns", lambda d, p: projection.drop_columns(d, p["columns"]), ("columns",)),
    Transformation(
        "merge_columns",
        lambda d, p: projection.merge_columns(d, p["columns"], p.get("separator", " "), p.get("new_column")),
        ("columns",),
    ),
    Transformation("split_column", lambda d, p: projection.split_column(d, p["column"], p["delimiter"]), ("column", "delimiter")),
    Transformation(
        "type_conversion", lambda d, p: projection.convert_type(d, p["column"], p["target_type"]), ("column", "target_type")
    ),
    Transformation("date_features", lambda d, p: binning.date_features(d, p["column"], p["features"]), ("column", "features")),
    Transformation(
        "remove_duplicates",
        lambda d, p: cleaning.remove_duplicates(
            d, resolve_all(p["subset"], d.columns) if p.get("subset") else None, p.get("keep", "first"), p.get("order_by")
        ),
    ),
    Transformation(
        "range_binning",
        lambda d, p: binning.bin_column(d, p["source_column"], p.get("ranges"), p.get("new_column")),
        ("source_column",),
    ),
):
    TRANSFORMATIONS.register(_entry)
