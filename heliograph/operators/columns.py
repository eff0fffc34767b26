"""Column subsets, names and types of catalogue frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of types as users of dataframe libraries write them.
TYPES = {"unicode": "string", "str": "string", "object": "string", "f8": "double", "float64": "double", "float": "double", "f4": "float", "float32": "float", "i8": "bigint", "int64": "bigint", "int": "bigint", "i4": "int", "int32": "int", "i2": "smallint", "int16": "smallint", "bool": "boolean"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(df: DataFrame, key: int | str) -> str:
    """A column's name from a name or a position."""
    if isinstance(key, int) and not isinstance(key, bool):
        if not 0 <= key < len(df.columns):
            raise ValueError(f"there is no column {key}")
        return df.columns[key]
    if key not in df.columns:
        raise ValueError(f"there is no column {key!r}")
    return key


def with_mandatory(columns: list[str] | None, mandatory: list[str]) -> list[str] | None:
    """The wanted columns and those that must be there, in that order; None (all) for none or an empty list."""
    return [*columns, *[m for m in mandatory if m not in columns]] if columns else None


def cast(df: DataFrame, dtypes: dict[str, str] | None) -> DataFrame:
    return df.withColumns({c: F.col(quoted(c)).cast(TYPES.get(t, t)) for c, t in (dtypes or {}).items() if resolve(df, c)}) if dtypes else df


def prefixed(df: DataFrame, name: str, delim: str = ".") -> DataFrame:
    return df.toDF(*[f"{name}{delim}{c}" for c in df.columns])


def prefixed_keys(keys: dict[str, str], name: str, delim: str = ".") -> dict[str, str]:
    return {k: f"{name}{delim}{v}" for k, v in keys.items()}
