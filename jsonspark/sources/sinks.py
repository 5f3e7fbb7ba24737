"""Outputs: local frames from a DataFrame, and files."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame

TARGETS = ("pyspark", "pandas", "pyarrow", "polars")


def to_target(df: DataFrame, target: str):
    """The frame itself, or its rows as a local frame (they come to the driver)."""
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}")
    if target == "pandas":
        return df.toPandas()
    if target == "pyarrow":
        return df.toArrow()
    if target == "polars":
        try:
            import polars
        except ImportError as e:
            raise ImportError("target='polars' needs the polars package") from e
        return polars.from_arrow(df.toArrow())
    return df


def usual_target() -> str:
    """The first of pandas, Polars and PyArrow that is there."""
    found = (t for t, module in (("pandas", "pandas"), ("polars", "polars"), ("pyarrow", "pyarrow")) if importlib.util.find_spec(module))
    return next(found, "pyspark")


def write_ndjson(df: DataFrame, path: str, column: str = "doc", mode: str = "errorifexists") -> None:
    """One document a line."""
    df.select(column).write.mode(mode).text(path)
