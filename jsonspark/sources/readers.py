"""Inputs: Python values, local frames, NDJSON and text files, as DataFrames with one document a row."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import JsonSparkError


def _checked(value):
    """A JSON-able copy: keys as strings, NaN and infinities refused."""
    if isinstance(value, float) and not math.isfinite(value):
        raise JsonSparkError("E008", "NaN and infinities are not JSON")
    if isinstance(value, Mapping):
        return {k if isinstance(k, str) else json.dumps(k) if k is None or isinstance(k, (bool, int, float)) else str(k): _checked(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_checked(v) for v in value]
    return value


def to_text(value) -> str:
    """A document as JSON text: a string as it is, a dict or list dumped (any size of integer)."""
    if isinstance(value, str):
        return value
    if isinstance(value, (Mapping, list, tuple)):
        return json.dumps(_checked(value), ensure_ascii=False, separators=(",", ":"))
    raise ValueError(f"a document is a str or a dict, not {type(value).__name__}")


def from_documents(spark: SparkSession, documents: Iterable, column: str = "doc", index: str | None = None) -> DataFrame:
    """Strings and dicts, one row each, in order inside one local relation; ``index`` adds their places."""
    rows = [(None if d is None else to_text(d),) for d in documents]
    if index is None:
        return spark.createDataFrame(rows, f"`{column}` string")
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"`{column}` string, `{index}` long")


def from_ndjson(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """One document a line; blank lines are dropped."""
    lines = spark.read.text(path)
    return lines.where(F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0).select(F.col("value").alias(column))


def from_local_frame(spark: SparkSession, frame) -> DataFrame:
    """A pandas frame, a PyArrow table, or anything with to_arrow() or to_pandas()."""
    kind = type(frame).__module__.split(".")[0]
    if kind in ("pandas", "pyarrow"):
        return spark.createDataFrame(frame)
    for way in ("to_arrow", "to_pandas", "toPandas"):
        if hasattr(frame, way):
            return spark.createDataFrame(getattr(frame, way)())
    raise ValueError(f"unsupported frame {type(frame)!r}")


def is_local_frame(value) -> bool:
    return type(value).__module__.split(".")[0] in ("pandas", "pyarrow", "polars") and hasattr(value, "columns")


def has_documents(frame) -> bool:
    """Whether a pandas frame has cells that are dicts or lists: its rows are documents then."""
    if type(frame).__module__.split(".")[0] != "pandas":
        return False
    objects = [frame.iloc[:, i] for i, kind in enumerate(frame.dtypes) if kind == object]
    return any(isinstance(v, (Mapping, list, tuple)) for column in objects for v in column)


def row_documents(frame, un_nest: bool) -> list[dict]:
    """The rows of a pandas frame as dicts; with ``un_nest`` a cell that is a dict gives its own keys.

    Missing values are null, dates and other objects their text.
    """
    out = []
    for values in frame.itertuples(index=False, name=None):
        row: dict = {}
        for name, v in zip(frame.columns, values):
            v = _cell(v)
            if un_nest and isinstance(v, dict):
                row.update(v)
            else:
                row[name] = v
        out.append(row)
    return out


def _cell(v):
    if isinstance(v, Mapping):
        return {k if isinstance(k, str) else str(k): _cell(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_cell(x) for x in v]
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:  # NaN and NaT
        return None
    if isinstance(v, (str, bool, int, float)):
        return v
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def series_values(series) -> list:
    """The values of a pandas or Polars Series or an Arrow array; missing ones are None."""
    for way in ("to_pylist", "to_list", "tolist"):
        if hasattr(series, way):
            return [None if v is None or v != v else v for v in getattr(series, way)()]
    raise ValueError(f"unsupported series {type(series)!r}")


def is_series(value) -> bool:
    return not isinstance(value, (list, tuple)) and any(hasattr(value, way) for way in ("to_pylist", "to_list", "tolist"))


def like_series(series, values: list):
    """The values as the kind of series that they came from."""
    kind = type(series).__module__.split(".")[0]
    if kind == "pandas":
        return type(series)(values, index=series.index, name=series.name, dtype=object)
    if kind == "pyarrow":
        import pyarrow as pa

        return pa.array(values)
    return type(series)(series.name, values) if kind == "polars" else values
