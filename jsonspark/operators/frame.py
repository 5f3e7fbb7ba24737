"""Whole frames: flat and struct columns by expressions alone, free-form documents through the kernel."""

from __future__ import annotations

import warnings
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..errors import JsonSparkError
from ..functions.exprs import kept_text, with_converted
from ..kernel import Obj, parse, render
from ..plans.names import plan_names
from .documents import by_place, is_nested, rows_as_documents
from .normalise import normalise, resolved_type

SAMPLE = 20


def json_columns(df: DataFrame, sample: int = SAMPLE) -> list[str]:
    """String columns whose first non-null values all are JSON objects or arrays (a bounded probe).

    One job looks at the first rows; a column with too few values there gets a job
    of its own.  The rows that come first decide; name the columns by
    ``json_cols=`` where their order may change.
    """
    places = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    if not places:
        return []
    plain = by_place(df).select(*[f"c{i}" for i in places])
    head = plain.limit(sample).collect()
    found = []
    for i in places:
        values = [r[f"c{i}"] for r in head if r[f"c{i}"] is not None]
        if len(values) < len(head) == sample and all(map(_container, values)):
            values = [r[0] for r in plain.select(f"c{i}").where(f"c{i} is not null").limit(sample).collect()]
        if values and all(map(_container, values)):
            found.append(df.columns[i])
    return found


def _container(text: str) -> bool:
    if not text.strip()[:1] in ("{", "["):
        return False
    try:
        return isinstance(parse(text), list)
    except JsonSparkError:
        return False


def spliced(df: DataFrame, columns: list[str], bad: dict[str, object] | None = None) -> DataFrame:
    """One document a row (column doc): JSON text columns in place of their text, objects without their column's name.

    A null cell of such a column adds nothing; text that is no JSON stays under
    its column's name and is counted by the accumulator of that name in ``bad``.
    """
    marked = frozenset(columns)
    nested = frozenset(f.name for f in df.schema.fields if is_nested(f.dataType) and not isinstance(f.dataType, T.ArrayType))

    @F.arrow_udf("string")
    def splice(docs: pa.Array) -> pa.Array:
        out = []
        for text in docs.to_pylist():
            pairs = Obj()
            for key, value in parse(text):
                if key in marked and isinstance(value, str):
                    try:
                        inner = parse(value)
                        value = inner if isinstance(inner, list) else value
                    except JsonSparkError:
                        if bad:
                            bad[key].add(1)
                if isinstance(value, Obj) and (key in marked or key in nested):
                    pairs.extend(value)
                elif value is not None or key not in marked:
                    pairs.append((key, value))
            out.append(render(pairs))
        return pa.array(out, pa.string())

    return rows_as_documents(df).select(splice("doc").alias("doc"))


def static_leaves(schema: T.StructType, separator: str) -> list[tuple[str, Column, T.DataType]] | None:
    """(path, Column of the frame by place, type) of all leaves, or None if a column needs the kernel; top-level structs lose their name."""
    out: list[tuple[str, Column, T.DataType]] = []

    def walk(prefix: str, column: Column, kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            if not kind.fields:
                return False
            return all(walk(f"{prefix}{separator}{f.name}" if prefix else f.name, column.getField(f.name), f.dataType) for f in kind.fields)
        if is_nested(kind):
            return False
        out.append((prefix, column, kind))
        return True

    for i, f in enumerate(schema.fields):
        column = F.col(f"c{i}")
        if not walk("" if isinstance(f.dataType, T.StructType) else f.name, column, f.dataType):
            return None
    return out


def spread(df: DataFrame) -> DataFrame:
    """A frame of fewer partitions than there are cores, dealt to all cores; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def flatten_static(df: DataFrame, config: Config) -> DataFrame | None:
    """Flattening by one select (and, if text is converted, one aggregation that finds the types), or None if it takes the kernel."""
    if config.remove_nulls or config.value_exclusions or not df.columns:
        return None
    leaves = static_leaves(df.schema, config.separator)
    if leaves is None:
        return None
    plan = plan_names([p for p, _, _ in leaves], config)
    used = sorted({i for p in plan for i in p.sources})
    text = [i for i in used if isinstance(leaves[i][2], T.StringType)]
    changed = bool(config.converts or config.value_replacements or config.remove_empty_strings)
    source = spread(df) if config.converts and text else df
    inner = by_place(source).select(*[leaves[i][1].alias(f"l{i}") for i in used])
    if changed and text:
        inner = with_converted(inner, {f"v{i}": F.col(f"l{i}") for i in text}, config)
    kinds = {i: leaves[i][2] for i in used}
    if changed and text:
        kinds |= {i: T.StringType() for i in text}
        if config.converts and df.isStreaming:
            raise JsonSparkError("E005", "conversion needs all values to find a column's type; use foreachBatch on a stream")
        seen = [F.bit_or(F.col(f"v{i}.kind")).alias(f"b{i}") for i in text] if config.converts else []
        if config.remove_empty_strings and not df.isStreaming:
            seen += [F.bool_or(F.col(f"l{i}").isNull() | kept_text(F.col(f"l{i}"), config).isNotNull()).alias(f"k{i}") for i in text]
        row = inner.agg(*seen).first().asDict() if seen else {}
        if config.converts:
            kinds |= {i: resolved_type(row[f"b{i}"] or 0) for i in text}
        gone = {i for i in text if row.get(f"k{i}") is False}  # every cell was filtered
        plan = [replace(p, sources=own) for p in plan if (own := [i for i in p.sources if i not in gone])]
    columns = []
    for p in plan:
        parts = []
        for i in p.sources:
            c = F.col(f"v{i}" if changed and i in text else f"l{i}")
            if changed and i in text:
                value, kind = c.getField("text"), kinds[i]
                c = F.when(c.getField("kind") == 1, F.initcap(value)).otherwise(value) if isinstance(kind, T.StringType) else value.try_cast(kind)
            parts.append((c, kinds[i]))
        if not p.array:
            columns.append(parts[0][0])
            continue
        same = len({k.simpleString() for _, k in parts}) == 1
        numeric = all(isinstance(k, T.NumericType) for _, k in parts)
        to = parts[0][1] if same else T.DoubleType() if numeric else T.StringType()
        columns.append(F.array_compact(F.array(*[c.try_cast(to) for c, _ in parts])))
    return inner.select(*[c.alias(f"o{i}") for i, c in enumerate(columns)]).toDF(*[p.name for p in plan])


def threaded(df: DataFrame, config: Config) -> DataFrame:
    """The frame in ``num_threads`` partitions where that is set: more are joined without a shuffle, fewer are dealt."""
    n = config.num_threads
    if not n or df.isStreaming:
        return df
    return df.coalesce(n) if df.rdd.getNumPartitions() >= n else df.repartition(n)


def execute_frame(df: DataFrame, config: Config, schema: T.StructType | None = None, json_cols: list[str] | None = None, max_columns: int = 100_000) -> DataFrame:
    """Every row as a document, through the configured mode, as a typed frame.

    Columns whose shape Spark knows become expressions; only rows with JSON text,
    arrays, maps or variants, or filters that depend on the value, go through the
    kernel.  ``json_cols`` names the JSON text columns (a probe of the first rows
    finds them otherwise; a stream needs them named).
    """
    config.checked()
    df = threaded(df, config)
    if json_cols is None:
        if df.isStreaming:
            raise JsonSparkError("E005", "name the JSON text columns of a stream by json_cols=")
        json_cols = json_columns(df)
    if config.mode == "flatten" and not json_cols and schema is None and (done := flatten_static(df, config)) is not None:
        return done
    if config.mode != "flatten":
        return normalise(rows_as_documents(df), "doc", config, schema, max_columns)
    bad = {c: df.sparkSession.sparkContext.accumulator(0) for c in json_cols} if schema is None and not df.isStreaming else {}
    done = normalise(spliced(df, json_cols, bad), "doc", config, schema, max_columns)
    for c, n in bad.items():  # the job that looked for the keys has read every row
        if n.value:
            warnings.warn(f"column {c!r}: {n.value} values are no JSON and stay as text", stacklevel=3)
    return done
