"""Many flattened documents to one wide, typed table.

Job one finds every key, where it is first seen, and the kinds of its values: an
aggregation with map-side combine whose result has one row a distinct key, the
only thing that comes to the driver (at most ``max_columns`` rows).  Job two
projects each document to the resolved types.  Given ``schema`` there is no job
one, so it works on streams too.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..convert import utc_date
from ..errors import JsonSparkError
from ..kernel import Num, Obj, kernel, render, value_of

# Bits of a key's kinds.
BOOL, INT, FLOAT, TEXT, DATE, TIME, LIST = (1 << k for k in range(7))


def kind_of(value, dates: bool) -> int:
    """The bit of a parsed scalar (0 for null); containers inside lists count as text."""
    if value is None:
        return 0
    if value is True or value is False:
        return BOOL
    if isinstance(value, Num):
        return INT if not any(c in value for c in ".eE") and -(2**63) <= int(value) < 2**63 else FLOAT
    if dates and isinstance(value, str):
        if len(value) == 10 and utc_date(value) == value:
            return DATE
        if len(value) > 10 and value[4:5] == "-" and value[10:11] == "T" and value[19:20] and utc_date(value):
            return TIME
    return TEXT


def kinds_of(text: str, dates: bool) -> int:
    value = value_of(text)
    if isinstance(value, list) and text.lstrip().startswith("["):
        bits = LIST
        for item in value:
            bits |= kind_of(item, dates) if not isinstance(item, list) else TEXT
        return bits
    return kind_of(value, dates) if not isinstance(value, list) else TEXT


def resolved_type(bits: int) -> T.DataType:
    """The column type of all kinds seen; two families or none make text, any list makes a list."""
    temporal, numeric = bits & (DATE | TIME), bits & (INT | FLOAT)
    families = sum(map(bool, (bits & BOOL, numeric, bits & TEXT, temporal)))
    if families != 1 or bits & TEXT:
        single = T.StringType()
    elif bits & BOOL:
        single = T.BooleanType()
    elif numeric:
        single = T.DoubleType() if bits & FLOAT else T.LongType()
    else:
        single = T.TimestampType() if bits & TIME else T.DateType()
    if bits & LIST:
        return T.ArrayType(T.StringType() if temporal else single)
    return single


def as_text(value) -> str | None:
    """A value in a text column: strings as they are, True and False with a capital."""
    if value is None:
        return None
    if value is True or value is False:
        return "True" if value else "False"
    if isinstance(value, str):
        return str(value)
    return render(value)


def typed(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        items = value if isinstance(value, list) and not isinstance(value, Obj) else [value]
        return [typed(x, kind.elementType) for x in items]
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.LongType):
        return int(value) if isinstance(value, Num) and not any(c in value for c in ".eE") and -(2**63) <= int(value) < 2**63 else None
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, Num) else None
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value) if isinstance(value, str) and len(value) == 10 and utc_date(value) == value else None
    if isinstance(kind, T.TimestampType):
        canonical = utc_date(value) if isinstance(value, str) else None
        if canonical is None:
            return None
        at = datetime.fromisoformat(canonical[:19]).replace(tzinfo=timezone.utc)
        fraction = value[19:].split("Z")[0].split("+")[0].split("-")[0] if len(value) > 19 and value[19] == "." else ""
        return at.replace(microsecond=int(fraction[1:7].ljust(6, "0"))) if len(fraction) > 1 else at
    return as_text(value)


def discover(docs: DataFrame, column: str, config: Config, max_columns: int = 100_000, index: str | None = None) -> T.StructType:
    """The schema of all documents: keys in the order in which they are first seen, types by all of their values.

    "First" follows the column ``index``, or else the order of partitions and of
    rows inside each.
    """
    wire, dates = config.checked().to_json(), config.dates.enabled

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, seen = kernel(wire), {}
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    for pos, (key, value) in enumerate(k.entries(text)):
                        bits = kinds_of(value, dates)
                        old = seen.get(key)
                        seen[key] = (rid, pos, bits) if old is None else (old[0], old[1], old[2] | bits)
                except JsonSparkError as e:
                    place = f"row {rid}" if index or rid < 1 << 33 else f"row {rid % (1 << 33)} of partition {rid >> 33}"
                    raise JsonSparkError("E006", f"{place}: {e}") from e
            if len(seen) > max_columns:  # partial results; the aggregation joins them
                yield _table(seen)
                seen = {}
        if seen:
            yield _table(seen)

    def _table(seen: dict) -> pa.RecordBatch:
        rid, pos, bits = zip(*seen.values())
        return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(rid, pa.int64()), pa.array(pos, pa.int32()), pa.array(bits, pa.int32())], ["key", "rid", "pos", "bits"])

    found = (
        docs.select((F.col(index) if index else F.monotonically_increasing_id()).alias("rid"), F.col(f"`{column}`").alias("doc"))
        .mapInArrow(keys, "key string, rid long, pos int, bits int")
        .groupBy("key").agg(F.min(F.struct("rid", "pos")).alias("first"), F.bit_or("bits").alias("bits"))
        .orderBy("first").limit(max_columns + 1).collect()
    )
    if len(found) > max_columns:
        raise JsonSparkError("E007", f"the documents have more than {max_columns} keys")
    return T.StructType([T.StructField(r["key"], resolved_type(r["bits"])) for r in found])


def project(docs: DataFrame, column: str, config: Config, schema: T.StructType) -> DataFrame:
    """Each document as a row of ``schema``; what a column's type cannot hold is null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wire = config.checked().to_json()
    # Inside the plan columns have plain names: keys may have dots, or differ in case alone.
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    names, kinds = [f.name for f in schema.fields], [f.dataType for f in schema.fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = kernel(wire)
        arrow = to_arrow_schema(inner)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for text in batch.column(0).to_pylist():
                own = {} if text is None else dict(k.entries(text))
                for out, name, kind in zip(columns, names, kinds):
                    raw = own.get(name)
                    out.append(None if raw is None else (raw if raw == "{}" and isinstance(kind, T.StringType) else typed(value_of(raw), kind)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(f"`{column}`").alias("doc")).mapInArrow(rows, inner).toDF(*names)


def normalise(docs: DataFrame, column: str, config: Config, schema: T.StructType | None = None, max_columns: int = 100_000, index: str | None = None) -> DataFrame:
    """The union of all documents' results, a column a (top-level) key; documents without any key at all give no columns and no rows."""
    if schema is None:
        if docs.isStreaming:
            raise JsonSparkError("E005", "a stream needs schema=: its keys cannot be looked for beforehand")
        schema = discover(docs, column, config, max_columns, index)
    if not schema.fields:
        return docs.sparkSession.createDataFrame([], T.StructType([]))
    return project(docs, column, config, schema)


