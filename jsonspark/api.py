"""The chainable builder.

Methods change the builder and return it.  ``execute`` takes a JSON string, a
dict, a list of them, a DataFrame, or a local frame or series, and gives back the
same kind.  Single documents and short lists are done in place; everything else
runs on Spark.
"""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .config import Config
from .errors import JsonSparkError, at_item
from .kernel import Kernel
from .operators.documents import transform_documents
from .operators.frame import execute_frame
from .operators.normalise import normalise
from .sources.readers import from_documents, from_local_frame, has_documents, is_local_frame, is_series, like_series, row_documents, series_values, to_text
from .sources.sinks import TARGETS, to_target, usual_target


class JsonOutput:
    """A result that knows whether it is one document or several."""

    def __init__(self, value: str | list[str]):
        self._value = value

    @property
    def is_single(self) -> bool:
        return isinstance(self._value, str)

    @property
    def is_multiple(self) -> bool:
        return not self.is_single

    def get_single(self) -> str:
        if not self.is_single:
            raise ValueError("the result has several documents")
        return self._value

    def get_multiple(self) -> list[str]:
        if self.is_single:
            raise ValueError("the result is one document")
        return self._value

    def into_vec(self) -> list[str]:
        return [self._value] if self.is_single else self._value

    def to_python(self) -> str | list[str]:
        return self._value


class JsonSpark:
    """See the module."""

    def __init__(self, config: Config | None = None):
        self._config = config or Config()

    def _set(self, **changes) -> JsonSpark:
        self._config = replace(self._config, **changes)
        return self

    @property
    def config(self) -> Config:
        return self._config

    # Modes

    def flatten(self) -> JsonSpark:
        """Nested documents to one level of dotted keys."""
        return self._set(mode="flatten")

    def unflatten(self) -> JsonSpark:
        """Dotted keys to nested documents."""
        return self._set(mode="unflatten")

    def normal(self) -> JsonSpark:
        """Same structure; rewriting and filters only."""
        return self._set(mode="normal")

    # Keys

    def separator(self, separator: str) -> JsonSpark:
        if not separator:
            raise ValueError("the separator is empty")
        return self._set(separator=separator)

    def lowercase_keys(self, on: bool = True) -> JsonSpark:
        return self._set(lowercase_keys=on)

    def key_replacement(self, find: str, replacement: str) -> JsonSpark:
        return self._set(key_replacements=(*self._config.key_replacements, (find, replacement)))

    def exclude_key(self, pattern: str) -> JsonSpark:
        return self._set(key_exclusions=(*self._config.key_exclusions, pattern))

    def handle_key_collision(self, on: bool = True) -> JsonSpark:
        return self._set(handle_key_collision=on)

    def always_array_keys(self, keys: list[str]) -> JsonSpark:
        return self._set(always_array_keys=tuple(keys))

    # Values

    def value_replacement(self, find: str, replacement: str) -> JsonSpark:
        return self._set(value_replacements=(*self._config.value_replacements, (find, replacement)))

    def exclude_value(self, pattern: str) -> JsonSpark:
        return self._set(value_exclusions=(*self._config.value_exclusions, pattern))

    def remove_empty_strings(self, on: bool = True) -> JsonSpark:
        return self._set(remove_empty_strings=on)

    def remove_nulls(self, on: bool = True) -> JsonSpark:
        return self._set(remove_nulls=on)

    def remove_empty_objects(self, on: bool = True) -> JsonSpark:
        return self._set(remove_empty_objects=on)

    def remove_empty_arrays(self, on: bool = True) -> JsonSpark:
        return self._set(remove_empty_arrays=on)

    # Conversion: None keeps what was set before, a list replaces the earlier one.

    def _convert(self, part: str, enable: bool, **settings) -> JsonSpark:
        given = {k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in settings.items() if v is not None}
        return self._set(**{part: replace(getattr(self._config, part), enabled=enable, **given)})

    def auto_convert_types(self, on: bool = True) -> JsonSpark:
        for part in ("dates", "nulls", "booleans", "numbers"):
            self._convert(part, on)
        return self

    def convert_dates(self, enable: bool = True, normalize_to_utc: bool | None = None, assume_utc_for_naive: bool | None = None) -> JsonSpark:
        return self._convert("dates", enable, normalize_to_utc=normalize_to_utc, assume_utc_for_naive=assume_utc_for_naive)

    def convert_nulls(self, enable: bool = True, extra_tokens: list[str] | None = None) -> JsonSpark:
        return self._convert("nulls", enable, extra_tokens=extra_tokens)

    def convert_booleans(self, enable: bool = True, extra_true_tokens: list[str] | None = None, extra_false_tokens: list[str] | None = None) -> JsonSpark:
        return self._convert("booleans", enable, extra_true_tokens=extra_true_tokens, extra_false_tokens=extra_false_tokens)

    def convert_numbers(
        self, enable: bool = True, currency: bool | None = None, percent: bool | None = None, basis_points: bool | None = None,
        suffixes: bool | None = None, fractions: bool | None = None, radix: bool | None = None,
    ) -> JsonSpark:
        return self._convert("numbers", enable, currency=currency, percent=percent, basis_points=basis_points, suffixes=suffixes, fractions=fractions, radix=radix)

    def convert_dates_config(self, config) -> JsonSpark:
        return self._set(dates=config)

    def convert_nulls_config(self, config) -> JsonSpark:
        return self._set(nulls=config)

    def convert_booleans_config(self, config) -> JsonSpark:
        return self._set(booleans=config)

    def convert_numbers_config(self, config) -> JsonSpark:
        return self._set(numbers=config)

    # Tuning

    def parallel_threshold(self, n: int) -> JsonSpark:
        return self._set(parallel_threshold=n)

    def nested_parallel_threshold(self, n: int) -> JsonSpark:
        return self._set(nested_parallel_threshold=n)

    def num_threads(self, n: int | None) -> JsonSpark:
        return self._set(num_threads=n)

    def max_array_index(self, n: int) -> JsonSpark:
        return self._set(max_array_index=n)

    def strict_patterns(self, on: bool = True) -> JsonSpark:
        return self._set(strict_patterns=on)

    # Wire format

    def to_config_json(self) -> str:
        return self._config.to_json()

    @classmethod
    def from_config_json(cls, text: str) -> JsonSpark:
        return cls(Config.from_json(text))

    def __reduce__(self):
        return JsonSpark.from_config_json, (self.to_config_json(),)

    # Execution

    def execute(self, data, normalise: bool = False, target: str | None = None, schema: T.StructType | None = None, column: str | None = None, permissive: bool = False):
        """Runs the configured mode; see the module.

        ``normalise`` gives one wide typed frame of all documents (``target``
        names its kind).  For a DataFrame, ``column`` names a column of JSON text
        to transform in place, ``permissive`` collects errors in ``_error``;
        otherwise each row is a document.
        """
        if target is not None and not normalise:
            raise ValueError("target needs normalise=True")
        config = self._config.checked()
        if isinstance(data, DataFrame):
            if column is not None and not normalise:
                return transform_documents(data, column, config, permissive)
            if column is not None:
                return to_target(_normalise(data, column, config, schema), target or "pyspark")
            return to_target(execute_frame(data, config, schema), target or "pyspark")
        if is_local_frame(data):
            return self._local_frame(data, config, target, schema)
        many = series_values(data) if is_series(data) else data if isinstance(data, (list, tuple)) else [data] if isinstance(data, (str, dict)) else None
        if many is not None:
            for i, item in enumerate(many):
                if not isinstance(item, (str, dict)) and not (item is None and is_series(data)):
                    raise ValueError(f"item {i} is neither a str nor a dict")
            if normalise:
                kind = type(data).__module__.split(".")[0]
                return to_target(_of_items(many, config, schema), target or (kind if kind in TARGETS else usual_target()))
            if isinstance(data, (str, dict)):
                return _like(data, Kernel(config)(to_text(data)))
            done = self._batch(many, config)
            return like_series(data, done) if is_series(data) else done
        raise ValueError("input must be a JSON str, a dict, a list of them, a frame or a series")

    def _local_frame(self, frame, config: Config, target: str | None, schema: T.StructType | None):
        kind = type(frame).__module__.split(".")[0]
        target = target or (kind if kind in TARGETS else usual_target())
        if not len(frame):
            return frame if target == kind else to_target(_session().createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns])), target)
        if has_documents(frame):
            return to_target(_of_items(row_documents(frame, config.mode == "flatten"), config, schema), target)
        return to_target(execute_frame(from_local_frame(_session(), frame), config, schema), target)

    def _batch(self, data: list, config: Config) -> list:
        run, out = Kernel(config), []
        for i, item in enumerate(data):
            try:
                out.append(None if item is None else _like(item, run(to_text(item))))
            except JsonSparkError as e:
                raise at_item(i, e) from e
        return out

    def execute_to_output(self, data) -> JsonOutput:
        """As execute for a str, dict, or list of them; the result stays JSON text."""
        if isinstance(data, (str, dict)):
            return JsonOutput(self.execute(to_text(data)))
        if isinstance(data, (list, tuple)):
            return JsonOutput(self.execute([to_text(x) for x in data]))
        raise ValueError("execute_to_output takes a str, a dict, or a list of them; use execute for frames and series")


_normalise = normalise


def _of_items(items: list, config: Config, schema: T.StructType | None) -> DataFrame:
    """One wide frame of local items; an item that fails is named by its place."""
    docs = from_documents(_session(), items, "doc", "at")
    try:
        return _normalise(docs, "doc", config, schema, index="at")
    except PythonException as e:
        found = re.search(r"row (\d+): \[(E\d+)\] [^:]*: ([^\n]*)", str(e))
        if found is None:
            raise
        raise at_item(int(found[1]), JsonSparkError(found[2], found[3])) from None


def _like(source, text: str):
    return json.loads(text) if isinstance(source, dict) else text


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
