"""Configuration: immutable, checked on the driver, and JSON when it travels to executors."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field

from .errors import JsonSparkError

MODES = ("flatten", "unflatten", "normal")


@dataclass(frozen=True)
class DateConversion:
    enabled: bool = False
    normalize_to_utc: bool = True  #: rewrite values that name a time zone
    assume_utc_for_naive: bool = True  #: rewrite the others, date-only ones included


@dataclass(frozen=True)
class NullConversion:
    enabled: bool = False
    extra_tokens: tuple[str, ...] = ()


@dataclass(frozen=True)
class BooleanConversion:
    enabled: bool = False
    extra_true_tokens: tuple[str, ...] = ()
    extra_false_tokens: tuple[str, ...] = ()


@dataclass(frozen=True)
class NumberConversion:
    enabled: bool = False
    currency: bool = True
    percent: bool = True
    basis_points: bool = True
    suffixes: bool = True
    fractions: bool = True
    radix: bool = True


def setting(name: str, default: int | None):
    """A default that ``spark.jsonspark.<name>`` of the session overrides, or else JSONSPARK_<NAME> of the environment."""

    def value() -> int | None:
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
        found = session.conf.get(f"spark.jsonspark.{name}", None) if session else None
        if found is None:
            found = os.environ.get("JSONSPARK_" + re.sub("([A-Z])", r"_\1", name).upper())
        return default if found is None else int(found)

    return field(default_factory=value)


@dataclass(frozen=True)
class Config:
    mode: str | None = None
    separator: str = "."
    lowercase_keys: bool = False
    key_replacements: tuple[tuple[str, str], ...] = ()
    value_replacements: tuple[tuple[str, str], ...] = ()
    key_exclusions: tuple[str, ...] = ()
    value_exclusions: tuple[str, ...] = ()
    remove_empty_strings: bool = False
    remove_nulls: bool = False
    remove_empty_objects: bool = False
    remove_empty_arrays: bool = False
    handle_key_collision: bool = False
    always_array_keys: tuple[str, ...] = ()
    dates: DateConversion = DateConversion()
    nulls: NullConversion = NullConversion()
    booleans: BooleanConversion = BooleanConversion()
    numbers: NumberConversion = NumberConversion()
    max_array_index: int = setting("maxArrayIndex", 100000)
    # The thresholds are kept for callers; Spark's partitions are the parallelism.
    parallel_threshold: int = setting("parallelThreshold", 100)
    nested_parallel_threshold: int = setting("nestedParallelThreshold", 100)
    num_threads: int | None = setting("numThreads", None)  #: partitions of a frame
    strict_patterns: bool = False  #: refuse a malformed pattern instead of ignoring it

    @property
    def converts(self) -> bool:
        return self.dates.enabled or self.nulls.enabled or self.booleans.enabled or self.numbers.enabled

    @property
    def changes_keys(self) -> bool:
        return bool(self.lowercase_keys or self.key_replacements or self.handle_key_collision or self.always_array_keys)

    def checked(self) -> Config:
        """Raises E005 for what cannot be executed."""
        if self.mode not in MODES:
            raise JsonSparkError("E005", "choose flatten(), unflatten() or normal() first")
        if not self.separator:
            raise JsonSparkError("E005", "the separator is empty")
        if self.num_threads is not None and self.num_threads < 1:
            raise JsonSparkError("E005", "num_threads must be at least 1")
        if self.max_array_index < 0:
            raise JsonSparkError("E005", "max_array_index is negative")
        if self.strict_patterns:
            from .patterns import compiled, parse, unknown_groups

            for p in (*self.key_exclusions, *self.value_exclusions, *(p for p, _ in self.key_replacements + self.value_replacements)):
                kind, body = parse(p)
                if kind == "regex" and compiled(body) is None:
                    raise JsonSparkError("E002", f"malformed pattern {p}")
            for p, text in self.key_replacements + self.value_replacements:
                kind, body = parse(p)
                if kind == "regex" and (unknown := unknown_groups(text, body)):
                    raise JsonSparkError("E003", f"the replacement {text} of {p} names groups that are not there: {', '.join(unknown)}")
        return self

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """The inverse of to_json; unknown fields are refused."""
        raw = json.loads(text)
        parts = {"dates": DateConversion, "nulls": NullConversion, "booleans": BooleanConversion, "numbers": NumberConversion}
        try:
            for name, kind in parts.items():
                if name in raw:
                    raw[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw[name].items()})
            frozen = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in raw.items()}
            return cls(**frozen)
        except TypeError as e:
            raise JsonSparkError("E005", f"unknown configuration field: {e}") from e
