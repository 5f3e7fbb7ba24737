"""The expressions against the kernel: the same text, the same value."""

import json
import random

import pytest
from pyspark.sql import functions as F

from jsonspark import Config, DateConversion
from jsonspark.convert import convert
from jsonspark.functions.columns import ALL, json_convert
from jsonspark.functions.exprs import converted, with_converted
from tests.test_convert import DATES, NUMBERS, SAME

CONFIG = Config(mode="flatten", **ALL)


def _value(text):
    return None if text is None else json.loads(text)


def _compare(spark, texts, config=CONFIG):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_convert("t", config).alias("v")).collect()
    wrong = []
    for r in rows:
        found = convert(r["t"], config)
        wanted = json.loads(found[1]) if found and found[1] is not None else r["t"]
        got = _value(r["v"])
        if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
            same = isinstance(got, (int, float)) and not isinstance(got, bool) and got == pytest.approx(wanted, rel=1e-12)
        else:
            same = got == wanted
        if not same:
            wrong.append((r["t"], wanted, got))
    assert not wrong


def test_listed_values(spark):
    tokens = "null N/A none yes No on OFF y n nULL tRUE maybe".split()
    _compare(spark, [t for t in (*NUMBERS, *DATES, *SAME, *tokens)])


def test_random_values(spark):
    rng = random.Random(5)
    alphabet = "0123456789" * 3 + ".,-+ $%€KkMbp/()[]xeE_'TZ:W"
    texts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(600)}
    # A rounding point apart: digits beyond a double, and radix digits beyond 60 bits, are the kernel's alone.
    _compare(spark, sorted(texts))


def test_sign_forms(spark):
    """All pairs of sign and currency forms around numbers: a sign that was taken off leaves none behind."""
    forms = ["(%s)", "[%s]", "%s-", "-%s", "+%s", "$%s", "%s€", "EUR %s", " %s ", "- %s", "%sCR"]
    texts = {a % (b % n) for a in forms for b in forms for n in ("5", "1,234.50", ".5", "2e3")}
    _compare(spark, sorted(texts))


def test_dates_of_all_forms(spark):
    days = ["2024-02-29", "2023-02-29", "2024/01/15", "2024.01.15", "2024-01/15", "0000-01-01", "20240115", "30240115", "2024-366", "2023-366", "2024-W01-1", "2024-W53-1", "2020-W53-7", "2024-W00-3"]
    clocks = ["", "T10:30", "T10:30Z", "T10:30+05", " 10:30:05", "T10:30:05z", "T10:30:05.1", "T10:30:05.123Z", "T10:30:05.12+05", "T10:30:05.1+05", "T10:30:05+0530", "T23:59:59-12:34", "T24:00:00", "T10:30:05+24:00", "T10:30:05+05:60", "T103005", "T103005Z", "T103005+0530", "x"]
    _compare(spark, [d + c for d in days for c in clocks])


def test_stages_equal_the_column_function(spark):
    """A frame's projections and the Column function give the same kinds and texts."""
    texts = [*NUMBERS, *DATES, *SAME, "null", "yes", "", None, " 5 ", "(5-)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for config in (CONFIG, Config(mode="flatten", value_replacements=(("5", "7"),), remove_empty_strings=True), Config(mode="flatten", dates=DateConversion(True, False, True))):
        out = with_converted(df, {"a": F.col("t"), "b": F.upper("t")}, config).select("a", converted(F.col("t"), config).alias("c")).collect()
        assert all(r["a"] == r["c"] for r in out)


def test_no_python_in_plan(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t")).select(json_convert("t", CONFIG))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
