"""The value pipeline as Catalyst expressions: no Python on the executors.

``converted(column, config)`` gives struct<kind, text>: kind as in normalise
(0 null, BOOL, INT, FLOAT, TEXT, DATE, TIME) and the value's text.  Data-dependent
casts are try_cast, so ANSI mode raises nothing.

The steps are generators: each yields a Column that later steps use several times
and is sent that value back.  ``with_converted`` runs the steps of all columns of a
frame as projections, one after the other, so that they stay inside generated code
and each value is worked out once; where there is no frame (a Column function) the
values are bound by a lambda.
"""

from __future__ import annotations

from collections.abc import Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, DateConversion, NumberConversion
from ..convert import CREDIT_MARKS, CURRENCY_PREFIXES, CURRENCY_SYMBOLS, FALSE_TOKENS, FLOAT, NULL_TOKENS, TRUE_TOKENS
from ..operators.normalise import BOOL, DATE, INT, TEXT, TIME
from ..operators.normalise import FLOAT as FLOAT_KIND
from ..patterns import compiled, java_regex, java_replacement, parse

SYMBOLS = "".join("\\" + c for c in CURRENCY_SYMBOLS)


Steps = Generator[Column, Column, Column]


def bound(value: Column, made) -> Column:
    """made(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def as_column(steps: Steps) -> Column:
    """The result of the steps as one expression; lambdas nest, so it is for few steps."""

    def go(sent: Column | None) -> Column:
        try:
            return bound(steps.send(sent), go)
        except StopIteration as done:
            return done.value

    return go(None)


def _in_stages(df: DataFrame, running: dict[str, Steps]) -> DataFrame:
    """Adds the result of each of the steps, all of them advancing together: the plan is as deep as the longest, however many there are."""
    sent: dict[str, Column | None] = dict.fromkeys(running)
    level = 0
    while running:
        values = []
        for name, steps in list(running.items()):
            try:
                values.append(steps.send(sent[name]).alias(f"{name} {level}"))
                sent[name] = F.col(f"`{name} {level}`")
            except StopIteration as done:
                values.append(done.value.alias(name))
                del running[name]
        df, level = df.select("*", *values), level + 1
    return df


def with_converted(df: DataFrame, wanted: dict[str, Column], config: Config) -> DataFrame:
    """Adds a column of struct<kind, text> for each Column, by projections alone."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    col = lambda n, part: F.col(f"`{n} {part}`")
    df = df.select("*", *[kept_text(c, config).alias(f"{n} text") for n, c in wanted.items()])
    if not config.converts:
        return df.select(*kept, *[_unconverted(col(n, "text")).alias(n) for n in wanted])
    df = df.select("*", *[trimmed(col(n, "text")).alias(f"{n} t") for n in wanted])
    dates = {f"{n} date": _dated(col(n, "t"), config.dates) for n in wanted}
    numbers = {f"{n} number": _numeric(col(n, "t"), config.numbers) for n in wanted}
    df = _in_stages(df, dates | numbers)
    return df.select(*kept, *[_chosen(*[col(n, part) for part in ("text", "t", "date", "number")], config).alias(n) for n in wanted])


def trimmed(c: Column) -> Column:
    """Without white space of any alphabet at the ends (trim() knows the plain space alone)."""
    return F.when(F.length(c) == F.octet_length(c), F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """All replacements in order; a malformed pattern does nothing."""
    for pattern, text in pairs:
        kind, body = parse(pattern)
        if kind == "literal":
            c = F.replace(c, F.lit(body), F.lit(text)) if body else F.regexp_replace(c, "", text.replace("\\", "\\\\").replace("$", "\\$"))
        elif compiled(body) is not None:
            c = F.regexp_replace(c, java_regex(body), java_replacement(text, body))
    return c


def matched(c: Column, patterns: tuple[str, ...]) -> Column | None:
    """Whether any pattern is found; None if none can be."""
    tests = []
    for pattern in patterns:
        kind, body = parse(pattern)
        if kind == "literal":
            tests.append(F.contains(c, F.lit(body)))
        elif compiled(body) is not None:
            tests.append(c.rlike(java_regex(body)))
    found = None
    for t in tests:
        found = t if found is None else found | t
    return found


def _finite(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    """A group's number, null without a match."""
    return _finite(F.nullif(F.regexp_extract(c, f"^{pattern}$", group), F.lit("")))


def _ungrouped(c: Column) -> Column:
    no = lambda mark: F.replace(c, F.lit(mark), F.lit(""))
    commas, dots = (F.length(c) - F.length(no(mark)) for mark in (",", "."))
    point = F.length(F.substring_index(c, ".", -1)) < F.length(F.substring_index(c, ",", -1))  # the point comes later
    text = (
        F.when((commas > 0) & (dots > 0), F.when(point, no(",")).otherwise(F.replace(no("."), F.lit(","), F.lit("."))))
        .when(commas == 1, F.replace(c, F.lit(","), F.lit(".")))
        .when(commas > 1, F.when(c.rlike(r"^(?:[^,]*(?:,[0-9]{3})+|[0-9]{1,3}(?:,[0-9]{2})*,[0-9]{2,3})$"), no(",")))
        .when(dots > 1, F.when(c.rlike(r"^[^.]*(?:\.[0-9]{3})+$"), no(".")))
        .otherwise(c)
    )
    return F.translate(text, " '_", "")


UNSIGNED = FLOAT.removeprefix("[+-]?")


def number(text: Column, config: NumberConversion) -> Column:
    """The number that a trimmed text writes, as a double, or null."""
    return as_column(_number(text, config))


def _number(text: Column, config: NumberConversion) -> Steps:
    simple = text.rlike(f"^{FLOAT}$")
    first = yield F.struct(_finite(F.when(simple, text)).alias("simple"), F.when(~simple & text.rlike("[0-9]"), text).alias("c"))
    c = first["c"]  # null, and so next to nothing from here on, for most values
    steps = []
    last = F.right(c, F.lit(1))  # most forms show in the last character

    def scaled(form: str, by: dict[str, float]) -> Column:
        """The number of a form that ends in one of the marks, times what the mark stands for."""
        times = F.lit(None).cast("double")
        for marks, x in by.items():
            times = F.when(last.isin(*marks), F.lit(x)).otherwise(times)
        return F.when(last.isin(*"".join(by)), _part(c, form) * times)

    if config.percent:
        steps.append(F.when(last == "%", _part(c, f"({FLOAT})%")).when(last.isin(*"‰‱"), _part(c, f"({FLOAT})[‰‱]") / F.when(last == "‰", 1000).otherwise(10000)))
    if config.basis_points:
        steps.append(F.when(last.isin("p", "s"), _part(c, rf"({FLOAT})\s*bps?") / 10000))
    if config.suffixes:
        steps.append(scaled(rf"({FLOAT})\s*[kKmMbBtT]", {"kK": 1e3, "mM": 1e6, "bB": 1e9, "tT": 1e12}))
    if config.fractions:
        form = rf"(?:({FLOAT})\s+)?({FLOAT})\s*/\s*({FLOAT})"
        whole, part = _part(c, form, 1), F.try_divide(_part(c, form, 2), F.nullif(_part(c, form, 3), F.lit(0.0)))
        steps.append(F.when(F.contains(c, F.lit("/")), F.when(whole.isNull(), part).when(whole < 0, whole - part).otherwise(whole + part)))
    if config.radix:
        written = c.rlike(r"^-?\s*0(?:[xX][0-9a-fA-F]{1,15}|[bB][01]{1,62}|[oO][0-7]{1,20})$")
        mark = F.lower(F.regexp_extract(c, "0([xXbBoO])", 1))
        base = F.when(mark == "x", 16).when(mark == "b", 2).otherwise(8)
        value = F.call_function("conv", F.regexp_extract(c, "0[xXbBoO](.*)", 1), base, F.lit(10)).try_cast("double")
        steps.append(F.when(F.substring(c, 1, 2).isin("0x", "0X", "0b", "0B", "0o", "0O") | c.startswith("-"), F.when(written, F.when(c.startswith("-"), -value).otherwise(value))))
    special = yield F.coalesce(*steps, F.lit(None).cast("double"))
    c = F.when(special.isNull(), c)
    wrapped = (c.startswith("(") & c.endswith(")")) | (c.startswith("[") & c.endswith("]"))
    length = F.length(c)
    bare = F.when(wrapped, F.substr(c, F.lit(2), length - 2)).when(c.endswith("-"), F.left(c, length - 1)).when(c.startswith("-"), F.substr(c, F.lit(2))).otherwise(c)
    sign = yield F.struct((wrapped | c.endswith("-") | c.startswith("-")).alias("negative"), F.trim(bare).alias("body"))
    body = sign["body"]
    body = F.when(body.startswith("+"), F.trim(F.substr(body, F.lit(2)))).otherwise(body)
    if config.currency:
        marks = "|".join(p.replace("$", "\\$") for p in CURRENCY_PREFIXES)
        bare = F.regexp_replace(body, rf"^(?:{marks})?\s*[{SYMBOLS}]*\s*(?:[A-Z]{{3}} +(?=.))?", "")
        body = yield F.when(body.rlike("^[^0-9.]"), bare).otherwise(body)
        credit = F.trim(F.regexp_replace(body, "".join(f"(?:{m})*" for m in reversed(CREDIT_MARKS)) + f"[{SYMBOLS}]*$", ""))
        body = F.when(body.rlike("[^0-9.]$"), credit).otherwise(body)
    body = yield body
    plain = yield _ungrouped(body)
    # A sign that was taken off leaves none behind.
    value = _finite(F.when(F.when(sign["negative"], plain.rlike(f"^{UNSIGNED}$")).otherwise(plain.rlike(f"^{FLOAT}$")), plain))
    return F.coalesce(first["simple"], special, F.when(sign["negative"], -value).otherwise(value))


def utc_date(text: Column) -> Column:
    """Canonical text of a date (YYYY-MM-DD) or datetime (UTC, Z), or null."""
    return as_column(_utc_date(text))


CLOCK = (
    r"^[0-9]{2}:[0-9]{2}(?:Z?|:[0-9]{2}(?:(?:\.[0-9]+)?(?:|Z|z|[+-][0-9]{2}:[0-9]{2})|(?:\.[0-9]{2}|\.[0-9]{3}|\.[0-9]{6})?[+-][0-9]{2}(?:[0-9]{2})?))$"
)
SQUEEZED, ORDINAL, WEEK, COMPACT, DAY, MOMENT = range(1, 7)


def _utc_date(c: Column) -> Steps:
    size, sub = F.length(c), lambda at, n: F.substring(c, at, n)
    rest, mark = F.substr(c, F.lit(12)), sub(5, 1)
    maybe = (size >= 8) & c.rlike("^[0-9]{4}(?:[-/.].{3}|[0-9]{4}$|[0-9]{4}T.{6})")
    first = yield F.struct(
        F.when(maybe, F.when(size == 8, F.when(c.rlike("^[12][0-9]{7}$"), SQUEEZED).when(c.rlike("^[0-9]{4}-[0-9]{3}$"), ORDINAL))
        .when((size == 10) & c.rlike("^[0-9]{4}-W[0-9]{2}-[1-7]$"), WEEK)
        .when(c.rlike(r"^[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?:$|[T ].)"), F.when(size == 10, DAY).otherwise(MOMENT))
        .when(c.rlike("^[0-9]{8}T[0-9]{6}(?:|Z|[+-][0-9]{2}:?[0-9]{2})$"), COMPACT)).alias("form"),
        F.when((size > 10) & mark.isin("-", "/", "."), F.when(mark == "-", rest).otherwise(F.replace(rest, mark, F.lit("-")))).alias("clock"),
    )
    form, clock = first["form"], first["clock"]
    joined = lambda mark, *parts: F.concat_ws(mark, *[sub(at, 2 if at > 1 else 4) for at in parts])
    seconds = F.when(F.substring(clock, 6, 1) == ":", F.substring(clock, 1, 8)).otherwise(F.concat(F.substring(clock, 1, 5), F.lit(":00")))
    parts = yield F.struct(
        F.when(form.isin(SQUEEZED, COMPACT), joined("-", 1, 5, 7)).when(form.isin(DAY, MOMENT), joined("-", 1, 6, 9)).alias("day"),
        F.when(form == COMPACT, joined(":", 10, 12, 14)).when(clock.rlike(CLOCK), seconds).alias("clock"),
        F.when(form == COMPACT, F.regexp_extract(c, "[+-][0-9:]+$", 0)).when(form == MOMENT, F.regexp_extract(clock, "[+-][0-9:]+$", 0)).alias("zone"),
    )
    digits = F.replace(parts["zone"], F.lit(":"), F.lit(""))
    shift = yield F.struct(
        F.coalesce(F.substring(digits, 2, 2).try_cast("int"), F.lit(0)).alias("hours"), F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0)).alias("minutes"),
        F.when(form.isin(SQUEEZED, DAY), parts["day"].try_cast("date").cast("string")).alias("date"),
        F.when(parts["clock"].isNotNull(), F.concat(parts["day"], F.lit(" "), parts["clock"]).try_cast("timestamp_ntz")).alias("local"),
    )
    by = shift["hours"] * 60 + shift["minutes"]
    moved = shift["local"] + F.make_dt_interval(mins=F.when(parts["zone"].startswith("+"), -by).otherwise(by))
    at = F.when(parts["zone"] == "", F.concat(parts["day"], F.lit("T"), parts["clock"], F.lit("Z"))).when(
        (shift["hours"] < 24) & (shift["minutes"] < 60), F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    new_year = F.when(form.isin(ORDINAL, WEEK), F.concat(sub(1, 4), F.lit("-01-01")).try_cast("date"))
    nth = F.date_add(new_year, sub(6, 3).try_cast("int") - 1)
    fourth = F.date_add(new_year, 3)  # 4 January is in week 1
    in_week = F.date_add(F.date_add(fourth, -F.weekday(fourth)), (sub(7, 2).try_cast("int") - 1) * 7 + sub(10, 1).try_cast("int") - 1)
    found = (
        F.when(form.isin(SQUEEZED, DAY), shift["date"]).when(shift["local"].isNotNull(), at)
        .when(form == ORDINAL, F.when(F.year(nth) == sub(1, 4).try_cast("int"), nth.cast("string")))
        .when(form == WEEK, F.when(F.weekofyear(in_week) == sub(7, 2).try_cast("int"), in_week.cast("string")))
    )
    return F.when(~c.startswith("0000"), found)


def _dated(t: Column, config: DateConversion) -> Steps:
    """The text that a recognised date shows (its own if it may not be rewritten), or null."""
    if not config.enabled:
        return F.lit(None).cast("string")
    found = yield from _utc_date(t)
    if config.normalize_to_utc and config.assume_utc_for_naive:
        return found
    found = yield found
    zoned = t.rlike(r"[Zz]$|\+|[T ][0-9:.]+-")
    rewrite = F.when(zoned, F.lit(config.normalize_to_utc)).otherwise(F.lit(config.assume_utc_for_naive))
    return F.when(found.isNotNull() & ~rewrite, t).otherwise(found)


def converted(c: Column, config: Config) -> Column:
    """The value pipeline for a string column: replacements, filters, conversion; see the module."""
    if not config.converts:
        return bound(kept_text(c, config), _unconverted)
    named = lambda x: F.struct(x.alias("text"), trimmed(x).alias("t"))
    found = lambda x: F.struct(
        x["text"].alias("text"), x["t"].alias("t"),
        as_column(_dated(x["t"], config.dates)).alias("date"), as_column(_numeric(x["t"], config.numbers)).alias("number"),
    )
    chosen = lambda y: _chosen(*[y[k] for k in ("text", "t", "date", "number")], config)
    return bound(bound(bound(kept_text(c, config), named), found), chosen)


def kept_text(c: Column, config: Config) -> Column:
    """The text after the replacements; null if the filter on empty strings takes it."""
    text = replaced(c, config.value_replacements)
    return F.when((c != "") & (text != ""), text) if config.remove_empty_strings else text


def _unconverted(text: Column) -> Column:
    return F.struct(F.when(text.isNotNull(), TEXT).otherwise(0).alias("kind"), text.alias("text"))


def _numeric(t: Column, config: NumberConversion) -> Steps:
    if not config.enabled:
        return F.lit(None).cast("double")
    may = t.rlike(r"^(?:[0-9+.$(\[-]|[A-Z]|[^\x00-\x7f])") & ~t.rlike("^[NTFYO]|^[0-9]{4}[-/][0-9]{2}[-/]")  # no date is a number
    return (yield from _number(F.when(may, t), config))


def _chosen(text: Column, t: Column, shown: Column, value: Column, config: Config) -> Column:
    """The first category that fits, as struct<kind, text>."""
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    nothing = made(0, F.lit(None).cast("string"))
    steps: list[tuple[Column, Column]] = [(text.isNull(), nothing)]
    n, b = config.nulls, config.booleans
    if n.enabled:
        steps.append((t.isin(*NULL_TOKENS), nothing))
    if b.enabled:
        steps += [(t.isin(*TRUE_TOKENS), made(BOOL, F.lit("true"))), (t.isin(*FALSE_TOKENS), made(BOOL, F.lit("false")))]
    if config.dates.enabled:
        day = shown.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        time = shown.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$")
        steps.append((shown.isNotNull(), F.struct(F.when(day, DATE).when(time, TIME).otherwise(TEXT).alias("kind"), shown.alias("text"))))
    if config.numbers.enabled:
        exact = t.rlike("^(?:-?[1-9][0-9]{0,18}|0)$") & t.try_cast("bigint").isNotNull()
        integral = (value == F.floor(value)) & (F.abs(value) < 9.2e18)
        steps += [(exact, made(INT, t)), (integral, made(INT, value.try_cast("bigint").cast("string"))), (value.isNotNull(), made(FLOAT_KIND, value.cast("string")))]
    if n.enabled and n.extra_tokens:
        steps.append((t.isin(*n.extra_tokens), nothing))
    if b.enabled and b.extra_true_tokens:
        steps.append((t.isin(*b.extra_true_tokens), made(BOOL, F.lit("true"))))
    if b.enabled and b.extra_false_tokens:
        steps.append((t.isin(*b.extra_false_tokens), made(BOOL, F.lit("false"))))
    out = None
    for test, result in steps:
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(made(TEXT, text))
