"""Registered queries over the driver's tables, each with its SQL.

The tables are flat but for ``events.props`` (JSON text) and
``embeddings.embedding`` (a list), so most queries make nested or untyped
documents first and the SQL works the answer out from the tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BooleanConversion, Config, DateConversion, NullConversion, NumberConversion
from ..functions.columns import ALL, json_convert, json_flatten, json_normal, json_unflatten, register
from ..operators.documents import long_form, rows_as_documents, transform_documents
from ..operators.frame import execute_frame
from ..operators.normalise import normalise

FLAT, DEEP, SAME = Config(mode="flatten"), Config(mode="unflatten"), Config(mode="normal")
NUMBERS = NumberConversion(True)
ORDER_DATE = "o_orderdate"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc(**fields):
    """A document column of the given fields; a dict is an object, a list an array, a Column a value; nulls are kept."""

    def made(x):
        if isinstance(x, dict):
            return F.struct(*[made(v).alias(k) for k, v in x.items()])
        if isinstance(x, list):
            return F.array(*[made(v) for v in x])
        return x if hasattr(x, "alias") else F.lit(x)

    return F.to_json(made(fields), {"ignoreNullFields": "false"})


def picked(df: DataFrame, column: str, types: dict[str, str]) -> DataFrame:
    """Typed columns of a flat document column; keys may have dots."""
    ddl = ", ".join(f"`{k}` {v}" for k, v in types.items())
    return df.withColumn("__x", F.from_json(column, ddl)).select(*[c for c in df.columns if c != column], *[F.col("__x").getField(k).alias(k.replace(".", "_")) for k in types])


# Flatten

@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def events_flatten_props(spark, sf_dir):
    """A column of JSON text found, spliced, un-nested and typed."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return execute_frame(events, FLAT)


@query("""SELECT o_orderkey AS id, c_custkey AS "customer.id", c_name AS "customer.name", c_mktsegment AS "customer.segment.name"
FROM orders JOIN customer ON o_custkey = c_custkey""")
def orders_struct_flatten(spark, sf_dir):
    """Static structs: one select, no Python."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    nested = o.join(c, o.o_custkey == c.c_custkey).select(
        F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("name")).alias("segment")).alias("customer")).alias("payload")
    )
    return execute_frame(nested, FLAT, json_cols=[])


@query("""SELECT s_suppkey, s_name AS "name", s_nationkey AS "address_nation", 'x' AS "address_zip_0", CAST(s_suppkey % 7 AS VARCHAR) AS "address_zip_1" FROM supplier""")
def documents_flatten_text(spark, sf_dir):
    """JSON text to flat JSON text; an array index is a segment of the path."""
    s = read(spark, sf_dir, "supplier")
    d = s.select("s_suppkey", doc(name=F.col("s_name"), address={"nation": F.col("s_nationkey"), "zip": [F.lit("x"), (F.col("s_suppkey") % 7).cast("string")]}).alias("d"))
    flat = d.withColumn("d", json_flatten("d"))
    return picked(flat, "d", {"name": "string", "address.nation": "int", "address.zip.0": "string", "address.zip.1": "string"})


@query("""SELECT c_custkey, key, value, CAST(pos AS INTEGER) AS pos FROM (
SELECT c_custkey, 'name' AS key, to_json(c_name)::VARCHAR AS value, 0 AS pos FROM customer UNION ALL
SELECT c_custkey, 'at.nation', CAST(c_nationkey AS VARCHAR), 1 FROM customer UNION ALL
SELECT c_custkey, 'at.tags.0', to_json(c_mktsegment)::VARCHAR, 2 FROM customer UNION ALL
SELECT c_custkey, 'at.tags.1', '"b"', 3 FROM customer UNION ALL
SELECT c_custkey, 'none', 'null', 4 FROM customer UNION ALL
SELECT c_custkey, 'empty', '[]', 5 FROM customer)""")
def customer_leaves_long(spark, sf_dir):
    """One row a leaf, with array indices and empty containers."""
    c = read(spark, sf_dir, "customer")
    d = c.select("c_custkey", doc(name=F.col("c_name"), at={"nation": F.col("c_nationkey"), "tags": [F.col("c_mktsegment"), F.lit("b")]}, none=F.lit(None).cast("string"), empty=F.array().cast("array<string>")).alias("d"))
    return long_form(d, "d", FLAT)


@query("""SELECT n_nationkey AS k, pos, key, CASE WHEN kind = 'string' THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS v, kind FROM nation,
(VALUES (0, 'name', 'string'), (1, 'region.id', 'number')) AS t(pos, key, kind)""")
def nation_table_function(spark, sf_dir):
    """The SQL table function."""
    register(spark)
    read(spark, sf_dir, "nation").select("n_nationkey", doc(name=F.col("n_name"), region={"id": F.col("n_regionkey")}).alias("d")).createOrReplaceTempView("nation_docs")
    return spark.sql("SELECT n_nationkey AS k, pos, key, trim(BOTH '\"' FROM value) AS v, kind FROM nation_docs, LATERAL json_entries(d)")


@query("SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS FLOAT) AS e{i}" for i in range(64)) + " FROM embeddings")
def embeddings_index_expand(spark, sf_dir):
    """An array becomes a column an index."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    wide = execute_frame(e, replace(FLAT, separator="_"), json_cols=[])
    return wide.select("vec_id", F.col("label").cast("int").alias("label"), *[F.col(f"e_{i}").cast("float").alias(f"e{i}") for i in range(64)])


# Unflatten and round trip

@query("SELECT p_partkey, p_name AS name, p_brand AS brand, p_size AS size FROM part")
def unflatten_nested(spark, sf_dir):
    """Dotted keys to objects and arrays, read back by paths."""
    p = read(spark, sf_dir, "part")
    flat = p.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("part.name"), F.col("p_brand").alias("part.tags.0"), F.col("p_size").alias("part.tags.1.size"))).alias("d"))
    d = flat.withColumn("d", json_unflatten("d"))
    return d.select(
        "p_partkey", F.get_json_object("d", "$.part.name").alias("name"), F.get_json_object("d", "$.part.tags[0]").alias("brand"),
        F.get_json_object("d", "$.part.tags[1].size").cast("int").alias("size"),
    )


@query("SELECT s_suppkey, TRUE AS same FROM supplier")
def unflatten_roundtrip(spark, sf_dir):
    """unflatten(flatten(d)) is d."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", doc(a={"b": {"n": F.col("s_name"), "k": F.col("s_nationkey")}}, list=[F.col("s_name"), F.lit("x")], none=F.lit(None).cast("int")).alias("d"))
    return s.select("s_suppkey", (json_unflatten(json_flatten("d")) == F.col("d")).alias("same"))


# Normal mode and filters

@query("""SELECT doc_id, lang, nullif(source, 'src0') AS source, CASE WHEN lang <> 'en' THEN upper(lang) END AS bio FROM documents""")
def normal_cleanup(spark, sf_dir):
    """Nulls, empty strings and emptied containers are removed at every depth; the rest stays in place."""
    d = read(spark, sf_dir, "documents")
    made = d.select("doc_id", doc(
        lang=F.col("lang"), meta={"source": F.nullif("source", F.lit("src0")), "more": {"gone": F.lit(None).cast("string")}},
        bio=F.when(F.col("lang") == "en", "").otherwise(F.upper("lang")), tags=F.array().cast("array<string>"),
    ).alias("d"))
    clean = made.withColumn("d", json_normal("d", replace(SAME, remove_nulls=True, remove_empty_strings=True, remove_empty_objects=True, remove_empty_arrays=True)))
    return clean.select("doc_id", F.get_json_object("d", "$.lang").alias("lang"), F.get_json_object("d", "$.meta.source").alias("source"), F.get_json_object("d", "$.bio").alias("bio"))


@query("""SELECT doc_id, CAST(1 + (CASE WHEN source <> 'src0' THEN 1 ELSE 0 END) + (CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves FROM documents""")
def filters_flatten(spark, sf_dir):
    """The four filters in flatten mode, counted by the leaves that stay."""
    d = read(spark, sf_dir, "documents").select("doc_id", doc(
        lang=F.col("lang"), source=F.nullif("source", F.lit("src0")), bio=F.when(F.col("lang") == "en", "").otherwise("x"), tags=F.array().cast("array<string>")
    ).alias("d"))
    leaves = long_form(d, "d", replace(FLAT, remove_nulls=True, remove_empty_strings=True, remove_empty_arrays=True, remove_empty_objects=True))
    return leaves.groupBy("doc_id").agg(F.count("*").alias("n_leaves"))


# Keys

@query("""SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS nation_regionkey FROM nation""")
def key_rename_lower(spark, sf_dir):
    """Lower case, then a regex and a literal replacement, on a flat frame: an alias each."""
    n = read(spark, sf_dir, "nation").toDF("N_NATIONKEY", "N_NAME", "N_REGIONKEY")
    return execute_frame(n, replace(FLAT, lowercase_keys=True, key_replacements=(("r'^n_'", "nation_"), ("nation_nation", "nation_"))), json_cols=[])


@query("SELECT c_custkey, c_name FROM customer")
def exclude_keys_frame(spark, sf_dir):
    """Excluded columns are not read."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return execute_frame(c, replace(FLAT, key_exclusions=("nation", "r'bal$'")), json_cols=[])


@query("SELECT c_custkey, c_name AS \"user_name\", CAST(NULL AS VARCHAR) AS wallet_coin FROM customer")
def exclude_keys_subtree(spark, sf_dir):
    """An excluded key takes its subtree along."""
    c = read(spark, sf_dir, "customer").select("c_custkey", doc(user={"name": F.col("c_name"), "wallet": {"coin": F.lit("BTC"), "balance": F.col("c_acctbal")}}).alias("d"))
    flat = c.withColumn("d", json_flatten("d", replace(FLAT, key_exclusions=("wallet",))))
    return picked(flat, "d", {"user.name": "string", "wallet.coin": "string"})


@query("""SELECT c_custkey, CASE WHEN c_mktsegment NOT LIKE '%BUILD%' AND c_mktsegment NOT LIKE 'AUTO%' THEN c_mktsegment END AS segment,
CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nation FROM customer""")
def exclude_values(spark, sf_dir):
    """Values that contain a literal or match a regex are dropped, numbers by their text."""
    c = read(spark, sf_dir, "customer").select("c_custkey", doc(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey")).alias("d"))
    flat = c.withColumn("d", json_flatten("d", replace(FLAT, value_exclusions=("BUILD", "r'^AUTO'", "r'^7$'"))))
    return picked(flat, "d", {"segment": "string", "nation": "int"})


@query("SELECT c_custkey AS id, [c_name, c_mktsegment] AS name FROM customer")
def collision_array_frame(spark, sf_dir):
    """Columns whose names become equal merge to an array."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("User_name"), F.col("c_mktsegment").alias("Admin_name"))
    return execute_frame(c, replace(FLAT, key_replacements=(("r'^(User|Admin)_'", ""),), handle_key_collision=True), json_cols=[])


@query("SELECT c_custkey, [c_name, c_mktsegment] AS name, c_mktsegment AS last FROM customer")
def collision_documents(spark, sf_dir):
    """Equal keys of a document: merged in order, or the last one wins."""
    c = read(spark, sf_dir, "customer").select("c_custkey", doc(User_name=F.col("c_name"), Admin_name=F.col("c_mktsegment")).alias("d"))
    rename = replace(FLAT, key_replacements=(("User_", ""), ("Admin_", "")))
    out = c.select("c_custkey", json_flatten("d", replace(rename, handle_key_collision=True)).alias("m"), json_flatten("d", rename).alias("l"))
    return out.select("c_custkey", F.from_json("m", "name array<string>")["name"].alias("name"), F.get_json_object("l", "$.name").alias("last"))


@query("SELECT s_suppkey AS id, [s_name] AS tag FROM supplier")
def always_array(spark, sf_dir):
    """A listed key always is an array."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("tag"))
    return execute_frame(s, replace(FLAT, always_array_keys=("tag",)), json_cols=[])


# Values

@query("SELECT conv_id, turn, replace(replace(role, 'user', 'human'), 'assistant', 'bot') AS role FROM conversations")
def value_replace_literal(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return execute_frame(c, replace(FLAT, value_replacements=(("user", "human"), ("assistant", "bot"))), json_cols=[])


@query("SELECT page_id, regexp_replace(url, '^https?://([^/]+)/.*$', '\\1') AS url FROM pages")
def value_replace_regex(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", doc(url=F.col("url")).alias("d"))
    return picked(p.withColumn("d", json_flatten("d", replace(FLAT, value_replacements=(("r'^https?://([^/]+)/.*$'", "$1"),)))), "d", {"url": "string"})


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(-l_tax * 100) AS BIGINT) AS tax FROM lineitem")
def convert_numbers_money(spark, sf_dir):
    """Currency, thousands, percent and accounting negatives, by expressions alone."""
    x = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("price"),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("discount"), F.concat(F.lit("("), F.format_number("l_tax", 2), F.lit(")")).alias("tax"),
    )
    wide = execute_frame(x, replace(FLAT, numbers=NUMBERS), json_cols=[])
    cents = lambda c, by: F.round(F.col(c) * by).cast("bigint").alias(c)
    return wide.select("l_orderkey", "l_linenumber", cents("price", 100), cents("discount", 1), cents("tax", 100))


@query("""SELECT o_orderkey, CAST(o_orderkey * 1000 AS BIGINT) AS k, CAST((o_orderkey % 9 + 1) * 5000 AS BIGINT) AS half, o_orderkey % 5000 AS hex,
CAST((o_orderkey % 90 + 10) AS BIGINT) AS bps FROM orders""")
def convert_suffix_fraction_radix(spark, sf_dir):
    """Magnitudes, fractions, radix numbers and basis points in documents, scaled to integers."""
    k = F.col("o_orderkey")
    x = read(spark, sf_dir, "orders").select("o_orderkey", doc(
        k=F.concat(k.cast("string"), F.lit("K")), half=F.concat((k % 9 + 1).cast("string"), F.lit("/2")), hex=F.concat(F.lit("0x"), F.hex(k % 5000)), bps=F.concat((k % 90 + 10).cast("string"), F.lit(" bps")),
    ).alias("d"))
    out = picked(x.withColumn("d", json_flatten("d", replace(FLAT, numbers=NUMBERS))), "d", {"k": "bigint", "half": "double", "hex": "bigint", "bps": "double"})
    return out.select("o_orderkey", "k", F.round(F.col("half") * 10000).cast("bigint").alias("half"), "hex", F.round(F.col("bps") * 10000).cast("bigint").alias("bps"))


_FORMS = ["yyyy/MM/dd", "yyyyMMdd", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+05:00'", "yyyy-MM-dd'T'HH:mm"]
_DATES_SQL = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN strftime({ORDER_DATE}, '%Y-%m-%d')
WHEN o_orderkey % 6 = 4 THEN strftime({ORDER_DATE} - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ')
WHEN o_orderkey % 6 = 5 THEN strftime({ORDER_DATE}, '%Y-%m-%dT%H:%M:00Z')
ELSE strftime({ORDER_DATE}, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM orders"""


def _dated_orders(spark, sf_dir) -> DataFrame:
    at = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        at = F.when(F.col("o_orderkey") % 6 == i, F.date_format(ORDER_DATE, form)).otherwise(at)
    return read(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))


@query(_DATES_SQL)
def convert_dates_utc(spark, sf_dir):
    """Six spellings of dates to UTC in documents."""
    d = _dated_orders(spark, sf_dir).select("o_orderkey", doc(at=F.col("at")).alias("d"))
    return picked(d.withColumn("d", json_flatten("d", replace(FLAT, dates=DateConversion(True), numbers=NUMBERS))), "d", {"at": "string"})


@query(_DATES_SQL)
def convert_dates_expressions(spark, sf_dir):
    """The same by expressions alone."""
    d = _dated_orders(spark, sf_dir)
    return d.select("o_orderkey", F.regexp_replace(json_convert("at", Config(dates=DateConversion(True), numbers=NUMBERS)), '"', "").alias("at"))


@query("""SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic, CAST(NULL AS VARCHAR) AS note FROM labels""")
def convert_bools_nulls(spark, sf_dir):
    """Token lists, with extra tokens."""
    x = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Yes").otherwise("off").alias("quality"), F.when(F.col("toxic") == 1, "ja").otherwise("nein").alias("toxic"), F.lit("N/A").alias("note"))
    c = replace(FLAT, booleans=BooleanConversion(True, ("ja",), ("nein",)), nulls=NullConversion(True))
    return execute_frame(x, c, json_cols=[])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'True' END AS mixed,
CAST(o_orderkey AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 0.5 END AS num, CAST(o_orderdate AS DATE) AS day FROM orders""")
def frame_type_resolution(spark, sf_dir):
    """Converted columns take the type that all of their values have in common."""
    k = F.col("o_orderkey")
    x = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 2 == 0, k.cast("string")).otherwise("true").alias("mixed"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("num"), F.date_format(ORDER_DATE, "yyyyMMdd").alias("day")
    )
    return execute_frame(x, replace(FLAT, **ALL), json_cols=[])


# Normalise

@query("""SELECT event_id AS id, event_type AS type, CASE WHEN event_type = 'purchase' THEN CAST(user_id AS BIGINT) END AS "user.id",
CASE WHEN event_type = 'click' THEN event_id % 2 = 0 END AS flag, CASE WHEN event_type = 'signup' THEN [event_id, user_id] END AS pair FROM events""")
def normalise_heterogeneous(spark, sf_dir):
    """Documents of several shapes to one wide table, null where a key is absent."""
    e, kind = read(spark, sf_dir, "events"), F.col("event_type")
    both = {"id": F.col("event_id"), "type": kind}
    shape = (
        F.when(kind == "purchase", doc(**both, user={"id": F.col("user_id")}))
        .when(kind == "click", doc(**both, flag=F.col("event_id") % 2 == 0))
        .when(kind == "signup", doc(**both, a_pair=F.col("event_id"), b_pair=F.col("user_id"))).otherwise(doc(**both))
    )
    c = replace(FLAT, key_replacements=(("r'^[ab]_pair$'", "pair"),), handle_key_collision=True)
    return normalise(e.select(shape.alias("d")), "d", c).select("id", "type", "`user.id`", "flag", "pair")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'E004' END AS code, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name FROM nation")
def errors_permissive(spark, sf_dir):
    """Malformed documents get a code instead of failing the query."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, '{"a":').otherwise(doc(a=F.col("n_name"))).alias("d"))
    done = transform_documents(n, "d", FLAT, permissive=True)
    return done.select("id", F.col("_error.code").alias("code"), F.get_json_object("d", "$.a").alias("name"))


@query("SELECT r_regionkey AS k, lower(r_name) AS name FROM region")
def sql_functions(spark, sf_dir):
    """Registered SQL functions."""
    register(spark, Config(lowercase_keys=True))
    read(spark, sf_dir, "region").createOrReplaceTempView("region_rows")
    return spark.sql("""SELECT r_regionkey AS k, get_json_object(json_unflatten(json_flatten(to_json(named_struct('A', named_struct('B', lower(r_name)))))), '$.a.b') AS name FROM region_rows""")


@query("SELECT r_regionkey, r_name FROM region")
def rows_to_documents(spark, sf_dir):
    """Rows to documents and back through the typed table."""
    rows = read(spark, sf_dir, "region")
    out = normalise(rows_as_documents(rows), "doc", FLAT)
    return out.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


_SIGNS = {"paren": "(%s)", "square": "[%s]", "after": "%s-", "before": "-%s", "plus": "+%s"}
_TWICE = {"paren_minus": "(-%s)", "minus_minus": "--%s", "both_ends": "-%s-", "square_minus": "[-%s]"}


@query("SELECT s_suppkey AS id, " + ", ".join([*[f"CAST({'' if k == 'plus' else '-'}s_suppkey AS BIGINT) AS {k}" for k in _SIGNS], *[f"replace('{v}', '%s', CAST(s_suppkey AS VARCHAR)) AS {k}" for k, v in _TWICE.items()]]) + " FROM supplier")
def convert_sign_forms(spark, sf_dir):
    """One sign in any form makes a number; two make none."""
    s = read(spark, sf_dir, "supplier")
    x = s.select(F.col("s_suppkey").alias("id"), *[F.format_string(form, F.col("s_suppkey").cast("string")).alias(k) for k, form in (_SIGNS | _TWICE).items()])
    return execute_frame(x, replace(FLAT, numbers=NUMBERS), json_cols=[])


@query("""SELECT c_custkey AS k, CAST(c_custkey * 1000000 AS BIGINT) AS usd, CAST(c_custkey + 0.5 AS DOUBLE) AS comma, CAST(1234567 AS BIGINT) AS indian, CAST(c_custkey * 1000000 AS BIGINT) AS dots,
    c_custkey / 1000.0 AS permille, c_custkey / 10000.0 AS tenthousandth, 'NOK' || c_custkey AS unknown FROM customer""")
def convert_separators_permille(spark, sf_dir):
    """Grouping by comma, point and in the Indian way, a decimal comma, codes, \u2030 and \u2031."""
    n = F.col("c_custkey").cast("string")
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.concat(F.lit("USD "), n, F.lit(",000,000")).alias("usd"), F.concat(n, F.lit(",5")).alias("comma"), F.lit("12,34,567").alias("indian"),
        F.concat(n, F.lit(".000.000")).alias("dots"), F.concat(n, F.lit("\u2030")).alias("permille"), F.concat(n, F.lit("\u2031")).alias("tenthousandth"), F.concat(F.lit("NOK"), n).alias("unknown"),
    )
    return execute_frame(c, replace(FLAT, numbers=NUMBERS), json_cols=[])


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS ordinal, CAST(o_orderdate AS DATE) AS week, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS kept,
    strftime(o_orderdate, '%Y-%m-%d %H:%M') AS naive, o_orderkey || '%' AS percent, CAST(o_orderkey AS BIGINT) AS plain FROM orders""")
def convert_dates_knobs(spark, sf_dir):
    """Ordinal and week dates; with naive times left alone, and percent switched off."""
    at = F.col("o_orderdate")
    year = F.extract(F.lit("YEAROFWEEK"), at).cast("string")
    day = F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"), F.lit("-"), (F.weekday(at) + 1).cast("string"))
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format(at, "yyyy-DDD").alias("ordinal"), day.alias("week"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("kept"),
        F.date_format(at, "yyyy-MM-dd HH:mm").alias("naive"), F.concat(F.col("o_orderkey").cast("string"), F.lit("%")).alias("percent"), F.col("o_orderkey").cast("string").alias("plain"),
    )
    utc = execute_frame(o.select("id", "ordinal", "week"), replace(FLAT, dates=DateConversion(True)), json_cols=[])
    rest = execute_frame(o.select("id", "kept", "naive", "percent", "plain"), replace(FLAT, dates=DateConversion(True, False, False), numbers=NumberConversion(True, percent=False)), json_cols=[])
    rest = rest.withColumn("kept", F.col("kept").cast("string") if dict(rest.dtypes)["kept"] == "string" else F.date_format("kept", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return utc.join(rest, "id")


@query("""SELECT s_suppkey AS k, 's' || s_suppkey AS first, CAST(s_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS empty, 'x' AS far,
    CAST(to_json(['s' || s_suppkey, 'last']) AS VARCHAR) AS merged FROM supplier""")
def unflatten_collisions_filters(spark, sf_dir):
    """Unflatten: nested array paths, filters, keys that meet after a replacement, an index too large for an array."""
    s = read(spark, sf_dir, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    flat = doc(**{"a.0.b.0.c": name, "a.0.b.1.c": F.lit(""), "n.User_k": name, "n.Admin_k": F.lit("last"), "n.v": F.col("s_nationkey"), "n.gone": F.lit(None).cast("string"), "far.99999999999999999999999": F.lit("x"), "far.1": F.lit("y")})
    config = replace(DEEP, remove_empty_strings=True, remove_nulls=True, remove_empty_objects=True, key_replacements=(("r'(User|Admin)_'", ""),), handle_key_collision=True)
    d = s.select("s_suppkey", json_unflatten(flat, config).alias("d"))
    got = lambda path: F.get_json_object("d", path)
    return d.select(
        F.col("s_suppkey").alias("k"), got("$.a[0].b[0].c").alias("first"), got("$.n.v").cast("bigint").alias("nation"), got("$.n.gone").alias("empty"), got("$.far['99999999999999999999999']").alias("far"), got("$.n.k").alias("merged"),
    )


@query("""SELECT n_nationkey AS k, lower(n_name) AS text, CAST(n_regionkey AS BIGINT) AS number, NULL::VARCHAR AS nothing, [n_name, 'b'] AS met FROM nation""")
def roots_and_normal_collisions(spark, sf_dir):
    """Documents that are one scalar; normal mode with keys that change and meet."""
    n = read(spark, sf_dir, "nation")
    rename = replace(SAME, lowercase_keys=True, key_replacements=(("X_", ""),), handle_key_collision=True)
    out = n.select(
        "n_nationkey", json_flatten(F.concat(F.lit('"'), F.lower("n_name"), F.lit('"')), FLAT).alias("t"), json_flatten(F.concat(F.lit(" "), F.col("n_regionkey").cast("string")), FLAT).alias("v"),
        json_flatten(F.lit("null"), FLAT).alias("z"), json_normal(doc(o=dict(X_K=F.col("n_name"), k=F.lit("b"))), rename).alias("m"),
    )
    return out.select(
        F.col("n_nationkey").alias("k"), F.from_json(F.concat(F.lit('{"v":'), "t", F.lit("}")), "v string")["v"].alias("text"), F.col("v").cast("bigint").alias("number"),
        F.nullif("z", F.lit("null")).alias("nothing"), F.from_json("m", "o struct<k:array<string>>")["o"]["k"].alias("met"),
    )
