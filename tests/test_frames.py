import datetime as dt
import pickle
import time
import warnings
from dataclasses import replace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonspark import Config, JsonSpark, JsonSparkError, NumberConversion
from jsonspark.functions.columns import ALL, json_flatten, json_unflatten, register
from jsonspark.operators.documents import long_form, transform_documents
from jsonspark.operators.frame import execute_frame, json_columns
from jsonspark.operators.normalise import normalise
from jsonspark.sources.readers import from_documents, from_ndjson
from jsonspark.sources.sinks import to_target, write_ndjson
from jsonspark.streaming.streams import normalise_stream, read_ndjson_stream, transform_stream

FLAT = Config(mode="flatten")


def wide(spark, documents, config=FLAT, **more):
    return normalise(from_documents(spark, documents), "doc", config, **more)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_normalise_union(spark):
    df = wide(spark, [{"a": 1, "b": {"x": "hi"}}, {"a": 2, "c": True}])
    assert df.dtypes == [("a", "bigint"), ("b.x", "string"), ("c", "boolean")]
    assert rows(df) == [(1, "hi", None), (2, None, True)]


@pytest.mark.parametrize("values, kind, wanted", [
    (["5", "5.5"], "double", [5.0, 5.5]), (["maybe", "true"], "string", ["maybe", "True"]), (["Smith", "123"], "string", ["Smith", "123"]),
    (["2024-01-15", "2024-01-16"], "date", [dt.date(2024, 1, 15), dt.date(2024, 1, 16)]),
    (["2024-01-15", "2024-01-16T01:02:03Z"], "timestamp", [dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 16, 1, 2, 3)]),
    ([99999999999999999999, 1], "double", [1e20, 1.0]), ([None, None], "string", [None, None]), ([{}, 1], "string", ["{}", "1"]), ([True, False], "boolean", [True, False]),
])
def test_normalise_types(spark, values, kind, wanted):
    df = wide(spark, [{"v": v} for v in values], replace(FLAT, **ALL))
    assert df.dtypes == [("v", kind)] and [r[0] for r in rows(df)] == wanted


def test_normalise_lists(spark):
    c = replace(FLAT, key_replacements=(("r'^(User|Admin)_'", ""),), handle_key_collision=True)
    df = wide(spark, [{"User_id": 100, "Admin_id": "abc"}, {"User_id": 200}], c)
    assert df.dtypes == [("id", "array<string>")] and rows(df) == [(["100", "abc"],), (["200"],)]
    df = wide(spark, [{"User_id": 1, "Admin_id": 2}, {"User_id": 3}, {"x": None}], c)
    assert df.dtypes == [("id", "array<bigint>"), ("x", "string")] and rows(df) == [([1, 2], None), ([3], None), (None, None)]


def test_normalise_edges(spark):
    assert wide(spark, [{}, {}]).columns == [] and wide(spark, [{}, {}]).count() == 0
    assert wide(spark, []).columns == []
    df = wide(spark, [{"A": 1, "a": 2, "a.b": {"c": 3}}])
    assert df.columns == ["A", "a", "a.b.c"] and rows(df) == [(1, 2, 3)]
    with pytest.raises(Exception, match="E00"):
        wide(spark, ["[1", {"a": 1}]).collect()
    with pytest.raises(JsonSparkError):
        wide(spark, [{f"k{i}": 1 for i in range(5)}], max_columns=4)


def test_static_frame_has_no_python(spark):
    df = spark.createDataFrame([(1, "5K", ("x", 2))], "id int, v string, s struct<a:string,b:struct<c:int>>".replace("b:struct<c:int>", "b:int"))
    out = execute_frame(df, replace(FLAT, numbers=NumberConversion(True), lowercase_keys=True), json_cols=[])
    assert out.dtypes == [("id", "int"), ("v", "bigint"), ("a", "string"), ("b", "int")] and rows(out) == [(1, 5000, "x", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_frame_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "User_id int, Admin_id int, x int")
    c = replace(FLAT, key_replacements=(("r'^(User|Admin)_'", ""),), key_exclusions=("x",))
    assert rows(execute_frame(df, c)) == [(2,)]
    assert rows(execute_frame(df, replace(c, handle_key_collision=True))) == [([1, 2],)]
    assert execute_frame(df, replace(c, always_array_keys=("x",), key_exclusions=())).dtypes == [("id", "int"), ("x", "array<int>")]
    empty = spark.createDataFrame([("", "a"), (None, "b")], "e string, f string")
    assert rows(execute_frame(empty, replace(FLAT, remove_empty_strings=True))) == [(None, "a"), (None, "b")]


def test_json_text_columns(spark):
    df = spark.createDataFrame([(1, '{"user":{"name":"A"},"tags":["x","y"]}'), (2, None), (3, '{"user":{"name":"B"}}')], "id int, payload string")
    assert json_columns(df) == ["payload"]
    out = execute_frame(df, FLAT)
    assert out.columns == ["id", "user.name", "tags.0", "tags.1"] and rows(out) == [(1, "A", "x", "y"), (2, None, None, None), (3, "B", None, None)]
    bad = spark.createDataFrame([(1, '{"a":1}'), (2, "oops")], "id int, p string")
    assert json_columns(bad) == []
    with pytest.warns(UserWarning, match="'p': 1 value"):
        assert execute_frame(bad, FLAT, json_cols=["p"]).columns == ["id", "a", "p"]
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always", UserWarning)
        execute_frame(df, FLAT)
    assert not [w for w in told if w.category is UserWarning]
    two = spark.createDataFrame([('{"k":1}', '{"k":2}')], "a string, b string")
    assert rows(execute_frame(two, FLAT)) == [(2,)] and rows(execute_frame(two, replace(FLAT, handle_key_collision=True))) == [([1, 2],)]


def test_arrays_maps_and_other_modes(spark):
    df = spark.createDataFrame([(1, [1, 2], {"k": "v"})], "id int, xs array<int>, m map<string,string>")
    assert rows(execute_frame(df, FLAT)) == [(1, 1, 2, "v")]
    nested = spark.createDataFrame([(1, "x")], "`a.b` int, `a.c` string")
    assert rows(execute_frame(nested, Config(mode="unflatten"))) == [('{"b":1,"c":"x"}',)]
    nulls = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert execute_frame(nulls, replace(FLAT, remove_nulls=True)).columns == ["a"]


def test_permissive_and_long(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1}}'), (2, "{"), (3, None)], "id int, d string")
    out = transform_documents(df, "d", FLAT, permissive=True).select("id", "d", F.col("_error.code"))
    assert rows(out) == [(1, '{"a.b":1}', None), (2, None, "E004"), (3, None, None)]
    with pytest.raises(Exception, match="E004"):
        transform_documents(df, "d", FLAT).collect()
    assert rows(long_form(df.where("id = 1"), "d", FLAT)) == [(1, 0, "a.b", "1")]


def test_columns_and_sql(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,null]}}',)], "d string")
    assert df.select(json_unflatten(json_flatten("d"))).first()[0] == '{"a":{"b":[1,null]}}'
    register(spark)
    df.createOrReplaceTempView("docs_for_sql")
    assert spark.sql("SELECT json_flatten(d) FROM docs_for_sql").first()[0] == '{"a.b.0":1,"a.b.1":null}'
    assert rows(spark.sql("SELECT pos, key, kind, value FROM docs_for_sql, LATERAL json_entries(d)")) == [(0, "a.b.0", "number", "1"), (1, "a.b.1", "null", "null")]


def test_builder(spark):
    b = JsonSpark().flatten().separator("_").lowercase_keys().auto_convert_types()
    assert b.execute('{"A":{"B":"5K"}}') == '{"a_b":5000}' and b.execute({"A": {"B": "x"}}) == {"a_b": "x"}
    assert b.execute(['{"A":1}', {"A": "2"}]) == ['{"a":1}', {"a": 2}]
    assert pickle.loads(pickle.dumps(b)).execute('{"A":1}') == '{"a":1}' and JsonSpark.from_config_json(b.to_config_json()).config == b.config
    with pytest.raises(JsonSparkError) as e:
        b.execute(['{"A":1}', "{"])
    assert e.value.code == "E006" and "1" in str(e.value)
    for bad in (5, [5]):
        with pytest.raises(ValueError):
            b.execute(bad)
    with pytest.raises(ValueError):
        b.execute("{}", target="pandas")
    with pytest.raises(ValueError):
        JsonSpark().separator("")
    with pytest.raises(JsonSparkError):
        JsonSpark.from_config_json('{"what": 1}')
    with pytest.raises(JsonSparkError):
        JsonSpark().execute("{}")
    out = b.execute_to_output(['{"A":1}'])
    assert out.is_multiple and out.get_multiple() == ['{"a":1}'] and b.execute_to_output("{}").get_single() == "{}"
    kept = JsonSpark().convert_nulls(True, ["-"]).convert_nulls(False).config.nulls
    assert kept.extra_tokens == ("-",) and not kept.enabled
    frame = JsonSpark().flatten().execute([{"a": 1}, {"b": "x"}], normalise=True, target="pyarrow")
    assert frame.column_names == ["a", "b"] and frame.num_rows == 2
    with pytest.raises(ValueError):
        to_target(None, "excel")
    with pytest.raises(JsonSparkError):
        JsonSpark().flatten().execute({"a": float("nan")})
    assert JsonSpark().flatten().execute({"a": {1: 2**70}}) == {"a.1": 2**70}


def test_local_frames(spark):
    import pandas as pd

    pdf = pd.DataFrame({"id": [1, 2], "v": ["5%", "6%"]})
    out = JsonSpark().flatten().convert_numbers().execute(pdf)
    assert list(out["v"]) == [5, 6]


def test_files_and_streams(spark, tmp_path):
    docs = from_documents(spark, ['{"a":{"b":1}}', '{"a":{"b":2}}', "{"])
    write_ndjson(docs, str(tmp_path / "in"))
    assert from_ndjson(spark, str(tmp_path / "in")).count() == 3

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        return spark.table(name)

    stream = read_ndjson_stream(spark, str(tmp_path / "in"), "doc")
    out = drain(transform_stream(stream, "doc", FLAT), f"s{int(time.time())}")
    assert sorted((r["doc"], r["_error"] and r["_error"]["code"]) for r in out.collect() if r["doc"]) == [('{"a.b":1}', None), ('{"a.b":2}', None)]
    assert out.where("_error.code = 'E004'").count() == 1
    with pytest.raises(JsonSparkError):
        normalise(stream, "doc", FLAT)
    schema = T.StructType([T.StructField("a.b", T.LongType())])
    good = stream.where("doc <> '{'")
    assert sorted(rows(drain(normalise_stream(good, "doc", FLAT, schema), f"n{int(time.time())}"))) == [(1,), (2,)]


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([("1", "x", '{"k":1}')], "a string, b string, c string").toDF("A", "a", "p")
    assert rows(execute_frame(df, FLAT)) == [("1", "x", 1)] and execute_frame(df, FLAT).columns == ["A", "a", "k"]
    flat = execute_frame(spark.createDataFrame([("1", '{"k":1}')], "a string, b string").toDF("X", "x"), replace(FLAT, **ALL), json_cols=[])
    assert flat.columns == ["X", "x"] and rows(flat) == [(1, '{"k":1}')]
    assert rows(execute_frame(df.toDF("A", "A", "p"), FLAT, json_cols=[]).limit(0)) == []


def test_columns_whose_cells_are_all_filtered(spark):
    df = spark.createDataFrame([(1, "", None, "x"), (2, "gone", "", "")], "id int, a string, b string, c string")
    config = replace(FLAT, remove_empty_strings=True, value_replacements=(("gone", ""),))
    for c in (config, replace(config, **ALL)):
        out = execute_frame(df, c)
        assert out.columns == ["id", "b", "c"] and rows(out) == [(1, None, "x"), (2, None, None)]


def test_num_threads(spark):
    df = spark.range(40).selectExpr("cast(id as string) as a")
    for n in (1, 3, 7):
        assert execute_frame(df, replace(FLAT, num_threads=n)).rdd.getNumPartitions() == n


def test_local_frames_of_mixed_cells(spark):
    mixed = pd.DataFrame({"id": [1, 2, 3], "v": [{"a": 1}, "text", None], "w": [[1, 2], 5, {"b": dt.date(2024, 1, 5)}], "t": pd.to_datetime(["2024-01-01", None, None])})
    out = JsonSpark().flatten().execute(mixed)
    assert isinstance(out, pd.DataFrame) and list(out.columns) == ["id", "a", "w.0", "w.1", "t", "v", "w", "b"]
    assert out["b"].tolist()[2] == "2024-01-05" and out["v"].tolist()[1] == "text" and out["w"].tolist()[1] == 5
    for empty in (pd.DataFrame(), pd.DataFrame({"a": []}), pd.DataFrame({"a": pd.Series([], dtype=object)})):
        assert JsonSpark().flatten().execute(empty).shape == empty.shape
    assert JsonSpark().flatten().execute(pa.table({"a": pa.array([], pa.int64())})).num_rows == 0


def test_series(spark):
    tool = JsonSpark().flatten()
    series = pd.Series([{"a": {"b": 1}}, None, '{"c":{"d":2}}'], index=[5, 6, 7], name="docs")
    out = tool.execute(series)
    assert out.tolist() == [{"a.b": 1}, None, '{"c.d":2}'] and list(out.index) == [5, 6, 7] and out.name == "docs"
    assert tool.execute(pa.array(['{"a":{"b":1}}', None])).to_pylist() == ['{"a.b":1}', None]
    wide = tool.execute(pd.Series([{"a": 1}, {"a": 2, "b": "x"}]), normalise=True)
    assert isinstance(wide, pd.DataFrame) and list(wide.columns) == ["a", "b"] and len(wide) == 2
    assert tool.execute(pa.array(['{"a":1}']), normalise=True).column_names == ["a"]


def test_bad_row_of_normalise(spark):
    documents = ['{"a":1}'] * 57 + ["{oops"] + ['{"a":2}'] * 40
    with pytest.raises(JsonSparkError, match="item 57") as e:
        JsonSpark().flatten().execute(documents, normalise=True)
    assert e.value.code == "E006" and "E004" in str(e.value)
    with pytest.raises(Exception, match=r"row \d+ of partition \d"):
        wide(spark, documents).collect()


def test_strict_replacements_and_settings(spark, monkeypatch):
    JsonSpark().flatten().key_replacement("r'(a)'", "$5").execute("{}")
    with pytest.raises(JsonSparkError, match="E003"):
        JsonSpark().flatten().strict_patterns().key_replacement("r'(a)'", "$5").execute("{}")
    with pytest.raises(JsonSparkError, match="E003"):
        JsonSpark().flatten().strict_patterns().value_replacement("r'(?<x>a)'", "${y}").execute("{}")
    JsonSpark().flatten().strict_patterns().value_replacement("r'(?<x>a)'", "${x}$1$$").execute("{}")
    monkeypatch.setenv("JSONSPARK_PARALLEL_THRESHOLD", "7")
    assert Config().parallel_threshold == 7
    spark.conf.set("spark.jsonspark.maxArrayIndex", "12")
    try:
        assert Config().max_array_index == 12 and Config(max_array_index=3).max_array_index == 3
    finally:
        spark.conf.unset("spark.jsonspark.maxArrayIndex")
