import json
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jsonspark import BooleanConversion, Config, DateConversion, JsonSparkError, NullConversion, NumberConversion
from jsonspark.kernel import Kernel

MODES = {m: Config(mode=m) for m in ("flatten", "unflatten", "normal")}
ALL = dict(dates=DateConversion(True), nulls=NullConversion(True), booleans=BooleanConversion(True), numbers=NumberConversion(True))


def run(mode, document, **changes):
    return Kernel(replace(MODES[mode], **changes))(document if isinstance(document, str) else json.dumps(document))


FLATTEN = [
    ({"a": {"b": 1, "c": [1, {"d": None}]}}, {}, '{"a.b":1,"a.c.0":1,"a.c.1.d":null}'),
    ({"": {"a": 1}, "b": {"": 2}}, {}, '{"a":1,"b.":2}'),
    ({"e": {}, "f": []}, {}, '{"e":{},"f":[]}'),
    ({"e": {}, "f": []}, dict(remove_empty_objects=True, remove_empty_arrays=True), "{}"),
    ([1, [2]], {}, '{"0":1,"1.0":2}'),
    ('{"a":1.0,"b":1e5,"c":123456789012345678901234567890}', {}, '{"a":1.0,"b":1e5,"c":123456789012345678901234567890}'),
    ('{"a":1,"a":2}', {}, '{"a":1,"a":2}'),
    ('{"A":1,"a":2}', dict(lowercase_keys=True), '{"a":2}'),
    ({"Ä": 1, "B": 2}, dict(lowercase_keys=True), '{"Ä":1,"b":2}'),
    ({"User_name": "a", "Admin_name": "b", "Guest_name": "c"}, dict(key_replacements=(("r'^(User|Admin|Guest)_'", ""),), handle_key_collision=True), '{"name":["a","b","c"]}'),
    ({"User_name": "a"}, dict(key_replacements=(("User_", ""),), always_array_keys=("name",)), '{"name":["a"]}'),
    ({"user": {"name": "J", "crypto_wallet": {"coin": "B"}}, "crypto_tags": ["x"]}, dict(key_exclusions=("crypto",)), '{"user.name":"J"}'),
    ({"items": [1, 2]}, dict(key_exclusions=("items.0",)), '{"items.0":1,"items.1":2}'),
    ({"a": "admin", "b": "keep", "c": 1234, "d": None}, dict(value_exclusions=("admin", "r'^12'", "null")), '{"b":"keep"}'),
    ({"ab": 1}, dict(key_replacements=(("", "-"),)), '{"-a-b-":1}'),
    ({"aaa": 1}, dict(key_replacements=(("aa", "a"),)), '{"aa":1}'),
    ({"k": "a.b.c $1"}, dict(value_replacements=((".", "-"), ("$1", "x"))), '{"k":"a-b-c x"}'),
    ({"k": "ab"}, dict(value_replacements=(("r'(a)(?P<n>b)'", "${n}$1$9$1x"),)), '{"k":"ba"}'),
    ({"k": "ab"}, dict(value_replacements=(("r'(?=a)'", "x"), ("r'('", "y"))), '{"k":"ab"}'),
    ({"k": "x", "n": ""}, dict(value_replacements=(("x", ""),), remove_empty_strings=True), "{}"),
    ({"k": "N/A", "m": None}, dict(remove_nulls=True, **ALL), "{}"),
    ({"k": 'q"\\\n\u0001é'}, {}, '{"k":"q\\"\\\\\\n\\u0001é"}'),
    ('"5K"', ALL, "5000"), ("42", {}, "42"), ("null", dict(remove_nulls=True), "null"), ("{}", {}, "{}"), ("[]", {}, "{}"), ('{"a":"\\ud83d\\ude00"}', {}, '{"a":"😀"}'),
]


@pytest.mark.parametrize("document, changes, wanted", FLATTEN)
def test_flatten(document, changes, wanted):
    assert run("flatten", document, **changes) == wanted


UNFLATTEN = [
    ({"a.b": 1, "a.c": 2}, {}, '{"a":{"b":1,"c":2}}'),
    ({"a.0": 1, "a.2": 3}, {}, '{"a":[1,null,3]}'),
    ({"a.0": 1, "a.2": 3}, dict(remove_nulls=True), '{"a":[1,3]}'),
    ({"a.01": 1}, {}, '{"a":{"01":1}}'),
    ({"0": 1, "1": 2}, {}, '{"0":1,"1":2}'),
    ({"a.0": 1, "a.x": 2}, {}, '{"a":{"0":1,"x":2}}'),
    ({"a.0.0": 1, "a.0.1": 2, "a.1.b": 3}, {}, '{"a":[[1,2],{"b":3}]}'),
    ({"items.0": 1, "items.99999999999999999999999": 2}, {}, '{"items":{"0":1,"99999999999999999999999":2}}'),
    ({"name::0": "a", "name::1": "b"}, dict(separator="::"), '{"name":["a","b"]}'),
    ({"x.a": "", "x.b": None}, dict(remove_empty_strings=True, remove_nulls=True, remove_empty_objects=True), "{}"),
    ({"x.a": ""}, dict(remove_empty_strings=True), '{"x":{}}'),
    ({"a": {"raw": "5"}}, ALL, '{"a":{"raw":"5"}}'),
    ({"a": "admin", "b": "keep"}, dict(value_exclusions=("r'^\"admin\"$'",)), '{"b":"keep"}'),
    ({"A_x": 1, "B_x": None}, dict(key_replacements=(("r'^[AB]_'", ""),), handle_key_collision=True, remove_nulls=True), '{"x":[1,null]}'),
    ({"a.b": 1, "a": 2}, {}, '{"a":2}'),
    ("", {}, "{}"), ("[1]", {}, "{}"),
]


@pytest.mark.parametrize("document, changes, wanted", UNFLATTEN)
def test_unflatten(document, changes, wanted):
    assert run("unflatten", document, **changes) == wanted


NORMAL = [
    ({"A": {"B": None}, "Ñ": [None, 1, {}]}, dict(remove_nulls=True, remove_empty_objects=True, lowercase_keys=True), '{"ñ":[1]}'),
    ({"a": {"b": None}}, dict(remove_nulls=True), '{"a":{}}'),
    ({"outer": {"user_name": "J", "admin_name": "K", "id": 1}}, dict(key_replacements=(("r'^(user|admin)_'", ""),), handle_key_collision=True), '{"outer":{"name":["J","K"],"id":1}}'),
    ('{"A":1,"a":2}', dict(lowercase_keys=True), '{"a":1,"a":2}'),
    ({"a": ["", "x"], "b": "5%"}, dict(remove_empty_strings=True, **ALL), '{"a":["x"],"b":5}'),
    ({"keep": {"remove_me": 1, "x": 2}}, dict(key_exclusions=("remove",)), '{"keep":{"x":2}}'),
    ("", {}, ""), ("  ", {}, "  "), ('{"a":{}}', dict(remove_empty_objects=True), "{}"),
]


@pytest.mark.parametrize("document, changes, wanted", NORMAL)
def test_normal(document, changes, wanted):
    assert run("normal", document, **changes) == wanted


@pytest.mark.parametrize("mode, document, code, changes", [
    ("flatten", "", "E007", {}), ("flatten", " \n", "E007", {}), ("flatten", '{"a":', "E004", {}), ("flatten", '{"a":1,}', "E004", {}), ("flatten", "hello", "E001", {}),
    ("flatten", '{"a":NaN}', "E004", {}), ("normal", "hello", "E001", {}), ("unflatten", '{"a":1,"a.b":2}', "E004", {}),
    ("unflatten", '{"items.999999999":1}', "E007", {}), ("unflatten", '{"items.11":1}', "E007", dict(max_array_index=10)), ("flatten", "[" * 100000, "E004", {}),
])
def test_errors(mode, document, code, changes):
    with pytest.raises(JsonSparkError) as e:
        run(mode, document, **changes)
    assert e.value.code == code and f"[{code}]" in str(e.value)


def test_configuration_errors():
    for bad in (Config(), Config(mode="flatten", separator=""), Config(mode="flatten", num_threads=0), Config(mode="flatten", strict_patterns=True, key_exclusions=("r'('",))):
        with pytest.raises(JsonSparkError):
            bad.checked()


def test_deep_document():
    deep = "1"
    for i in range(300):
        deep = f'{{"a":{deep}}}'
    assert run("flatten", deep) == '{"' + ".".join("a" * 300) + '":1}'


def test_same_chain_in_all_modes():
    changes = dict(value_replacements=(("unknown", "N/A"),), remove_nulls=True, **ALL)
    for mode in MODES:
        assert json.loads(run(mode, {"a": "unknown", "b": "1K", "c": "x"}, **changes)) == {"b": 1000, "c": "x"}


keys = st.text("abcxyzÄé_", min_size=1, max_size=4)
values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, min_size=1, max_size=3) | st.dictionaries(keys, x, min_size=1, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(keys, values, max_size=4))
def test_round_trip(document):
    assert json.loads(run("unflatten", run("flatten", document))) == document


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(keys, values, max_size=4))
def test_normal_without_settings_is_identity(document):
    assert json.loads(run("normal", document)) == document
