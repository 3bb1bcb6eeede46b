import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvern.functions.spans import quote, spans

values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=15)


def walk(value, pointer=""):
    yield pointer, value
    children = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, child in children:
        yield from walk(child, f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}")


@settings(max_examples=150, deadline=None)
@given(values, st.sampled_from([None, 2]), st.booleans())
def test_every_pointer_has_the_span_of_its_value(value, indent, ascii_only):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    found = spans(f" {text}\n")
    assert {p: json.loads(f" {text}\n"[a:b]) for p, (_, a, b) in found.items()} == dict(walk(value))


@pytest.mark.parametrize("bad", ["", "{", "[1,]", '{"a" 1}', "1 2", '{"a":1,}', "[1 2]", "tru", '"\\x"', "01"])
def test_no_json(bad):
    with pytest.raises(ValueError):
        spans(bad)


def test_quotes():
    body = '{"a": {"b": 39182000000.00}, "a": {"c": "x"}}'
    assert quote(body, "/a/c") == '"c": "x"' and quote(body, "/a/b") is None and quote(body, "/a", 5) == '{"c":'
    assert quote('{"n": 39182000000.00}', "/n") == '"n": 39182000000.00' and quote(None, "/n") is None and quote("x", "") is None
    assert spans("[" * 3000 + "]" * 3000)[""] == (0, 0, 6000)
