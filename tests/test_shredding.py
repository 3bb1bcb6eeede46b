import json

from hypothesis import given, settings
from hypothesis import strategies as st

from kvern.operators import shredding
from kvern.operators.shredding import Leaf, assemble, parse_path, stripe

role = st.one_of(
    st.none(),
    st.fixed_dictionaries({}, optional={"kode": st.one_of(st.none(), st.sampled_from("ABC")), "person": st.one_of(st.none(), st.fixed_dictionaries({}, optional={"dato": st.sampled_from("123")}))}),
)
group = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"roller": st.one_of(st.none(), role, st.lists(role, max_size=4))}))
record = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"grupper": st.one_of(st.none(), group, st.lists(group, max_size=4))}))


def listed(x):
    return x if isinstance(x, list) else [] if x is None else [x]


@settings(max_examples=150, deadline=None)
@given(st.lists(record, max_size=5))
def test_tables_from_levels_hold_every_element_in_its_place(records):
    leaves = [Leaf(parse_path(p)) for p in ("grupper*.roller*.kode", "grupper*.roller*.person.dato")]
    for leaf in leaves:
        for r in records:
            stripe(leaf, r)
    table = assemble(leaves, 2)
    got = list(zip(*(list(v) for v in table.values()), strict=True))
    expected = [
        (k, g, i, x.get("kode"), (x.get("person") or {}).get("dato"))
        for k, r in enumerate(records)
        for g, gr in enumerate(listed((r or {}).get("grupper")))
        for i, x in enumerate(listed((gr or {}).get("roller")))
        if x is not None
    ]
    assert got == expected


def test_bodies_of_all_kinds(spark):
    good = {"g": [{"r": {"k": "A", "d": 1941}}, {"r": None}, {"r": [{"k": None}, None, {"k": {"x": 1}, "d": "2020-01-01T00:00:00"}]}]}
    rows = [(1, json.dumps(good), "x"), (2, json.dumps(good)[:-3], "x"), (3, "", "x"), (4, None, "x"), (5, "[1]", "x"), (6, '{"g": NaN}', "x"), (7, '{"g": []} x', "x"), (8, '{"g": {"r": {"k": "\\ud800"}}}', None), (1, json.dumps(good), "again")]
    frame = spark.createDataFrame(rows, "id bigint, body string, code string")
    out = shredding.shred_table(frame, "id", "body", "g*.r*", {"code": "k", "born": "d"}, ["gp", "ip"], as_json=True)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    one = [(1, 0, 0, "A", "1941"), (1, 2, 0, None, None), (1, 2, 2, None, "2020-01-01T00:00:00")]
    assert got == sorted(one + one + [(8, 0, 0, "?", None)], key=str)


def test_nested_columns_long_lists_and_no_rows(spark):
    schema = "id bigint, page struct<u:array<struct<nr:string,id:string>>>"
    rows = [(1, ([("a", "x"), None, (None, "y")],)), (2, (None,)), (3, None), (4, ([],)), (5, ([(str(i), None) for i in range(50000)],))]
    frame = spark.createDataFrame(rows, schema)
    out = shredding.shred_table(frame, "id", "page", "u*", {"nr": "nr"}, ["pos"], as_json=False)
    got = [tuple(r) for r in out.orderBy("id", "pos").collect()]
    assert got[:2] == [(1, 0, "a"), (1, 2, None)] and len(got) == 50002 and got[-1] == (5, 49999, "49999")
    assert shredding.shred_table(frame.limit(0), "id", "page", "u*", {"nr": "nr"}, ["pos"], as_json=False).count() == 0
