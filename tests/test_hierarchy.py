import random

import pytest

from kvern.operators import hierarchy

COLUMNS = "child string, parent string, at int"


def build(spark, rows, columns=COLUMNS):
    frame = spark.createDataFrame(rows, columns)
    out = hierarchy.build_hierarchy(frame, "child", "parent", "at")
    return {r.node: r for r in out.collect()}, out


def naive(rows):
    parent = {}
    for child, up, at in rows:
        child, up = (("".join(x.split()) or None) if x else None for x in (child, up))
        if up:
            parent.setdefault(up, (-1, None))
        if child:
            now = parent.get(child, (-2, None))
            parent[child] = max(now, (at, up), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    out = {}
    for node in parent:
        path, at = [node], parent[node][1]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at][1]
        if at is None:
            out[node] = ("tree", path[::-1])
        else:
            out[node] = ("cycle" if at == node else "below_cycle", [])
    return out


@pytest.fixture(params=[hierarchy.TAIL_BYTES, 0], ids=["tail in one task", "batches only"], autouse=True)
def tail(request, monkeypatch):
    monkeypatch.setattr(hierarchy, "TAIL_BYTES", request.param)


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_equal_a_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"n{i}", f"n{rnd.randrange(40)}" if rnd.random() < 0.8 else None, i) for i in range(40)]
    rows += [(f" n {i}", f"n{rnd.randrange(40)}", 50 + i) for i in range(6)]  # corrections, numbers with blanks
    expected = naive(rows)
    got, out = build(spark, rows)
    assert {n: (r.status, r.path) for n, r in got.items()} == expected
    for node, (status, path) in expected.items():
        r = got[node]
        assert (r.root, r.depth) == ((path[0], len(path) - 1) if status == "tree" else ("", -1))
        if status == "tree":
            assert r.subtree_size == sum(node in p for s, p in expected.values())
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(spark.createDataFrame(rows, COLUMNS), "child", "parent", "at").collect()}
    inside = {n for n, (s, _) in expected.items() if s == "tree"}
    assert {p for p in pairs if p[1] in inside} == {(p[k], p[-1], len(p) - 1 - k) for s, p in expected.values() for k in range(len(p) - 1)}


def walked(rows):
    """All pairs, by a walk up from each node until it comes round."""
    parent = {}
    for child, up, _ in rows:
        parent.setdefault(up, None)
        parent[child] = up
    out = set()
    for node in parent:
        at, seen, n = parent[node], {node}, 1
        while at is not None and at not in seen:
            out.add((at, node, n))
            seen.add(at)
            at, n = parent[at], n + 1
    return out


def test_nodes_on_and_below_circles_have_their_pairs(spark):
    rnd = random.Random(5)
    rows = [(f"c{k}", f"c{(k + 1) % 7}", 0) for k in range(7)] + [("d0", "d1", 0), ("d1", "d0", 0), ("s", "s", 0)]
    rows += [(f"n{k}", rnd.choice(["c3", "d0", "s", "top", *(f"n{j}" for j in range(k))]), 0) for k in range(60)]
    rows += [(f"deep{k}", f"deep{k - 1}" if k else "c1", 0) for k in range(20)]  # deeper than a batch
    frame = spark.createDataFrame(rows, COLUMNS)
    got = [tuple(r) for r in hierarchy.descendants(frame, "child", "parent", "at").select("ancestor", "descendant", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows)


def test_a_chain_deeper_than_several_batches(spark):
    got, _ = build(spark, [(f"n{i}", f"n{i + 1}", 0) for i in range(30)])
    assert got["n0"].depth == 30 and got["n0"].root == "n30" and got["n30"].subtree_size == 31


def test_a_parent_with_most_children(spark):
    got, _ = build(spark, [(f"n{i}", "top", 0) for i in range(2000)])
    assert got["top"].subtree_size == 2001 and {r.depth for n, r in got.items() if n != "top"} == {1}


def test_nulls_blanks_repeats_and_loops(spark):
    rows = [("a", None, 1), ("a", None, 1), ("b", "", 1), (None, "c", 1), (None, None, 1), ("d", "d", 1), ("e", "d", None), ("f", " ", 1)]
    got, _ = build(spark, rows)
    assert {n: r.status for n, r in got.items()} == {"a": "tree", "b": "tree", "c": "tree", "d": "cycle", "e": "below_cycle", "f": "tree"}


def test_empty_table_and_other_columns(spark):
    assert build(spark, [])[0] == {}
    got, _ = build(spark, [("a", "b", 1, "x", 7)], COLUMNS + ", node string, level int")
    assert got["a"].root == "b"
