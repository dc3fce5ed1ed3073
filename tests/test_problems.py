"""The general problems on small rows: nulls, empties, ties, repeats, clashing columns, and brute force."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest

from skein.operators import hierarchy as H
from skein.operators import hot_groups as G
from skein.operators import nested as N
from skein.operators import orphans as O
from skein.operators import snapshots as S
from skein.tables import current_symbols

EDGE = "from_id string, to_id string, kind string, file_path string, line int, indexed_at bigint"
SYM = "id string, parent_id string, metadata string, indexed_at bigint"
HASH = "file_path string, hash string, indexed_at bigint, snapshot_no int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------


def test_keyed_summary_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", None]), "hot" if rnd.random() < 0.5 else rnd.choice("xyz"), rnd.choice(["calls", None]), "f", 1, rnd.choice([None, 5, 9])) for _ in range(3000)]
    df = spark.createDataFrame(data, EDGE)
    want = defaultdict(list)
    for r in data:
        want[r[1], r[2]].append(r)
    got = {(r["to_id"], r["kind"]): tuple(r)[2:] for r in G.keyed_summary(df, ["to_id", "kind"], "from_id", "indexed_at", heavy_share=0.1, salts=3).collect()}
    assert got == {
        k: (len(v), len({x[0] for x in v if x[0]}), min((x[5] for x in v if x[5]), default=None), max((x[5] for x in v if x[5]), default=None))
        for k, v in want.items()
    }


def test_keyed_summary_of_nothing_and_with_clashing_columns(spark):
    empty = spark.createDataFrame([], EDGE)
    assert G.keyed_summary(empty, ["to_id", "kind"], "from_id", "indexed_at").count() == 0
    df = spark.createDataFrame([("a", "b", "c", 1, 2, 3, 4)], "from_id string, to_id string, kind string, _v int, _salt int, n_rows int, indexed_at int")
    assert rows(G.keyed_summary(df, ["to_id", "kind"], "from_id", "indexed_at")) == [("b", "c", 1, 1, 4, 4)]


# 2 ---------------------------------------------------------------------------------------------


def brute_nodes(v, path="", key="", element=False, node="", out=None):
    out = [] if out is None else out
    if isinstance(v, str) and v.strip()[:1] in ("{", "[", '"'):
        try:
            return brute_nodes(json.loads(v), path, key, element, node, out)
        except ValueError:
            return out
    if isinstance(v, dict):
        if element or key in N.ARRAY_FIELDS:
            path += "" if element else "[0]"
            out.append((path, node))
            node = path
        for k, x in v.items():
            brute_nodes(x, f"{path}.{k}" if path else k, k, False, node, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            brute_nodes(x, f"{path}[{i}]", key, True, node, out)
    return out


def random_json(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 4 else 5)
    if kind < 5:
        return rnd.choice([None, True, 1.5, -3, "", "text", '{"args": [{"a": 1}]}', "[oops", '"x"', "é \n\t\""])
    if kind == 5:
        return [random_json(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["args", "name", "params", "a.b", "throws", "x"]): random_json(rnd, depth + 1) for _ in range(rnd.randrange(4))}


def test_triples_against_a_recursive_walk():
    rnd = random.Random(2)
    for _ in range(3000):
        value = random_json(rnd)
        text = json.dumps(value, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
        for _ in range(rnd.randrange(3)):
            text = json.dumps(text)
        got = [(r[1], r[2]) for r in N.record_triples(text) if r[4] == "" and r[2] is not None]
        assert sorted(got) == sorted(brute_nodes(json.loads(text))), text


@pytest.mark.parametrize("bad", ["", None, "{", "{'a':1}", '{"a":1,}', "[1,]", '{"a":01}', '{"a" 1}', "nul", '{"a":1} x', '{"a":"\n"}', "[1 2]", '{"a":NaN}', '"\\x"', "[}", '{"args":[{}]'])
def test_invalid_json_gives_nothing(bad):
    assert N.record_triples(bad) == []


def test_deep_nesting_and_tables(spark):
    deep = '{"args":' * 5000 + "{}" + "}" * 5000
    assert len([r for r in N.record_triples(deep) if r[4] == ""]) == 5000
    df = spark.createDataFrame([("s", '{"params":[{"name":"p","type_args":{"name":"T"}},"q"],"return_type":"R"}', "x")], "id string, metadata string, field string")
    t = N.nested_triples(df)
    assert rows(N.nodes(t)) == [("s", "params", "params[0]", "", 0), ("s", "type_args", "params[0].type_args[0]", "params[0]", 0)]
    assert rows(N.pivot_table(t, ["params"], ["name", "type"])) == [("s", "params[0]", "", 0, "p", None)]
    assert N.nested_triples(df.where("false")).count() == 0


def test_every_array_element_and_field_is_in_one_table(spark):
    text = '{"access":"public","receiver":{"name":"r"},"return_types":["int",null],"decorators":["a",{"name":"b","args":[1],"extra":"e"}],"params":[{"name":"p","attributes":["x"],"[]":"k"}]}'
    t = N.nested_triples(spark.createDataFrame([("s", text)], "id string, metadata string"))
    marks = (["annotations", "decorators", "attributes"], ["name"])
    assert rows(N.pivot_table(t, *marks, elements=True)) == [
        ("s", "decorators[0]", "", 0, None, "a"), ("s", "decorators[1]", "", 1, "b", None), ("s", "params[0].attributes[0]", "params[0]", 0, None, "x"),
    ]
    assert rows(N.pivot_table(t, ["args"], ["key"], elements=True)) == [("s", "decorators[1].args[0]", "decorators[1]", 0, None, "1")]
    assert rows(N.record_fields(t)) == [("s", "access", "public"), ("s", "receiver.name", "r")]
    assert rows(N.remaining(t, [marks, (["args"], ["key"]), (["params"], ["name"])])) == sorted([
        ("s", "decorators", "decorators[1]", None, 1, "extra", "e"), ("s", "params", "params[0]", None, 0, "[]", "k"),
        ("s", "return_types", "return_types[0]", "", 0, "[]", "int"), ("s", "return_types", "return_types[1]", "", 1, "[]", None),
    ], key=repr)
    assert [tuple(r)[2] for r in rows(N.nodes(t))] == ["decorators[1]", "params[0]"]


# 3 ---------------------------------------------------------------------------------------------


def brute_tree(links):
    parent = {i: (p or None) for i, p in links}
    out = {}
    for i in parent:
        way = [i]
        while (p := parent[way[-1]]) in parent and p not in way:
            way.append(p)
        if p not in parent:
            out[i] = (None, None, way[-1], way[::-1])
        else:
            cycle = way[way.index(p) :]
            on = i in cycle
            path = [i] if on else way[: way.index(p) + 1][::-1]
            out[i] = ("on" if on else "below", min(cycle), None, path)
    return out


def brute_descendants(links):
    parent = {i: (p or None) for i, p in links}
    out = set()
    for i in parent:
        way = [i]
        while (p := parent[way[-1]]) in parent and p not in way:
            way.append(p)
            out.add((p, i, len(way) - 1))
    return out


@pytest.mark.parametrize("together", [100, 1])
def test_hierarchy_against_brute_force(spark, together):
    rnd = random.Random(3)
    links = [(f"n{i:02}", rnd.choice([None, "", "gone", f"n{rnd.randrange(60):02}", f"n{max(i - 1, 0):02}"])) for i in range(60)]
    links += [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("s", "s"), ("u", "r3"), ("v", "u"), ("w", "s")]
    df = spark.createDataFrame(links, "id string, parent_id string")
    tree = H.hierarchy(df, largest_together=together, per_bucket=10)
    got = {r["id"]: (r["state"], r["cycle_id"], r["root_id"], r["path"]) for r in tree.collect()}
    assert got == brute_tree(links)
    ids = dict(links)
    assert {r["id"]: r["missing_parent"] for r in tree.collect()} == {i: p if p == "gone" else None for i, p in ids.items()}
    assert {tuple(r) for r in H.descendants(tree).collect()} == brute_descendants(links)
    bare = H.hierarchy(df, paths=False, largest_together=together, per_bucket=10)
    assert rows(bare) == rows(tree.drop("path"))


def test_hierarchy_of_nothing_and_long_chain(spark):
    schema = "id string, parent_id string"
    assert H.hierarchy(spark.createDataFrame([], schema)).count() == 0
    chain = [(f"{i:04}", f"{i - 1:04}" if i else None) for i in range(300)]
    tree = H.hierarchy(spark.createDataFrame(chain, schema))
    assert tree.agg({"depth": "max"}).first()[0] == 299
    assert H.descendants(tree).count() == 300 * 299 // 2


def test_walk_of_a_deep_component_takes_little(spark):
    import resource
    import time

    import pyarrow as pa

    n = H.LARGEST_TOGETHER
    ids = [f"src/some/folder/file{i}.py::name::method::{i}" for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"id": ids, "parent_id": [None, *ids[:-1]], "missing_parent": pa.array([None] * n, pa.string())})
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    deepest = max(max(b["depth"].to_pylist()) for b in H._walk(iter([batch]), False))
    assert deepest == n - 1 and time.time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_current_row_is_the_latest(spark):
    df = spark.createDataFrame([("a", "x", None, 1), ("a", "y", None, 3), ("a", "y", None, 3), (None, "z", None, 9), ("b", None, None, None)], SYM)
    assert rows(current_symbols(df, ["parent_id"])) == [("a", "y"), ("b", None)]


# 4 ---------------------------------------------------------------------------------------------

A, B = "a" * 64, "b" * 64


def test_snapshot_changes(spark):
    data = [
        ("./x//y.ts", A, 1, 1), ("keep", A, 1, 1), ("gone", A, 1, 1), ("twice", A, 1, 1), ("twice", B, 2, 1), ("null", A, 1, 1), (None, A, 1, 1),
        ("x\\y.ts", "SHA256:" + B.upper() + " ", 2, 4), ("keep", f" sha256-{A}\n", 2, 4), ("twice", B, 2, 4), ("null", None, 2, 4), ("new", None, 2, 4),
        ("x/y.ts", B, 3, 9), ("keep", "  ", 3, 9), ("null", B, 3, 9), ("new", A, 3, 9), ("Keep", A, 3, 9), ("gone", A, 3, 9), ("x", A, 1, None),
    ]
    for chunk in (1, 2, 1000):
        got = rows(S.snapshot_changes(spark.createDataFrame(data, HASH), chunk=chunk, per_bucket=3))
        assert got == sorted([
            (4, "changed", "x/y.ts"), (4, "removed", "gone"), (4, "added", "new"),
            (9, "changed", "null"), (9, "added", "Keep"), (9, "added", "gone"), (9, "removed", "twice"),
        ], key=repr)
    assert S.snapshot_changes(spark.createDataFrame([], HASH)).count() == 0


# 6 ---------------------------------------------------------------------------------------------


def test_orphans_direct_and_inherited(spark):
    sym = [("f::a::class::1", "f::gone::class::1", None, 10), ("f::b::method::2", "f::a::class::1", None, 10), ("f::c::method::3", "f::b::method::2", None, 10), ("f::late::class::9", "", None, 50)]
    edge = [
        ("f::b::method::2", "f::late::class::9", "calls", "f", 1, 20), ("f::b::method::2", "f::late::class::9", "calls", "f", 1, 60), ("f::x::class::7", "len", "calls", "f", None, 20),
        ("f::__module__::function", "f::old::class::4", "calls", "f", 1, 20), ("f::__module__::function", "f::c::method::3", "calls", "f", 1, 20), (None, None, "calls", "f", 1, 20),
        ("f::late::class::9", "a::b::nokind::3", "calls", "f", 1, 60),
    ]
    removed = spark.createDataFrame([("f::old::class::4", 1), ("f::late::class::9", 1), (None, 2)], "id string, removed_at bigint")
    found = O.orphans(spark.createDataFrame(sym, SYM), spark.createDataFrame(edge, EDGE), removed)
    assert rows(O.direct_orphans(found)) == sorted([
        ("edges.from_id", "f::x::class::7", "f::x::class::7", "missing", "1970-01"),
        ("edges.to_id", "f::__module__::function", "f::old::class::4", "removed", "1970-01"),
        ("edges.to_id", "f::b::method::2", "f::late::class::9", "late", "1970-01"),
        ("symbols.parent_id", "f::a::class::1", "f::gone::class::1", "missing", "1970-01"),
    ], key=repr)
    inherited = {(r["ref_field"], r["holder_id"], r["missing_id"]): (r["level"], r["n_rows"]) for r in found.where("level > 0").collect()}
    assert inherited == {
        ("symbols.parent_id", "f::b::method::2", "f::a::class::1"): (2, 1),
        ("symbols.parent_id", "f::c::method::3", "f::b::method::2"): (3, 1),
        ("edges.from_id", "f::b::method::2", "f::b::method::2"): (2, 2),
        ("edges.to_id", "f::b::method::2", "f::late::class::9"): (2, 1),
        ("edges.to_id", "f::__module__::function", "f::c::method::3"): (3, 1),
    }
    none = O.orphans(spark.createDataFrame([], SYM), spark.createDataFrame([], EDGE), removed.where("false"))
    assert none.count() == 0


def test_cascade_against_brute_force(spark):
    rnd = random.Random(6)
    for deep in (2, 40):
        links = [(f"n{i}", f"n{rnd.randrange(max(i - deep, 0), i) if i % 17 else rnd.randrange(90)}" if i else "gone") for i in range(90)]
        held = {(i, p) for i, p in links if rnd.random() < 0.08}
        parent, level = dict(links), {i: 1 for i, _ in held}
        for i in parent:
            way = [i]
            while way[-1] in parent and way[-1] not in {h for h, _ in held} and parent[way[-1]] not in way:
                way.append(parent[way[-1]])
            if way[-1] in {h for h, _ in held}:
                level[i] = len(way)
        s = "id string, parent_id string"
        assert dict(O.orphaned_records(spark.createDataFrame(links, s), spark.createDataFrame(sorted(held), s)).collect()) == level


def test_tables_of_earlier_rounds_are_removed(spark):
    import os

    from skein.scale import checkpoint

    one = checkpoint(spark.range(3).toDF("id"))
    two = checkpoint(one.select((one.id + 1).alias("id")), one)
    assert not os.path.exists(one._skein_table) and rows(two) == [(1,), (2,), (3,)]
