"""Queries that pair many references with many symbols: right on keys of every sort, and no pair is sorted out after it is made."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import graph as G
from skein.operators import report as R
from skein import scale
from skein.scale import join_pairs, likely_in
from test_graph import build, sym


@pytest.fixture
def hot(spark, tmp_path_factory):
    """40 functions called alike, classes with members, ids that are called beside names, and spellings that fit several names; also as a folder."""
    rng = random.Random(5)
    many = [sym("run", path=f"src/m{i}.ts", line=i + 1) for i in range(40)]
    boxes = [sym("Box", "class", f"src/b{i}.ts") for i in range(3)]
    members = [sym(n, "method", f"src/b{i}.ts", 5, boxes[i][0]) for i in range(3) for n in ("open", "run")] + [sym("a.open", line=70), sym("x.run", line=90)]
    symbols = many + boxes + members
    spelled = ["run", "x.run", "y::x.run", "a.open", "Box", "lib.open", "nothing", *[s[0] for s in rng.sample(symbols, 12)]]
    ids = [s[0] for s in symbols] + ["src/m1.ts::__module__::function"]
    edges = [(rng.choice(ids), rng.choice(spelled), rng.choice(["calls", "imports", "extends"]), rng.choice("fgh"), rng.choice([None, 1, 2, 3]), i) for i in range(700)]
    g = build(spark, symbols, edges)
    folder = tmp_path_factory.mktemp("hot")
    from test_graph import EDGE, SYM
    spark.createDataFrame(symbols, SYM).write.parquet(f"{folder}/symbols.parquet")
    spark.createDataFrame(edges, EDGE).write.parquet(f"{folder}/edges.parquet")
    return g, str(folder), symbols


def tails(x):
    return {x} | {m.join(x.split(m)[i:]) for m in ("::", ".") for i in range(1, len(x.split(m)))} - {""}


def brute(g, symbols):
    """(target, from_id, to_id, kind): all references by their definition."""
    keys = {s[0]: {s[0], s[1]} | ({k for m in symbols if m[8] == s[0] for k in m[:2]} if s[2] == "class" else set()) for s in symbols}
    return {(t, e["from_id"], e["to_id"], e["kind"]) for e in g.edges.collect() for t, k in keys.items() if tails(e["to_id"]) & k}


def shuffled_by(df, *columns):
    """Exchanges by one of the columns that come after the last join by group or name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and x.split("hashpartitioning(")[1].split("#")[0] in columns]


def test_grouped_first_references_equal_those_of_all_pairs(spark, hot):
    g, folder, symbols = hot
    found = G.refs(g, g.symbols.select("id"))
    want = {(r["target"], r["kind"]): (r["shown"], r["total"], [tuple(x) for x in r["refs"]]) for r in G.top_refs(found, 20).collect()}
    got = G.top_refs_of(*G.grouped_refs(g, G.match_names(g, g.symbols.select("id"))), 20).collect()
    got = {(r["target"], r["kind"]): (r["shown"], r["total"], [(x["place"], x["file_path"], x["line"], x["from_name"], x["to_id"]) for x in r["refs"]]) for r in got}
    assert got == want and len(want) > 40


def test_first_references_of_two_kinds(spark, hot):
    g, folder, symbols = hot
    found = {(r["target"], r["place"], r["from_id"], r["to_id"], r["kind"], r["total"]) for r in G.first_refs(G.refs(g, g.symbols.select("id"), ["calls", "instantiates"])).collect()}
    q = entry.queries()["q01_refs_first"](spark, folder)
    assert {tuple(r) for r in q.collect()} == found and len(found) > 40
    assert "windowspecdefinition(target" not in q._jdf.queryExecution().executedPlan().toString()


def test_callers_are_not_shuffled_once_paired(spark, hot):
    g, folder, symbols = hot
    q = entry.queries()["q04_callers"](spark, folder)
    assert sorted((r["target"], r["from_id"], r["to_id"]) for r in q.collect()) == sorted(x[:3] for x in brute(g, symbols) if x[3] == "calls")
    assert not shuffled_by(q, "target")


def test_keys_with_many_pairs_are_shared_out(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(100).select((F.col("id") % 4).alias("k"), F.col("id").alias("b"))
    same = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()))
    assert same(join_pairs(left, right, "k", 50)) == same(join_pairs(left, right, "k")) == same(left.join(right, "k"))


def test_callers_in_sketches_are_summed_up_by_name(spark, hot):
    g, folder, symbols = hot
    code = [s for s in symbols if s[2] in ("function", "method")]
    names = {s[0]: (s[1] if s[8] is None else "Box." + s[1]) for s in symbols}
    want = {}
    for e in g.edges.where("kind = 'calls'").collect():
        who = names.get(e["from_id"], "m1")
        for s in code:
            for k in {s[0], s[1]}:
                n = (e["to_id"] == k) + ("." in e["to_id"] and e["to_id"].rpartition(".")[2] == k)
                if n:
                    want[s[0], who] = want.get((s[0], who), 0) + n
    df = R.sketches(g)
    got = [((r["id"], r["item"]), r["n"]) for r in df.where("section = 'called_by'").collect()]
    assert dict(got) == want and len(got) == len(want) > 100
    assert "hashpartitioning(from_id" not in R.shown_callers(g, g.symbols.where("kind = 'method'").select("id", "name"))._jdf.queryExecution().executedPlan().toString()


def test_references_are_not_shuffled_once_paired(spark, hot):
    g, folder, symbols = hot
    q = entry.queries()["q01_refs"](spark, folder)
    assert sorted((r["target"], r["from_id"], r["to_id"], r["kind"]) for r in q.collect()) == sorted(brute(g, symbols))
    assert not shuffled_by(q, "target")


def test_first_references_of_files(spark, hot):
    g, folder, symbols = hot
    found = {(r["target"], r["place"], r["from_id"], r["to_id"], r["kind"], r["line"], r["total"]) for r in G.first_refs(G.file_refs(g)).collect()}
    q = entry.queries()["q03_file_refs"](spark, folder)
    assert {tuple(r) for r in q.collect()} == found and len(found) > 40
    assert not shuffled_by(G.file_refs(g), "target")


def test_first_references_of_files_write_only_what_is_read(spark, hot, monkeypatch):
    """Edges that fit nothing aren't written at all, and tables that were read to the end don't stay beside the result."""
    g, folder, symbols = hot
    written = []
    kept = G.checkpoint
    monkeypatch.setattr(G, "checkpoint", lambda df, replaces=None: written.append((df.columns, (out := kept(df, replaces)).count())) or out)
    before = set(scale._written)
    G.first_refs_of(*G.grouped_refs(g, G.file_names(g), named=False)).count()
    fits = {k for s in symbols for k in s[:2]}
    n = sum(bool(tails(e["to_id"]) & fits) for e in g.edges.collect())
    assert [x for cols, x in written if "line" in cols][0] == n < g.edges.count()
    assert len(set(scale._written) - before) == 2 and not any("from_name" in cols for cols, _ in written)


def test_rows_of_other_values_are_left_out_where_they_are_read(spark, hot):
    g, folder, symbols = hot
    rows = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("v"), "id")
    values = rows.where("id % 7 = 0").select("v")
    got = {r["id"] for r in likely_in(rows, values, "v").collect()}
    assert {i for i in range(20_000) if i % 7 == 0} <= got and len(got) < 3_500
    assert not likely_in(rows, values.where("false"), "v").count()
    plan = likely_in(g.edges, g.edges.select("to_id").limit(3), "to_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [from_id") < plan.index("Join LeftSemi")


def test_impact_is_not_shuffled_once_paired(spark, hot):
    """Keys of a target that reach one symbol at different depths, a target's own members, and names of many targets."""
    g, folder, symbols = hot
    known = {s[0] for s in symbols}
    edges = [(e["from_id"], e["to_id"]) for e in g.edges.collect() if e["from_id"] in known]
    own = {s[0]: {s[0], s[1]} | ({k for m in symbols if m[8] == s[0] for k in m[:2]} if s[2] == "class" else set()) for s in symbols}
    want = {}
    for t, keys in own.items():
        level, depth = {a for a, b in edges if tails(b) & keys}, 1
        while level and depth <= 3:
            for i in level:
                want.setdefault((t, i), depth)
            level, depth = {a for a, b in edges if b in level}, depth + 1
    want = {(t, i, d) for (t, i), d in want.items() if i not in own[t]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        q = entry.queries()["q08_impact"](spark, folder)
        assert not shuffled_by(q, "target", "id", "n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = [(r["target"], r["id"], r["depth"]) for r in q.collect()]
    assert sorted(got) == sorted(want) and {d for *_, d in want} == {1, 2, 3}
