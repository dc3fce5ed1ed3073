"""Graph operators on hand-made rows, against brute force and stdlib full-text search."""

from __future__ import annotations

import random
import sqlite3

import pytest

from skein.functions.stem import stem
from skein.operators import graph as G
from skein.operators import report as R
from skein.operators import search as S
from skein.operators import traversal as T
from skein.operators.graph import CodeGraph

SYM = "id string, name string, kind string, file_path string, line_start int, line_end int, signature string, docstring string, parent_id string, language string, metadata string, indexed_at bigint"
EDGE = "from_id string, to_id string, kind string, file_path string, line int, indexed_at bigint"


def sym(name, kind="function", path="src/a/f.ts", line=1, parent=None, at=1, sig=None, doc=None):
    return (f"{path}::{name}::{kind}::{line}", name, kind, path, line, line + 2, sig, doc, parent, "typescript", "{}", at)


def build(spark, symbols, edges):
    return CodeGraph.of_deliveries(spark.createDataFrame(symbols, SYM), spark.createDataFrame(edges, EDGE))


def test_first_edge_wins_and_spellings_count(spark):
    pay, user = sym("pay"), sym("user", line=9)
    edges = [(user[0], "pay", "calls", "f", 7, 5), (user[0], "pay", "calls", "f", 3, 2), (user[0], "svc.pay", "calls", "f", 4, 2), (user[0], "x::pay", "calls", "f", None, 2), (user[0], pay[0], "calls", "f", 8, 2), (user[0], "pay", "imports", "f", 1, 1), (user[0], "Pay", "calls", "f", 1, 1)]
    g = build(spark, [pay, user, (None, *pay[1:])], edges)
    assert {(r["to_id"], r["line"]) for r in g.edges.where("kind = 'calls'").collect()} == {("pay", 3), ("svc.pay", 4), ("x::pay", None), (pay[0], 8), ("Pay", 1)}
    assert [tuple(r) for r in G.caller_counts(g).collect()] == [(pay[0], 3)]
    found = G.refs(g, g.symbols.where("name = 'pay'").select("id")).collect()
    assert len(found) == 5 and {r["from_name"] for r in found} == {"user"}


def test_lookup_prefers_top_level_and_raises(spark):
    a, b = sym("run", "method", "src/b.ts", 3, "src/b.ts::Job::class::1"), sym("run", "function", "src/z.ts", 1)
    g = build(spark, [a, b, sym("Job", "class", "src/b.ts", 1)], [])
    assert G.find_symbol(g, "run").first()["id"] == b[0]
    assert G.find_symbol(g, "Job.run").first()["id"] == a[0]
    assert G.find_by_prefix(g, "src/z.ts::run").first()["id"] == b[0] and not G.find_by_prefix(g, "src/z.ts::ru").count()
    with pytest.raises(G.AmbiguousSymbolError):
        G.resolve_symbol(g, "run")
    with pytest.raises(G.SymbolNotFoundError):
        G.resolve_symbol(g, "nothing")
    assert G.resolve_symbol(g, "src/b.ts::run").first()["id"] == a[0]


def test_traversals_on_cycles_and_diamonds(spark):
    s = {n: sym(n, line=i + 1) for i, n in enumerate("abcde")}
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e"), ("a", "a")]
    edges = [(s[x][0], s[y][0], "calls", "src/a/f.ts", 1, 1) for x, y in links] + [("src/a/f.ts::__module__::function", "lib", "imports", "f", 1, 1)]
    g = build(spark, list(s.values()), edges)
    one = lambda n: g.symbols.where(f"name = '{n}'").select("id")
    deps = {(r["name"], r["kind"]): r["depth"] for r in T.transitive_deps(g, one("a"), 5).collect()}
    assert deps == {("b", "calls"): 1, ("d", "calls"): 1, ("lib", "imports"): 1, ("c", "calls"): 2, ("e", "calls"): 3}
    assert {r["name"]: r["depth"] for r in T.impact(g, one("e"), 5).collect()} == {"c": 1, "b": 2, "d": 2, "a": 3}
    paths = {tuple(i.split("::")[1] for i in r["path"]) for r in T.flow(g, one("a"), one("e"), 6).collect()}
    assert paths == {tuple("abce"), tuple("adce")}
    assert T.flow(g, one("e"), one("a"), 6).count() == 0
    assert T.transitive_deps(build(spark, [], []), one("a").where("false")).count() == 0


def test_trace_goes_back_to_uncalled_code(spark):
    s = {n: sym(n, line=i + 1) for i, n in enumerate("abcdx")}
    links = [("a", "svc.x"), ("b", "a"), ("c", "b"), ("d", s["a"][0]), ("c", "c")]
    g = build(spark, list(s.values()), [(s[f][0], to, "calls", "src/a/f.ts", 1, 1) for f, to in links])
    got = {tuple(i.split("::")[1] for i in r["path"].split(" > ")) for r in T.trace(g, g.symbols.where("name = 'x'").select("id"), 5).collect()}
    assert got == {("d", "a", "x")}  # c calls itself, so it is called and starts nothing
    assert T.trace(g, g.symbols.where("name = 'd'").select("id"), 5).count() == 0


def test_random_graphs_against_enumeration(spark):
    rnd = random.Random(5)
    s = [sym(f"n{i}", line=i + 1) for i in range(12)]
    pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(22)}
    g = build(spark, s, [(s[a][0], s[b][0], "calls", "f", 1, 1) for a, b in pairs])

    def walk(path, left):
        if left:
            for a, b in pairs:
                if a == path[-1] and b not in path:
                    yield [*path, b]
                    yield from walk([*path, b], left - 1)

    every = g.symbols.select("id")
    got = sorted([int(i.split("::")[1][1:]) for i in r["path"]] for r in T.flow(g, every, every, 4).collect())
    assert got == sorted(p for i in range(12) for p in walk([i], 4))


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electricity", "electr"), ("adjustment", "adjust"), ("controller", "control"), ("sky", "sky"), ("ab", "ab")])
def test_stem(word, want):
    assert stem(word) == want


def test_ranks_equal_full_text_search(spark):
    rnd = random.Random(6)
    words = "retry invoice payment sending loaded tables process shards relational controllers quickly".split()
    s = [sym("_".join(rnd.sample(words, 2)), line=i + 1, sig=" ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for i in range(60)]
    docs = S.document_texts(build(spark, s, []))
    rows = [(r["id"], r["name"], r["body"]) for r in docs.collect()]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, name, kind unindexed, file unindexed, body, tokenize = 'porter unicode61')")
    con.executemany("insert into t values (?, ?, '', '', ?)", rows)
    for query in ("retry", "payment_retry", "tabl loading", "controller"):
        asked = S.expand_query(query)
        match = " OR ".join('"' + " ".join(w for w in q.split()) + '"*' for q in [" ".join(p) for p in asked])
        want = dict(con.execute("select id, bm25(t, 0, 5, 0, 2, 10) from t where t match ?", (match,)))
        got = {r["id"]: r["rank"] for r in S.ranked(docs, asked).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert S.find(build(spark, s, []), "  ").count() == 0


def test_flow_keeps_the_first_paths_of_each_pair(spark):
    rnd = random.Random(8)
    s = [sym(f"n{i}", line=i + 1) for i in range(9)]
    g = build(spark, s, [(s[a][0], s[b][0], "calls", "f", 1, 1) for a in range(9) for b in range(9) if rnd.random() < 0.45])
    every = g.symbols.select("id")
    key = lambda r: (r["start"], r["end"])
    whole, some = T.flow(g, every, every, 5, None).collect(), T.flow(g, every, every, 5, 3).collect()
    want = {}
    for r in sorted(whole, key=lambda r: (r["n_steps"], r["path"])):
        want.setdefault(key(r), []).append(r["path"])
    got = {}
    for r in sorted(some, key=lambda r: (r["n_steps"], r["path"])):
        got.setdefault(key(r), []).append(r["path"])
    assert max(map(len, want.values())) > 3 and got == {k: v[:3] for k, v in want.items()}


def test_files_and_sketches(spark):
    box = sym("Box", "class", "src/b.ts", 1)
    box_open, use = sym("open", "method", "src/b.ts", 3, box[0]), sym("use", "function", "src/u.ts", 1)
    face, kind, red = sym("Face", "interface", "src/b.ts", 9), sym("Tone", "enum", "src/b.ts", 20), sym("Red", "variant", "src/b.ts", 21, "src/b.ts::Tone::enum::20")
    edges = [(use[0], "box.open", "calls", "src/u.ts", 2, 1), (use[0], "Box", "instantiates", "src/u.ts", 2, 1), (box[0], face[0], "implements", "src/b.ts", 1, 1), ("src/u.ts::__module__::function", "./b::Box", "imports", "src/u.ts", 1, 1), (box_open[0], "lib", "calls", "src/b.ts", 4, 1)]
    g = build(spark, [box, box_open, use, face, kind, red], edges)
    found = {(r["target"], r["to_id"]) for r in G.file_refs(g).collect()}
    assert found == {("src/b.ts", "box.open"), ("src/b.ts", "Box"), ("src/b.ts", face[0]), ("src/b.ts", "./b::Box")}
    assert {(r["target"], r["name"], r["is_external"]) for r in G.file_deps(g).collect()} == {("src/u.ts", "box.open", True), ("src/u.ts", "Box", False), ("src/u.ts", "Box", True), ("src/b.ts", "lib", True)}
    first = G.first_refs(G.refs(g, g.symbols.select("id")), limit=1).where(f"target = '{box[0]}'").collect()
    assert [(r["place"], r["total"], r["kind"]) for r in first] == [(1, 3, "calls")]
    told = {(r["id"].split("::")[1], r["section"], r["item"], r["n"]) for r in R.sketches(g).collect()}
    assert told == {
        ("Box", "member", box_open[0], 1), ("Box", "implements", "Face", None), ("Box", "depends", "lib", None), ("open", "calls", "lib", None), ("open", "called_by", "use", 1),
        ("use", "calls", "box.open", None), ("Face", "implementor", box[0], None), ("Tone", "variant", red[0], None), ("Tone", "callers", "callers", 0),
    }
    none = build(spark, [], [])
    assert R.sketches(none).count() == 0 and G.file_refs(none).count() == 0 and G.file_deps(none).count() == 0


def test_projects_are_ranked_by_themselves(spark):
    s = [sym(f"retry{i}", path=f"{p}/f.ts", line=i + 1, sig="invoice " * (i % 3)) for p, n in (("one", 9), ("two", 4)) for i in range(n)]
    g = build(spark, s, [])
    both = {r["id"]: r["rank"] for r in S.find_in_projects(g, "invoice", 99).collect()}
    for p in ("one", "two"):
        alone = CodeGraph(g.symbols.where(f"file_path = '{p}/f.ts'"), g.edges)
        want = {r["id"]: r["rank"] for r in S.find(alone, "invoice", limit=99).collect()}
        assert want and all(abs(both[i] - x) < 1e-9 for i, x in want.items())
    assert S.find_in_projects(g, " ").count() == 0
