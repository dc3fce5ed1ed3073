"""Listing, configuration, logs and the re-indexing stream."""

from __future__ import annotations

import json

import pytest

from skein.operators import behaviour as B
from skein.sources import config as C
from skein.sources import files as Files
from skein.sources import logs as L
from skein.streaming import reindex as R


def test_listing_honours_ignore_rules(spark, tmp_path):
    for name in ("a/b.py", "a/c.txt", "a/gen/x.ts", "a/gen/keep.ts", ".hid/x.py", "lib/y.go", "n/p/z.rs", "out.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# é\n")
    (tmp_path / ".gitignore").write_text("# c\n/out.py\n**/gen/*\n!keep.ts\n")
    (tmp_path / "n/p/.skein").mkdir()
    (tmp_path / "n/p/.skein/config.toml").write_text("")
    nested = Files.nested_projects(str(tmp_path))
    assert nested == ["n/p"]
    rows = Files.source_files(spark, str(tmp_path), ["lib/**"], nested=nested).collect()
    assert sorted((r["file_path"], r["text"]) for r in rows) == [("a/b.py", "# é\n"), ("a/gen/keep.ts", "# é\n")]
    with pytest.raises(ValueError):
        Files.git_changed_files(spark, str(tmp_path), "--output=x")


def test_workspace_manifest(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two/in").mkdir(parents=True)
    f = tmp_path / "w.toml"
    C.write_workspace(str(f), "w", [C.Member("two", 'b"'), C.Member("one", "a")])
    assert C.read_workspace(str(f)) == [C.Member("one", "a"), C.Member("two", 'b"')]
    for members in ([C.Member("one", "a"), C.Member("two", "a")], [C.Member("gone", "a")], [C.Member("two", "a"), C.Member("two/in", "b")]):
        C.write_workspace(str(f), "w", members)
        with pytest.raises(ValueError):
            C.read_workspace(str(f))


def test_logs(spark):
    use = lambda *b: json.dumps({"message": {"content": [{"type": "tool_use", "name": n, "input": i} for n, i in b], "usage": {"input_tokens": 3}}})
    lines = [("r", 1, use(("Read", {"file_path": "a"}), ("Grep", {"pattern": "p"}))), ("r", 2, "{broken"), ("r", 3, use(("Edit", {"file_path": "a"}))), ("r", 4, '{"type": "result", "result": {"usage": {"output_tokens": 5}}}'), ("r", 5, " "), ("e", 1, "x")]
    df = spark.createDataFrame(lines, "run string, line_no int, value string")
    stats = {r["run"]: (r["n_lines"], r["n_malformed"], r["input_tokens"], r["output_tokens"]) for r in L.line_stats(df).collect()}
    assert stats == {"r": (4, 1, 6, 5), "e": (1, 1, 0, 0)}
    acts = L.actions(df)
    assert [(r["seq"], r["tool"], r["argument"]) for r in acts.orderBy("seq").collect()] == [(1, "Read", "a"), (2, "Grep", "p"), (3, "Edit", "a")]
    r = B.run_summary(acts).first()
    assert (r["n_actions"], r["before_edit"], r["looks_per_edit"]) == (3, 2, 2.0)
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n"
    got = L.changed_lines(spark.createDataFrame([("r", diff), ("s", None)], "run string, diff string"))
    assert sorted((g["file_path"], g["line"]) for g in got.collect()) == [("x", 2), ("x", 3)]


def test_stream_equals_batch(spark, tmp_path):
    src = "def f():\n    g()\n"
    batches = [
        [("a.py", src, "added", 1), ("b.py", src, "added", 2), ("b.py", "def h():\n    f()\n", "modified", 3)],
        [("a.py", None, "deleted", 4), ("c.txt", "x", "added", 5), (None, "x", "added", 6)],
        [("b.py", "class K:\n    pass\n", "modified", 7)],
    ]
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    stream = spark.readStream.schema(R.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    query = R.start(stream, out, str(tmp_path / "ckpt"))
    try:
        for rows in batches:
            spark.createDataFrame(rows, R.CHANGE).coalesce(1).write.mode("append").parquet(str(inbox))
            query.processAllAvailable()
        now = R.indexed(spark, out)
        ids = lambda g: sorted(r["id"] for r in g.symbols.collect())
        assert ids(now) == ["b.py::K::class::1"] and now.edges.count() == 0
        assert ids(R.indexed(spark, out, 1)) == ["a.py::f::function::1", "b.py::h::function::1"]
    finally:
        query.stop()
    everything = spark.createDataFrame([r for b in batches for r in b], R.CHANGE)
    empty = R.indexed(spark, str(tmp_path / "none"))
    assert ids(R.apply_changes(empty, everything)) == ids(now)
