"""Extraction from small sources of our own, one per language."""

from __future__ import annotations

from skein.extract import source as X

TS = """import { Store, Clock as C } from '../kit/store';

/** Keeps parcels. */
export class Depot extends Base implements Openable, Countable {
  private store: Store;
  count = 0;

  constructor(store: Store) {
    super(store);
    this.store = store;
  }

  // opens it
  async open(key: string): Promise<Parcel> {
    this.check(key);
    const p = new Parcel(key);
    this.store.put(p);
    log("f(x) {");
    return p;
  }

  check(key: string): void {}
}

enum Phase { Idle, Busy = 'b' }
type Id = string;
export const weigh = (p: Parcel): number => p.size();
function main() { helper.run(); }
main();
"""
PY = '''from kit.store import Store, Clock
import os

class Depot(Base):
    """Keeps parcels."""

    def open(self, key: str) -> int:
        """Opens it."""
        self.check(key)
        return load(key)

    async def _check(self, key):
        os.stat(key)
        self.store.put(key)
'''
GO = """package depot

import (
\t"fmt"
\t"kit/store"
)

// Depot keeps parcels.
// Always.
type Depot struct {
\tBase
\tname string
}

const Limit = 3

func (d *Depot) Open(key string) int {
\tfmt.Println(key)
\treturn load(key)
}

func load(key string) int { return 1 }
"""
JAVA = """package a;
import kit.Store;

/** Keeps parcels. */
public class Depot extends Base implements Openable {
    private Store store;

    public int open(String key) throws Fault {
        store.put(key);
        this.check(key);
        return new Parcel(key).size();
    }

    void check(String key) {
        switch (key) { case READY: break; }
    }
}

enum Phase { IDLE, BUSY(2); }
"""
CS = """using Kit.Store;

namespace A
{
    /// <summary>Keeps parcels.</summary>
    public class Depot : Base, IOpen
    {
        public int Count { get; set; }

        public async Task<int> Open(string key)
        {
            store.Put(key);
            this.Check(key);
            switch (key) { case Phase.Idle: return 1; }
            return new Parcel(key);
        }
    }

    public enum Phase { Idle, Busy }
    public struct Cell { }
}
"""
RUST = """use crate::kit::Store;

/// Keeps parcels.
pub struct Depot { store: Store }

pub trait Open { fn open(&self) -> u32; }

pub enum Phase { Idle, Busy(u8) }

const LIMIT: u32 = 3;

impl Depot {
    pub fn new(store: Store) -> Depot { Depot { store } }
    fn put(&self, key: &str) {
        self.store.put(key);
        println!("{}", key);
        let d = Depot::new(Store::open());
    }
}

impl Open for Depot {
    fn open(&self) -> u32 { weigh(1) }
}

fn weigh(n: u32) -> u32 { n }
"""


def both(path, text, language):
    rows = list(X.extract(path, text, language))
    symbols = {(r[2], r[3]): r for r in rows if r[0] == "symbol"}
    edges = {(r[12].split("::")[1], r[13], r[3]) for r in rows if r[0] == "edge"}
    return symbols, edges


def test_typescript():
    s, e = both("a/d.ts", TS, "typescript")
    assert set(s) == {("Depot", "class"), ("store", "property"), ("count", "property"), ("constructor", "method"), ("open", "method"), ("check", "method"), ("Phase", "enum"), ("Idle", "variant"), ("Busy", "variant"), ("Id", "type"), ("weigh", "function"), ("main", "function")}
    assert s["open", "method"][5:7] == (14, 20) and s["open", "method"][9] == "a/d.ts::Depot::class::4"
    assert s["Depot", "class"][8] == "/** Keeps parcels. */" and s["open", "method"][8] == "// opens it"
    assert s["open", "method"][7] == "async open(key: string): Promise<Parcel>"
    assert {("__module__", "../kit/store::Store", "imports"), ("__module__", "../kit/store::Clock", "imports"), ("Depot", "Base", "extends"), ("Depot", "Openable", "implements"), ("Depot", "Countable", "implements"),
            ("open", "check", "calls"), ("open", "Parcel", "instantiates"), ("open", "store.put", "calls"), ("open", "log", "calls"), ("main", "helper.run", "calls"), ("__module__", "main", "calls"), ("weigh", "p.size", "calls"), ("constructor", "Store", "references_type")} <= e
    assert not any(to == "f" for _, to, _ in e)


def test_python():
    s, e = both("a/d.py", PY, "python")
    assert set(s) == {("Depot", "class"), ("open", "function"), ("_check", "function")}
    assert s["open", "function"][8] == "Opens it." and s["Depot", "class"][8] == "Keeps parcels." and s["open", "function"][9] is None
    assert '"access": "private"' in s["_check", "function"][11] and '"is_async": true' in s["_check", "function"][11]
    assert e == {("__module__", "kit.store::Store", "imports"), ("__module__", "kit.store::Clock", "imports"), ("__module__", "os", "imports"), ("Depot", "Base", "extends"), ("open", "self.check", "calls"), ("open", "load", "calls"), ("_check", "os.stat", "calls")}


def test_go():
    s, e = both("a/d.go", GO, "go")
    assert set(s) == {("Depot", "struct"), ("Limit", "const"), ("Open", "method"), ("load", "function")}
    assert s["Depot", "struct"][8] == "Depot keeps parcels.\nAlways."
    assert {("__module__", "fmt", "imports"), ("__module__", "kit/store", "imports"), ("Depot", "Base", "extends"), ("Depot", "string", "extends"), ("Open", "fmt.Println", "calls"), ("Open", "load", "calls")} <= e


def test_java():
    s, e = both("a/D.java", JAVA, "java")
    assert set(s) == {("Depot", "class"), ("store", "property"), ("open", "method"), ("check", "method"), ("Phase", "enum"), ("IDLE", "variant"), ("BUSY", "variant")}
    assert {("__module__", "kit.Store", "imports"), ("Depot", "Base", "extends"), ("Depot", "Openable", "implements"), ("open", "store.put", "calls"), ("open", "put", "calls"), ("open", "check", "calls"), ("open", "Parcel", "instantiates"), ("check", "READY", "references")} <= e


def test_csharp():
    s, e = both("a/D.cs", CS, "csharp")
    assert set(s) == {("Depot", "class"), ("Count", "property"), ("Open", "method"), ("Phase", "enum"), ("Idle", "variant"), ("Busy", "variant"), ("Cell", "struct")}
    assert {("__module__", "Kit.Store", "imports"), ("Depot", "Base", "implements"), ("Depot", "IOpen", "implements"), ("Open", "store.Put", "calls"), ("Open", "Check", "calls"), ("Open", "Idle", "references"), ("Open", "Parcel", "instantiates")} <= e


def test_rust():
    s, e = both("a/d.rs", RUST, "rust")
    assert set(s) == {("Depot", "struct"), ("Open", "interface"), ("Phase", "enum"), ("Idle", "variant"), ("Busy", "variant"), ("LIMIT", "const"), ("new", "method"), ("put", "method"), ("open", "method"), ("weigh", "function")}
    assert s["put", "method"][9] == "a/d.rs::Depot::struct::4"
    assert {("__module__", "crate::kit::Store", "imports"), ("Depot", "Open", "implements"), ("put", "put", "calls"), ("put", "println!", "calls"), ("put", "Depot::new", "calls"), ("put", "Store::open", "calls"), ("open", "weigh", "calls")} <= e


def test_broken_and_empty_files(spark):
    files = [("a.ts", "class {{{ function ("), ("b.py", ""), ("c.txt", "def f(): pass"), (None, "x"), ("d.rs", None), ("e.go", "func f() {\n f()\n f()\n}")]
    rows = X.extract_rows(spark.createDataFrame(files, "file_path string, text string"))
    assert [tuple(r)[:3] + (r["line"],) for r in X.extracted_edges(rows).where("file_path = 'e.go'").collect()] == [("e.go::f::function::1", "f", "calls", 2)]
    assert X.extract_rows(spark.createDataFrame([], "file_path string, text string")).count() == 0
