"""Symbols and edges of source files, file by file in parallel.

A file is read without its comments and strings; declarations come from the
language's patterns, their extents from braces or indentation, members from the
nesting of extents, and references from what stands inside them.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.extract.languages import LANGUAGES, Language, keyword, patterns
from skein.functions.text import language_of
from skein.session import ship_package

CLASSES = ("class", "interface", "struct", "enum")
ROW = (
    "what string, id string, name string, kind string, file_path string, line_start int, line_end int, signature string, docstring string,"
    " parent_id string, language string, metadata string, from_id string, to_id string, line int, ordinal int"
)
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<path>(?:[A-Za-z_$][\w$]*(?:\?\.|\.|::))*)(?P<name>[A-Za-z_$][\w$]*)(?P<bang>!)?\s*(?:<[\w<>, .\[\]]*>|::<[^()]*>)?\(")
_CHAIN = re.compile(r"\.\s*([A-Za-z_$][\w$]*)\s*\(")


@lru_cache(maxsize=16)
def _ready(name: str):
    language = LANGUAGES[name]
    return language, re.compile(f"(?P<c>{language.comment})|(?P<s>{language.strings})", re.S), patterns(language)


def _blank(text: str) -> str:
    return "".join(c if c == "\n" else " " for c in text)


def _brace_end(clean: str, start: int) -> int:
    """End of the block that the first '{' from start on opens; the statement's end if a ';' comes first."""
    i, n = start, len(clean)
    while i < n and clean[i] not in "{;":
        i += 1
    if i >= n or clean[i] == ";":
        return min(i, n)
    depth = 0
    for m in re.finditer(r"[{}]", clean[i:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return i + m.start()
    return n


def _indent_end(clean: str, start: int) -> int:
    """End of the indented block below the line at start."""
    first = clean.rfind("\n", 0, start) + 1
    own = len(clean[first:]) - len(clean[first:].lstrip(" \t"))
    at = clean.find("\n", start)
    last = at if at >= 0 else len(clean)
    while 0 <= at < len(clean):
        nxt = clean.find("\n", at + 1)
        line = clean[at + 1 : nxt if nxt >= 0 else len(clean)]
        if line.strip():
            if len(line) - len(line.lstrip(" \t")) <= own:
                break
            last = nxt if nxt >= 0 else len(clean)
        at = nxt
    return last


def _variants(clean: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of the members of the enum at start..end: what stands between the commas of its body."""
    at = clean.find("{", start, end + 1) + 1
    depth, begin = 0, at
    for i in range(at, end + 1) if at else ():
        c = clean[i] if i < end else ","
        depth += (c in "({[") - (c in ")}]")
        if depth == 0 and c in ",;":
            m = re.match(r"(?:\s|#\[[^\]]*\]|\[[^\]]*\]|@\w+)*([A-Za-z_]\w*)", clean[begin:i])
            if m and not keyword(m[1]):
                yield begin + m.start(1), i, m[1]
            begin = i + 1
            if c == ";":
                break


def _access(head: str, name: str, language: str) -> dict:
    words = set(re.findall(r"\w+", head.split("(")[0]))
    found = next((w for w in ("private", "protected", "internal", "public") if w in words), None)
    if language == "python":
        found = "name_mangled" if name.startswith("__") and not name.endswith("__") else "private" if name.startswith("_") else "public"
    flags = {f"is_{w}": w in words for w in ("async", "static", "abstract", "virtual", "override")}
    if language == "go":
        return {"exported": name[:1].isupper()}
    if language == "rust":
        seen = re.match(r"\s*(pub(?:\([^)]*\))?)", head)
        return {"visibility": seen[1] if seen else "", "is_async": "async" in words}
    return {"access": found or "public", **flags}


def _parameters(head: str) -> list[dict]:
    m = re.search(r"\(((?:[^()]|\([^()]*\))*)\)", head)
    out = []
    for part in re.split(r",(?![^<\[(]*[>\])])", m[1]) if m else []:
        p = part.strip()
        if p and p not in ("self", "&self", "&mut self", "cls"):
            name, _, kind = p.partition(":")
            words = re.findall(r"[\w$]+", name)
            if words:
                out.append({"name": words[0] if kind else words[-1], **({"type": kind.split("=")[0].strip()} if kind else {})})
    return out


def _first_string(text: str, clean: str, start: int) -> str | None:
    """The string that is the first statement of the Python block at start."""
    head = re.compile(r":[ \t]*\n").search(clean, start)
    m = head and re.compile(r"\s*[rRuU]?(\"\"\"|''')(.*?)\1", re.S).match(text, text.find("\n", head.start()))
    return m[2].strip() if m else None


def _docstring(text: str, start: int, language: str) -> str | None:
    before = text[:start].rstrip(" \t")
    lines = before.split("\n")[:-1] if before.endswith("\n") or not before else before.split("\n")
    while lines and re.match(r"\s*(?:@\w|#\[|\[\w)", lines[-1]):
        lines.pop()
    if lines and lines[-1].rstrip().endswith("*/"):
        block = "\n".join(lines)
        at = block.rfind("/*")
        return block[at:].strip() if at >= 0 else None
    taken: list[str] = []
    while lines and re.match(r"\s*//", lines[-1]):
        taken.insert(0, lines.pop().strip())
    if language == "go":
        return "\n".join(re.sub(r"^//\s?", "", x) for x in taken) or None
    return "\n".join(taken) or None


def extract(path: str, text: str, language_name: str) -> Iterator[tuple]:
    """Rows (see ROW) of one file: symbols, then edges in the order of their places."""
    language, scanner, declare = _ready(language_name)
    reserved = lambda w: keyword(w) and not (w == "new" and language_name in ("rust", "go", "python"))
    imports_text = scanner.sub(lambda m: m[0] if m.lastgroup == "s" else _blank(m[0]), text)
    clean = scanner.sub(lambda m: _blank(m[0]), text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_at = lambda pos: bisect.bisect_left(breaks, pos) + 1
    end_of = _indent_end if language.blocks == "indent" else _brace_end

    # Declarations with their extents, outermost first.
    found: list[list] = []
    taken: set[int] = set()
    for kind, pattern in declare:
        for m in pattern.finditer(clean):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if reserved(m["name"]) or m.start("name") in taken:
                continue
            line_end = clean.find("\n", m.end()) if "\n" in clean[m.end() :] else len(clean)
            plain = kind in ("property", "const", "type") or (language_name == "go" and kind == "struct" and "{" not in clean[m.end() : line_end])
            end = line_end if plain and language_name == "go" else m.end() if plain else end_of(clean, m.end() - (m[0][-1] in "{;"))
            found.append([at, end, kind, m["name"], m.start("name")])
            taken.add(m.start("name"))
    for at, end, kind, _, _ in [f for f in found if f[2] == "enum"]:
        found += [[a, b, "variant", name, a] for a, b, name in _variants(clean, at, end)]
    found.sort(key=lambda f: (f[0], -f[1]))
    kept: list[tuple] = []  # at, end, kind, name, index of the enclosing declaration
    stack: list[int] = []
    for at, end, kind, name, _ in found:
        while stack and kept[stack[-1]][1] < at:
            stack.pop()
        outer = kept[stack[-1]] if stack else None
        inside = outer[2] if outer else None
        if kind in ("method", "property") and language_name != "go" and inside not in ("class", "interface", "struct") and not (inside == "enum" and language_name == "java"):
            continue
        if kind in ("method", "property") and outer is not None and clean[outer[0] : at].count("{") - clean[outer[0] : at].count("}") != 1:
            continue
        kept.append((at, end, kind, name, stack[-1] if stack else None))
        if end > at:
            stack.append(len(kept) - 1)

    # In Rust the functions of an impl block belong to its type, if the file declares it.
    impls = [(m.start(), _brace_end(clean, m.end()), m["ty"], m["tr"]) for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<tr>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<ty>\w+)", clean, re.M)] if language_name == "rust" else []
    ids, kinds = [], []
    for at, _, kind, name, _ in kept:
        if kind == "function" and any(a < at < b and any(k[2] in CLASSES and k[3] == ty for k in kept) for a, b, ty, _ in impls):
            kind = "method"
        kinds.append(kind)
        ids.append(f"{path}::{name}::{kind}::{line_at(at)}")
    by_name = {kept[i][3]: ids[i] for i in reversed(range(len(kept))) if kinds[i] in CLASSES}
    for i, (at, end, _, name, outer) in enumerate(kept):
        kind = kinds[i]
        parent = None
        if kind in ("method", "property", "variant"):
            up = outer
            while up is not None and kinds[up] not in CLASSES:
                up = kept[up][4]
            parent = ids[up] if up is not None else None
            if language_name == "rust" and kind == "method":
                parent = next((by_name.get(ty) for a, b, ty, _ in impls if a < at < b), None)
        brace, nl = clean.find("{", at, end + 1), text.find("\n", at)
        stop = brace if brace >= 0 and kind != "variant" else nl if nl >= 0 else len(text)
        if language_name == "python":
            stop = clean.find(":\n", at) + 1 or stop
        signature = " ".join(text[at : min(stop, max(end, at + 1)) if kind in ("variant", "property") else stop].split()).rstrip(",;")
        meta = _access(signature, name, language_name)
        if kind in ("function", "method"):
            meta["parameters"] = _parameters(signature)
        yield ("symbol", ids[i], name, kind, path, line_at(at), max(line_at(min(end, len(text))), line_at(at)), signature, _first_string(text, clean, at) if language_name == "python" else _docstring(text, at, language_name), parent, language_name, json.dumps(meta), None, None, None, i)

    module = f"{path}::__module__::function"

    def enclosing(pos: int, default: str) -> str:
        best = None
        for i, (at, end, *_rest) in enumerate(kept):
            if at <= pos <= end and kinds[i] not in ("property", "variant", "const", "type"):
                best = i
        return ids[best] if best is not None else default

    edges: list[tuple[int, str, str, str]] = []
    for pattern in language.imports:
        for m in re.finditer(pattern, imports_text, re.M):
            to, names = m["to"].strip().strip("'\"`"), m.groupdict().get("names")
            if names is None:
                edges.append((m.start(), module, " ".join(to.split()), "imports"))
            elif language_name == "go":
                edges += [(m.start("names") + g.start(), module, g[1], "imports") for g in re.finditer(r'"([^"]+)"', names)]
            else:
                edges += [(m.start(), module, f"{to}::{n.split(' as ')[0].strip()}", "imports") for n in names.strip("()").split(",") if n.strip()]
    for i, (at, end, *_rest) in enumerate(kept):
        if kinds[i] in CLASSES:
            stop = end if language_name == "go" else clean.find(":\n" if language_name == "python" else "{", at)
            head = clean[at : stop if stop >= 0 else end]
            for kind, pattern in language.heads:
                for m in re.finditer(pattern, head):
                    for part in re.split(r",(?![^<]*>)", m["to"]):
                        base = re.sub(r"[<\[(].*", "", part.strip(), flags=re.S).strip()
                        if base and "=" not in base and not (language_name == "go" and base in ("struct", "interface")):
                            edges.append((at + m.start("to"), ids[i], base, kind))
    for a, b, ty, trait in impls:
        if trait:
            edges.append((a, by_name.get(ty, f"{path}::__module__::class"), trait.split("::")[-1], "implements"))
    declared = {f[4] for f in found}
    for m in _CALL.finditer(clean):
        name, owner = m["name"], re.sub(r"\?\.", ".", m["path"])
        if reserved(name) or m.start("name") in declared:
            continue
        chained = clean[: m.start()].rstrip()[-1:] == "." and not owner
        at, src = m.start("name"), enclosing(m.start(), module)
        parts = [p for p in re.split(r"\.|::", owner) if p]
        if m["new"]:
            edges.append((at, src, name, "instantiates"))
        elif language_name == "rust":
            whole = (owner if "::" in owner else "") + name + ("!" if m["bang"] else "")
            edges.append((at, src, name if "." in owner or chained else whole, "calls"))
        elif chained:
            if language_name in ("java", "csharp", "typescript"):
                edges.append((at, src, name, "calls"))
        elif not parts:
            edges.append((at, src, name, "calls"))
        elif len(parts) == 1 and parts[0] in language.self_words:
            edges.append((at, src, name, "calls"))
        elif language_name != "python" or len(parts) == 1:
            edges.append((at, src, f"{parts[-1]}.{name}", "calls"))
            if language_name == "java":
                edges.append((at, src, name, "calls"))
    for kind, pattern in (("references_type", language.types), ("references", language.cases)):
        for m in re.finditer(pattern, clean, re.M) if pattern else ():
            if not keyword(m["to"]):
                edges.append((m.start("to"), enclosing(m.start("to"), module), m["to"], kind))
    for n, (at, src, to, kind) in enumerate(sorted(edges)):
        yield ("edge", None, None, kind, path, None, None, None, None, None, language_name, None, src, to, line_at(at), n)


def extract_rows(files: DataFrame) -> DataFrame:
    """Symbols and edges (one table, see ROW) of files (file_path, text).

    Files of other languages, without path or text, give nothing; a file that
    can't be read to its end gives the rows up to there and a row that says so
    (what is 'failed', name the kind of error), and fails nothing else.
    """
    names = [c.split()[0] for c in re.split(r",\s*", ROW)]
    kinds = [pa.int32() if c.split()[1] == "int" else pa.string() for c in re.split(r",\s*", ROW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, text, language in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    out.extend(extract(path, text, language))
                except (RecursionError, IndexError, ValueError) as e:
                    out.append(("failed", None, type(e).__name__, None, path, *[None] * 5, language, *[None] * 5))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    ship_package(files.sparkSession)
    known = files.select("file_path", "text", language_of(F.col("file_path")).alias("language"))
    return known.where("file_path is not null and text is not null and language is not null").mapInArrow(run, ROW)


def extracted_symbols(rows: DataFrame) -> DataFrame:
    columns = ["id", "name", "kind", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id", "language", "metadata"]
    return rows.where("what = 'symbol'").select(columns).dropDuplicates(["id"])


def extracted_edges(rows: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, kind): the first by its place in the file."""
    first = F.min(F.struct("line", "ordinal", "file_path")).alias("_e")
    return rows.where("what = 'edge'").groupBy("from_id", "to_id", "kind").agg(first).select(
        "from_id", "to_id", "kind", F.col("_e.file_path").alias("file_path"), F.col("_e.line").alias("line")
    )


def failed_files(rows: DataFrame) -> DataFrame:
    """(file_path, language, error) of the files that could not be read to their end."""
    return rows.where("what = 'failed'").select("file_path", "language", F.col("name").alias("error"))
