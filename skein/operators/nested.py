"""Deeply nested JSON into related flat tables (problem 2).

Each record is parsed once, as a stream of tokens with an explicit stack, into
path-value-ordinal triples. A path that runs through an array belongs to the
object that is the array's element (its repeated ancestor); the triples of one
array field make one table, in which every row knows its own place, its
parent's place and its record's id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import ship_package

#: Fields that hold arrays of objects, where an object that stands alone is element 0.
ARRAY_FIELDS = frozenset(
    {"parameters", "params", "type_args", "annotations", "decorators", "attributes", "type_params", "bounds", "args", "throws"}
)

TRIPLES = "id string, node_table string, node_path string, parent_path string, ordinal int, field string, value string"

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:"
    r"([\[\]{},:])"
    r'|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
    r")"
)
_BLANK = re.compile(r"[ \t\n\r]*")

#: Field of an array element that is no object: the row is the element's own, with its value and parent_path.
ELEMENT = "[]"


class _Place:
    """Where a value stands: its path, the nearest array-element object, and its path below that object."""

    __slots__ = ("path", "table", "node", "node_table", "ordinal", "below", "key", "element")

    def __init__(self, path, key, element, node, node_table, ordinal, below):
        self.path, self.key, self.element = path, key, element
        self.node, self.node_table, self.ordinal, self.below = node, node_table, ordinal, below

    def member(self, key: str) -> _Place:
        join = lambda a: f"{a}.{key}" if a else key
        return _Place(join(self.path), key, False, self.node, self.node_table, self.ordinal, join(self.below))

    def item(self, i: int) -> _Place:
        return _Place(f"{self.path}[{i}]", self.key, True, self.node, self.node_table, self.ordinal, f"{self.below}[{i}]")


def _opened(place: _Place, rows: list) -> _Place:
    """The place of an object's members; an array element becomes a node of its own."""
    if not place.element and place.key not in ARRAY_FIELDS:
        return place
    path = place.path if place.element else place.path + "[0]"
    i = int(path[path.rindex("[") + 1 : -1])
    rows.append((place.key, path, place.node, i, "", None))
    return _Place(path, place.key, False, path, place.key, i, "")


def _scan(text: str, place: _Place, rows: list) -> bool:
    """Append the triples of the JSON value in text; False if text isn't valid JSON."""
    stack: list[list] = []  # [place, is_array, count, key's place]
    pos, want = 0, "value"
    match = _TOKEN.match
    while want != "end":
        m = match(text, pos)
        if m is None:
            return False
        pos = m.end()
        mark, string, scalar = m.groups()
        if want == "key":
            if string is None:
                if mark == "}" and stack[-1][2] == 0:
                    stack.pop()
                    want = "next" if stack else "end"
                    continue
                return False
            stack[-1][3] = stack[-1][0].member(json.loads(string))
            m = match(text, pos)
            if m is None or m[1] != ":":
                return False
            pos, want = m.end(), "value"
            continue
        if want == "next":
            top = stack[-1]
            if mark == ",":
                top[2] += 1
                want = "value" if top[1] else "key"
            elif mark == ("]" if top[1] else "}"):
                stack.pop()
                want = "next" if stack else "end"
            else:
                return False
            continue
        at = place if not stack else stack[-1][0].item(stack[-1][2]) if stack[-1][1] else stack[-1][3]
        if mark == "{":
            stack.append([_opened(at, rows), False, 0, None])
            want = "key"
        elif mark == "[":
            stack.append([at, True, 0, None])
            m = match(text, pos)
            if m is not None and m[1] == "]":
                pos = m.end()
                stack.pop()
                want = "next" if stack else "end"
        elif mark is not None:
            return False
        else:
            value = scalar
            if string is not None:
                value = json.loads(string)
                kept = len(rows)
                if value.lstrip(" \t\n\r")[:1] in ("{", "[", '"') and _scan(value, at, rows):
                    value = None  # JSON in a string counts as what it holds
                    want = "next" if stack else "end"
                    continue
                del rows[kept:]
            value = None if scalar == "null" else value
            if at.element:
                rows.append((at.key, at.path, at.node, int(at.path[at.path.rindex("[") + 1 : -1]), ELEMENT, value))
            else:
                rows.append((at.node_table, at.node, None, at.ordinal, at.below, value))
            want = "next" if stack else "end"
        if want == "key" and stack[-1][2] > 0:
            return False
    return _BLANK.fullmatch(text, pos) is not None


def record_triples(text: str | None) -> list[tuple]:
    """Triples (table, node, parent, ordinal, field, value) of one record; none if it isn't valid JSON.

    The first triple of each node has the empty field: it is the node's row. An
    array element that is no object has one row of its own, of field ELEMENT.
    """
    if not text:
        return []
    rows: list[tuple] = []
    return rows if _scan(text, _Place("", "", False, "", "", 0, ""), rows) else []


def _clean(s: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can make, can't be written as UTF-8."""
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def nested_triples(records: DataFrame, id_col: str = "id", json_col: str = "metadata", values: bool = True) -> DataFrame:
    """Path-value-ordinal triples of each record's JSON.

    node_path is the nearest enclosing array-element object ('' for the record
    itself), node_table the array field it is an element of, field the path
    below the node. The row with an empty field stands for the node itself and
    carries parent_path; with values=False only those are made. An array element
    that is no object has one row, of field ELEMENT, with its own place, parent_path
    and value. Null, blank and
    invalid texts give no rows; of a key that an object repeats, both values
    give rows. Each record is parsed within one task; nothing is shuffled.
    """
    names = [f.split()[0] for f in TRIPLES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for tab, node, parent, i, field, value in record_triples(text):
                    if values or field == "":
                        out.append((key, tab, _clean(node), _clean(parent), i, _clean(field), _clean(value)))
                if len(out) > 50_000:
                    yield send()
                    out.clear()
        if out:
            yield send()

    ship_package(records.sparkSession)
    return records.select(F.col(id_col).alias("id"), F.col(json_col).alias("_json")).mapInArrow(parse, TRIPLES)


def nodes(triples: DataFrame) -> DataFrame:
    """One row for each array-element object: id, table, own and parent place, ordinal in its array.

    Triples are grouped by their repeated ancestor, as in pivot_table, for all
    array fields at once. An object has a triple with the empty field.
    """
    mine = triples.where((F.col("field") == "") & F.col("parent_path").isNotNull())
    return mine.groupBy("id", "node_table", "node_path").agg(F.max("parent_path").alias("parent_path"), F.max("ordinal").alias("ordinal"))


def _is_element() -> Column:
    return (F.col("field") == ELEMENT) & F.col("parent_path").isNotNull()  # a key may be named '[]' too


def pivot_table(triples: DataFrame, tables: list[str], fields: list[str], elements: bool = False) -> DataFrame:
    """The flat table of the nodes of some array fields, with one column for each wanted field.

    Columns: id, node_path, parent_path, ordinal and the fields (as text, a dot as _, null
    where a node lacks the field); with elements also the array elements that
    are no objects, whose value is in the column element. A node's triples all
    carry the record's id, so groups are no larger than one object.
    """
    wanted = F.col("field").isin(["", *fields])
    mine = triples.where(F.col("node_table").isin(tables) & ((wanted | _is_element()) if elements else (wanted & ~_is_element())))
    return mine.groupBy("id", "node_path").agg(
        F.max("parent_path").alias("parent_path"),
        F.max("ordinal").alias("ordinal"),
        *[F.max(F.when((F.col("field") == f) & ~_is_element(), F.col("value"))).alias(f.replace(".", "_")) for f in fields],
        *([F.max(F.when(_is_element(), F.col("value"))).alias("element")] if elements else []),
    )


def record_fields(triples: DataFrame) -> DataFrame:
    """The fields of the records themselves: id, field (path below the record), value; whatever their names."""
    return triples.where("node_path = ''").select("id", "field", "value")


def remaining(triples: DataFrame, pivoted: list[tuple[list[str], list[str]]]) -> DataFrame:
    """What neither record_fields nor the pivoted tables (array fields, fields; with elements) hold, as triples.

    Columns: id, node_table, node_path, parent_path, ordinal, field, value. An
    object has a row of the empty field, an element that is no object one of
    the field ELEMENT.
    """
    kept = F.lit(False)
    for tables, fields in pivoted:
        kept = kept | (F.col("node_table").isin(tables) & (F.col("field").isin(["", *fields]) | _is_element()))
    return triples.where((F.col("node_path") != "") & ~kept).select("id", "node_table", "node_path", "parent_path", "ordinal", "field", "value")
