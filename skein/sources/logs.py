"""Run logs: newline-delimited JSON of an assistant's actions, and unified diffs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tools that only look, tools that change files, and the field that says what each was asked.
LOOKING, EDITING = ("Read", "Grep", "Glob", "Bash"), ("Edit", "Write")
ARGUMENT = {"Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "pattern", "Glob": "pattern", "Bash": "command"}
COUNTERS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lines (run, line_no, value) with event: the line as a variant, null where it is malformed."""
    return lines.withColumn("event", F.try_parse_json("value"))


def line_stats(lines: DataFrame) -> DataFrame:
    """Per run: lines, malformed lines, and the four token counters summed over usage and, for results, result.usage."""
    e = parsed_lines(lines.where(F.trim("value") != ""))
    get = lambda path, kind: F.try_variant_get("event", path, kind)

    def used(c: str):
        return F.coalesce(get(f"$.usage.{c}", "bigint"), get(f"$.message.usage.{c}", "bigint"), F.lit(0)) + F.when(
            get("$.type", "string") == "result", F.coalesce(get(f"$.result.usage.{c}", "bigint"), F.lit(0))
        ).otherwise(0)

    return e.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("event").isNull(), 1)).alias("n_malformed"),
        *[F.sum(used(c)).alias(c) for c in COUNTERS],
    )


def actions(lines: DataFrame) -> DataFrame:
    """(run, seq, tool, argument, is_edit, is_look): every tool use of message contents, numbered in order within its run."""
    e = parsed_lines(lines)
    contents = F.try_variant_get("event", "$.message.content", "array<variant>")
    started = F.try_variant_get("event", "$.content_block", "variant")
    blocks = F.concat(F.coalesce(contents, F.expr("cast(array() as array<variant>)")), F.when(started.isNotNull(), F.array(started)).otherwise(F.expr("cast(array() as array<variant>)")))
    items = e.select("run", "line_no", F.posexplode(blocks).alias("_pos", "_b"))
    get = lambda path: F.try_variant_get("_b", path, "string")
    uses = items.where(get("$.type") == "tool_use").withColumn("tool", get("$.name"))
    asked = F.coalesce(*[F.when(F.col("tool") == t, get(f"$.input.{f}")) for t, f in ARGUMENT.items()], get("$.input.symbol"), get("$.input.query"))
    seq = F.row_number().over(Window.partitionBy("run").orderBy("line_no", "_pos"))
    return uses.select(
        "run", seq.alias("seq"), "tool", F.substring(asked, 1, 100).alias("argument"),
        F.col("tool").isin(*EDITING).alias("is_edit"), F.col("tool").isin(*LOOKING).alias("is_look"),
    )


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(run, file_path, line): the new-side numbers of the lines that unified diffs (run, diff) add."""
    head = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")

    def added(text: str) -> Iterator[tuple[str, int]]:
        path, at, left = None, 0, 0
        for line in text.split("\n"):
            m = head.match(line)
            if m:
                at, left = int(m[1]), int(m[2] or 1)
            elif left <= 0 and line.startswith("+++ "):
                name = line[4:].split("\t")[0]
                path = None if name == "/dev/null" else name.removeprefix("b/")
            elif left > 0 and line[:1] in ("+", " ", ""):
                if line[:1] == "+" and path:
                    yield path, at
                at, left = at + 1, left - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, p, n) for r, d in zip(f["run"], f["diff"]) if d for p, n in added(d)]
            yield pd.DataFrame(rows, columns=["run", "file_path", "line"])

    return diffs.select(F.col("run").cast("string"), "diff").mapInPandas(run, "run string, file_path string, line int")
