"""Source trees as tables: listing with ignore rules, texts, and changes known to version control."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import language_of

#: Folders in which no nested project is looked for.
SKIPPED = ("node_modules", "target", "dist", "build")
MARKER = ".skein/config.toml"


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it ignores) of one line of an ignore file; None for blanks and comments."""
    rule = line.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    ignores = not rule.startswith("!")
    rule = rule.lstrip("!").removeprefix("\\")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored = "/" in rule
    body = ""
    for part in re.findall(r"\*\*/|/\*\*|\*|\?|\[[^\]]*\]|.", rule.lstrip("/")):
        body += {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[0] == "[" and len(part) > 1 else re.escape(part))
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), ignores


def is_ignored(path: Column, lines: list[str]) -> Column:
    """True if the last rule that fits a relative path ignores it."""
    out = F.lit(False)
    for rule in filter(None, map(ignore_pattern, lines)):
        out = F.when(path.rlike(rule[0]), F.lit(rule[1])).otherwise(out)
    return out


def nested_projects(root: str, depth: int = 3) -> list[str]:
    """Relative folders below root, down to `depth`, that are projects of their own; none is looked into."""
    out: list[str] = []

    def look(folder: Path, left: int) -> None:
        for child in sorted(p for p in folder.iterdir() if p.is_dir() and not p.name.startswith(".") and p.name not in SKIPPED):
            if (child / MARKER).is_file():
                out.append(child.relative_to(root).as_posix())
            elif left > 1:
                look(child, left - 1)

    look(Path(root), depth)
    return out


def source_files(spark: SparkSession, root: str, ignore: list[str] | None = None, languages: list[str] | None = None, nested: list[str] | None = None) -> DataFrame:
    """(file_path, text, mtime, language) of the source files below root.

    Hidden files and folders, ignored paths (the root's .gitignore, then
    `ignore`), nested projects, and files of other languages are left out
    before any content is decoded. The listing and reading are Spark's.
    """
    own = Path(root, ".gitignore")
    rules = (own.read_text().split("\n") if own.is_file() else []) + (ignore or [])
    base = Path(root).resolve().as_posix().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace("path", "^file:/*" + re.escape(base), "")
    rows = files.select(rel.alias("file_path"), "content", F.unix_seconds("modificationTime").alias("mtime"))
    rows = rows.withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    rows = rows.where(~F.col("file_path").rlike(r"(^|/)\.")).where(~is_ignored(F.col("file_path"), rules))
    for prefix in nested or []:
        rows = rows.where(~F.col("file_path").startswith(prefix + "/"))
    if languages:
        rows = rows.where(F.col("language").isin(languages))
    return rows.select("file_path", F.decode("content", "UTF-8").alias("text"), "mtime", "language")


def git_changed_files(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(file_path) of what version control says changed since ref; none for an unknown ref."""
    if ref.startswith("-") or ":" in ref or "\0" in ref:
        raise ValueError(f"not a revision: {ref!r}")
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", ref, "--"], capture_output=True, text=True)
    if done.returncode and "bad revision" not in done.stderr:
        raise RuntimeError(done.stderr.strip())
    names = [n for n in done.stdout.split("\n") if n] if not done.returncode else []
    return spark.createDataFrame([(n,) for n in names], "file_path string")
