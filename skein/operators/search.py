"""Ranked search over symbols: document texts, query expansion, postings and scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.stem import stem
from skein.operators.graph import CodeGraph, callees_of, callers_of, find_symbol, importance
from skein.scale import checkpoint
from skein.session import ship_package

#: Fixed values of the ranking: term saturation, length normalisation, weights of the two searched columns.
K1, B, WEIGHTS = 1.2, 0.75, {"name": 5.0, "body": 10.0}
GENERAL = frozenset(w.lower() for ws in X.STOPWORDS.values() for w in ws)


def document_texts(graph: CodeGraph) -> DataFrame:
    """(id, name, kind, file_path, body): what each symbol is searched by."""
    parents = graph.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("_parent"))
    calls = callees_of(graph).select(F.col("from_id").alias("id"), F.col("callees").alias("_calls"))
    called = callers_of(graph).select(F.col("to_id").alias("id"), F.col("callers").alias("_called"))
    score = importance(graph).select(F.col("to_id").alias("id"), F.col("score").alias("_score"))
    full = graph.symbols.join(parents, "parent_id", "left").join(calls, "id", "left").join(called, "id", "left").join(score, "id", "left")
    camel, snake, parent = X.camel_split(F.col("name")), X.snake_split(F.col("name")), X.camel_split(F.col("_parent"))
    folders = F.filter(F.split(X.slashes(F.col("file_path")), "/"), lambda p: (p != "src") & ~p.contains("."))
    tier = F.when(F.col("_score") > 0.7, "importance high core").when(F.col("_score") > 0.3, "importance medium")
    body = F.concat_ws(
        " | ",
        F.concat_ws(" ", "kind", "name"),
        F.when(camel != F.col("name"), camel),
        F.when(snake != F.col("name"), snake),
        "signature",
        "docstring",
        F.concat(F.lit("in "), F.col("_parent")),
        F.when(parent != F.col("_parent"), F.concat(F.lit("in "), parent)),
        F.when(F.size(folders) > 0, F.concat(F.lit("path "), F.array_join(folders, " "))),
        F.concat(F.lit("called-by "), F.col("_called")),
        F.concat(F.lit("calls "), F.col("_calls")),
        F.when(~X.is_general_name(F.col("name"), F.col("language")), tier),
    )
    return full.select("id", "name", "kind", "file_path", body.alias("body"))


def words(text: Column) -> Column:
    """Lower-case words without diacritics: letters and digits, everything else (also '_') separates."""
    plain = F.regexp_replace(F.lower(text), r"\p{M}+", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _stemmed(words_: Column) -> Column:
    def run(batches: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = stem(w)
            return known[w]

        return batches.map(lambda ws: [one(w) for w in ws] if ws is not None else None)

    run.__annotations__ = {"batches": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(words_)


def token_lists(docs: DataFrame, stems: bool = True) -> DataFrame:
    """(id, field, ws): the tokens of each searched column, in order."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("ws")) for f in WEIGHTS])
    rows = docs.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.ws")
    if stems:
        ship_package(docs.sparkSession)
        rows = rows.withColumn("ws", _stemmed(F.col("ws")))
    return rows


def postings(docs: DataFrame, stems: bool = True) -> DataFrame:
    """(id, field, token, pos): every token of the searched columns with its position."""
    return token_lists(docs, stems).select("id", "field", F.posexplode("ws").alias("pos", "token"))


def expand_query(query: str) -> list[list[str]]:
    """Phrases of a query, each a list of words of which the last is a prefix; repeats count twice.

    Each word is taken whole and, where it is made of camel or snake parts of
    three letters or more, by its parts too. If a query has both general and
    specific words, the specific phrases are asked for twice.
    """
    every: list[tuple[str, bool]] = []
    for raw in query.split():
        token = "".join(c for c in raw if c.isalnum() or c == "_")
        if not token:
            continue
        camel = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", token).lower().split()
        parts = [token, *(w for w in camel if len(w) >= 3 and w != token.lower()), *(w for w in token.lower().split("_") if "_" in token and len(w) >= 3)]
        every += [(p, raw.lower() in GENERAL) for p in parts]

    def once(phrases: list[str]) -> list[str]:
        return [p for i, p in enumerate(phrases) if not i or p != phrases[i - 1]]

    asked, specific = once([p for p, _ in every]), once([p for p, g in every if not g])
    if specific and any(g for _, g in every):
        asked = specific + asked
    return [[stem(w) for w in re.split(r"[^a-z0-9]+", p.lower()) if w] for p in asked]


def ranked(docs: DataFrame, phrases: list[list[str]], stems: bool = True) -> DataFrame:
    """(id, rank): documents that hold any of the phrases, the best (least) rank first.

    rank is minus the sum over phrases of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * L / avgL)),
    with f the weighted number of hits and L the number of tokens of a document.
    Where docs have a column project, each project's documents are a corpus of their own.
    """
    if "project" not in docs.columns:
        docs = docs.withColumn("project", F.lit(""))
    lists = token_lists(docs, stems).join(docs.select("id", "project"), "id")
    lists = checkpoint(lists)  # read three times; texts are built and stemmed once
    tokens = lists.select("project", "id", "field", F.posexplode("ws").alias("pos", "token"))
    lengths = lists.groupBy("project", "id").agg(F.sum(F.size("ws")).alias("len"))
    corpora = lengths.groupBy("project").agg(F.count(F.lit(1)).cast("double").alias("_docs"), F.sum("len").cast("double").alias("_tokens"))
    steps = [(i, len(p), j, w, j == len(p) - 1) for i, p in enumerate(phrases) for j, w in enumerate(p)]
    names = ("phrase", "size", "step", "word", "prefix")
    asked = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in steps])
    fits = lambda a: F.when(a["prefix"], F.startswith(F.col("token"), a["word"])).otherwise(F.col("token") == a["word"])
    hits = tokens.select("project", "id", "field", "pos", F.explode(F.filter(asked, fits)).alias("a"))
    hits = hits.select("project", "id", "field", "pos", *[F.col(f"a.{n}").alias(n) for n in names])
    # A phrase's words stand side by side: position less step is the same for all of them.
    whole = hits.groupBy("project", "id", "field", "phrase", "size", (F.col("pos") - F.col("step")).alias("_at")).agg(F.countDistinct("step").alias("_k"))
    whole = whole.where(F.col("_k") == F.col("size"))
    weight = F.when(F.col("field") == "name", WEIGHTS["name"]).otherwise(WEIGHTS["body"])
    f = whole.groupBy("project", "id", "phrase").agg(F.sum(weight).alias("f"))
    df = f.groupBy("project", "phrase").agg(F.count(F.lit(1)).alias("df")).join(corpora, "project")
    scored = f.join(df, ["project", "phrase"]).join(lengths.drop("project"), "id")
    idf = F.greatest(F.log((F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + K1 * (1 - B + B * F.col("len") / (F.col("_tokens") / F.col("_docs")))
    return scored.groupBy("id").agg((-F.sum(idf * F.col("f") * (K1 + 1) / norm)).alias("rank"))


def _scored(best: DataFrame, by: list[str]) -> DataFrame:
    """best with score: 1.0 for the least rank down to 0.5 for the greatest of each group, all 0.95 where ranks are equal."""
    every = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(1)])  # over the limited rows
    low, high = F.min("rank").over(every), F.max("rank").over(every)
    score = F.when(high - low < 1e-9, 0.95).otherwise(1 - 0.5 * (F.col("rank") - low) / (high - low))
    return best.withColumns({"score": score, "is_vendor": X.is_vendor_path(F.col("file_path"))})


def _phrases(query: str, stems: bool) -> list[list[str]]:
    return expand_query(query) if stems else [[w for w in re.split(r"[^a-z0-9]+", q.lower()) if w] for q in query.split()]


def find(graph: CodeGraph, query: str, kind: str | None = None, limit: int = 10, stems: bool = True) -> DataFrame:
    """(id, name, kind, file_path, rank, score): the best `limit` symbols for a query, first-party files before others.

    Scores run from 1.0 for the best to 0.5 for the last of the result, all
    0.95 where ranks are equal. An empty query finds nothing.
    """
    docs, phrases = document_texts(graph), _phrases(query, stems)
    if not any(phrases):
        return docs.select("id", "name", "kind", "file_path", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"), F.lit(False).alias("is_vendor")).where("false")
    hits = ranked(docs, phrases, stems).join(docs.select("id", "name", "kind", "file_path"), "id")
    if kind:
        hits = hits.where(F.col("kind") == kind)
    best = _scored(hits.orderBy("rank", "id").limit(limit), [])
    return best.select("id", "name", "kind", "file_path", "rank", "score", "is_vendor").orderBy("is_vendor", F.desc("score"), "id")


def find_in_projects(graph: CodeGraph, query: str, limit: int = 10, stems: bool = True) -> DataFrame:
    """(project, id, name, kind, file_path, rank, score): the best `limit` of all projects, each ranked and scored by itself."""
    docs = document_texts(graph).withColumn("project", F.substring_index(X.slashes(F.col("file_path")), "/", 1))
    columns = ["project", "id", "name", "kind", "file_path", "rank", "score"]
    phrases = _phrases(query, stems)
    if not any(phrases):
        return docs.withColumns({"rank": F.lit(0.0), "score": F.lit(0.0)}).select(columns).where("false")
    hits = ranked(docs, phrases, stems).join(docs.drop("body"), "id")
    place = F.row_number().over(Window.partitionBy("project").orderBy("rank", "id"))
    best = _scored(hits.withColumn("_n", place).where(F.col("_n") <= limit), ["project"])
    return best.orderBy(F.desc("score"), "project", "rank", "id").limit(limit).select(columns)


def similar(graph: CodeGraph, name: str, kind: str | None = None, limit: int = 10, stems: bool = True) -> DataFrame:
    """Symbols like the named one: searched by its kind, name, name parts and signature, of its kind, without itself."""
    me = find_symbol(graph, name).select("id", "name", "kind", "signature").first()
    if me is None:
        return find(graph, "")
    parts = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", me["name"]), me["name"].replace("_", " ")
    query = " ".join([me["kind"], me["name"], *(p for p in parts if p != me["name"]), me["signature"] or ""])
    return find(graph, query, kind or me["kind"], limit + 1, stems).where(F.col("id") != me["id"]).orderBy(F.desc("score"), "id").limit(limit)
