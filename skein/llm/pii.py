"""Personal data inside free text (problem 9).

Tokens are labelled by a skip-chain conditional random field: a linear chain
over the tokens around everything that could be an item, with extra edges
between repeated or similar tokens of the same document, however far apart, so
that a name is labelled alike wherever the document has it. Inference is loopy
belief propagation: exact forward-backward passes along the chains, with
messages over the skip edges between them. What comes out must then have the
exact form of an item of its type.

The field is trained on a bounded sample, on labels that come from forms and
from names: those given, and those learned from all documents because they
stand beside several different known names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.pii_text import LABELS, PARTICLES, PLAIN_WORD, TOKEN, Piece, name_pairs, plain_blanks
from skein.scale import FEW_ROWS, checkpoint, left_join_skewed
from skein.session import ship_package

K = len(LABELS)
NAME = LABELS.index("name")

#: Documents the field is trained on, about; they are taken by a hash of the id.
TRAIN_DOCS = 3_000
#: Features kept (the most frequent of the sample), and how often one must occur.
MAX_FEATURES, MIN_COUNT = 60_000, 3
#: Share of the words whose entry in the lexicon, and of the documents whose forms, the field isn't told of in training.
HIDDEN = 0.5
#: Most rounds of belief propagation over the skip edges, and the change of a probability below which they end.
ROUNDS, SETTLED = 8, 0.01
#: Least probability of a candidate whose form is exact, and of every word of a name that the lexicon doesn't have in full.
FORM, UNSURE = 0.2, 0.95
#: Longest chain of the training; a longer window is trained on in parts of this length. Inference runs over whole windows.
CHAIN = 64
#: Padded tokens that are passed together; a longer chain is passed alone.
BATCH_CELLS = 512 * CHAIN

ITEMS = "doc_id long, redacted string, items array<struct<pii_type:string,pii_value:string,start:int,end:int>>"


# ---- names ----------------------------------------------------------------------------------------------------------


def learned_names(documents: DataFrame, known: DataFrame, support: int = 3) -> DataFrame:
    """(name, kind): the known names and those learned from all documents, lower case; kind is given, family or both.

    A capitalised word is learned as a family name if at least `support`
    different known given names stand before it (or after it and a comma), and
    as a given name likewise by known family names - unless it mostly stands
    before a whole name, as the words that announce one do. Neither the known
    nor the learned names are bounded: both are tables, and words meet them in
    joins after partial counts. Names that are null say nothing.
    """
    ship_package(documents.sparkSession)
    known = known.where("name is not null and name_kind is not null").select(F.lower("name").alias("name"), F.col("name_kind").alias("kind")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(pair for text in batch.column(0).to_pylist() for pair in name_pairs(text))
            columns = [*zip(*counts)] or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip([*columns, counts.values()], (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["form", "left", "right", "open", "n"])

    seen = documents.where("text is not null").select("text").mapInArrow(split, "form string, left string, right string, open boolean, n long")
    seen = checkpoint(seen.groupBy("form", "left", "right", "open").agg(F.sum("n").alias("n")))
    of = lambda side: known.select(F.col("name").alias(side), F.col("kind").alias(f"{side}_kind"))
    by_left, by_right = seen.join(of("left"), "left"), seen.join(of("right"), "right")
    role = lambda df, what, word, partner, ok: df.where(ok).select(F.lit(what).alias("role"), F.col(word).alias("word"), F.col(partner).alias("partner"), "n")
    roles = [
        role(by_left, "family", "right", "left", "left_kind = 'given' and form = 'beside'"),
        role(by_right, "family", "left", "right", "right_kind = 'given' and form = 'comma'"),
        role(by_right, "given", "left", "right", "right_kind = 'family' and form = 'beside' and not open"),
        role(by_left, "given", "right", "left", "left_kind = 'family' and form = 'first' and not open"),
        role(by_right, "before", "left", "right", "right_kind = 'given' and form = 'beside'"),
    ]
    stats = reduce(DataFrame.unionByName, roles).groupBy("word", "role", "partner").agg(F.sum("n").alias("n"))
    stats = stats.groupBy("word").agg(
        F.count(F.when(F.col("role") == "family", 1)).alias("family"),
        F.count(F.when(F.col("role") == "given", 1)).alias("given"),
        F.coalesce(F.sum(F.when(F.col("role") == "given", F.col("n"))), F.lit(0)).alias("n_given"),
        F.coalesce(F.sum(F.when(F.col("role") == "before", F.col("n"))), F.lit(0)).alias("n_before"),
    )
    fits = (F.col("n_before") <= F.col("n_given") * 0.2) & (F.length("word") > 1) & ~F.col("word").isin(*sorted(PARTICLES))
    kinds = F.array_compact(F.array(*[F.when(F.col(k) >= support, F.lit(k)) for k in ("family", "given")]))
    learned = stats.where(fits).select(F.col("word").alias("name"), F.explode(kinds).alias("kind"))
    both = known.unionByName(learned).distinct().groupBy("name").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("_n"))
    return checkpoint(both.select("name", F.when(F.col("_n") > 1, F.lit("both")).otherwise(F.col("kind")).alias("kind")))


def words_of(text: str) -> set[str]:
    """The lower-case words of a text under which a lexicon is asked: tokens, their parts, and what stands between blanks and marks."""
    low = plain_blanks(text).lower()
    words = set(PLAIN_WORD.findall(low)) | {w.lower() for w in TOKEN.findall(plain_blanks(text))}
    parts = {x for w in words if "-" in w for x in w.split("-")}
    return words | parts | {w[3:] for w in words if w.startswith("al-")}


def own_lexicons(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs (doc_id, text) with own, the part of names (name, kind) that occurs in the text, for lexicons of any size.

    Each document's distinct words meet the names in a join; words that many
    documents have are names of a hot key and are kept apart from the shuffle.
    Only names come back, so a document's own lexicon is no larger than its text.
    """
    docs = checkpoint(docs.withColumn("_d", F.xxhash64("doc_id")))  # ids may be null; what two documents share does no harm

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := sorted(words_of(text or "")):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.int64()), pa.array(words, pa.string())], names=["_d", "name"])

    words = docs.select("_d", "text").mapInArrow(split, "_d long, name string")
    met = left_join_skewed(checkpoint(words), names, "name").where("kind is not null")
    own = met.groupBy("_d").agg(F.map_from_entries(F.collect_set(F.struct("name", "kind"))).alias("own"))
    return docs.join(own, "_d", "left").drop("_d")


# ---- the field ------------------------------------------------------------------------------------------------------


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _forward_backward(pot: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log alpha and beta, and log Z of padded chains; pot is (chains, length, K), padding is at the end."""
    n, length, _ = pot.shape
    alpha, beta = np.empty_like(pot), np.zeros_like(pot)
    alpha[:, 0] = pot[:, 0]
    for t in range(1, length):
        new = _lse(alpha[:, t - 1, :, None] + trans, 1) + pot[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = _lse(trans + (pot[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
    return alpha, beta, _lse(alpha[:, -1], 1)


def _padded(chains: list[list[list[int]]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    length, width = max(map(len, chains)), max((len(f) for c in chains for f in c), default=1)
    x = np.full((len(chains), length, width), pad, np.int32)
    mask = np.zeros((len(chains), length), bool)
    for i, c in enumerate(chains):
        mask[i, : len(c)] = True
        for t, f in enumerate(c):
            x[i, t, : len(f)] = f
    return x, mask


def train(chains: list[list[list[int]]], labels: list[list[int]], n_features: int, epochs: int = 8, rate: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features + 1 for padding, K) and transitions (K, K) of a linear chain, by likelihood with adaptive steps."""
    w, trans = np.zeros((n_features + 1, K)), np.zeros((K, K))
    gw, gt = np.full_like(w, 1e-3), np.full_like(trans, 1e-3)
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    batches = [order[i : i + 256] for i in range(0, len(order), 256)]
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            mine = batches[b]
            x, mask = _padded([chains[i] for i in mine], n_features)
            y = np.zeros(mask.shape, np.int64)
            for r, i in enumerate(mine):
                y[r, : len(labels[i])] = labels[i]
            pot = w[x].sum(2)
            alpha, beta, z = _forward_backward(pot, trans, mask)
            err = -np.exp(alpha + beta - z[:, None, None])
            err[np.arange(len(mine))[:, None], np.arange(mask.shape[1]), y] += 1
            err[~mask] = 0
            grad = np.zeros_like(w)
            for k in range(x.shape[2]):
                np.add.at(grad, x[:, :, k], err)
            grad[n_features] = 0
            both = mask[:, 1:]
            pair = np.exp(alpha[:, :-1, :, None] + trans + (pot[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            gtr = -(pair * both[:, :, None, None]).sum((0, 1))
            np.add.at(gtr, (y[:, :-1][both], y[:, 1:][both]), 1)
            grad -= 1e-3 * w
            gw += grad**2
            gt += gtr**2
            w += rate * grad / np.sqrt(gw)
            trans += rate * gtr / np.sqrt(gt)
    return w.astype(np.float32), trans.astype(np.float32)


def skip_potential(pairs: Counter) -> np.ndarray:
    """Log potential of a token's label (rows) and its group's label (columns): how much likelier than by chance."""
    n = np.full((K, K), 0.5)
    for (a, b), k in pairs.items():
        n[a, b] += k
    p = n / n.sum()
    return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -2.0, 2.0).astype(np.float32)


def group_label(labels: list[int]) -> int:
    """The label of a group of similar tokens: that which most of its items have, 0 where none is an item."""
    items_ = Counter(x for x in labels if x)
    return min(items_, key=lambda x: (-items_[x], x)) if items_ else 0


def posterior(model: dict, chains: list[list[list[int]]], edges: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Label probabilities of every token of every chain, by loopy belief propagation.

    edges are (group, chain, place): every member of a group of similar tokens
    has a skip edge to a node of the group, so that all members are two steps
    apart, however many they are. Chains of like length are passed together, as
    many as BATCH_CELLS allows, so a long chain costs no padding of others.
    Between the passes members and groups send each other messages, made from
    the sender's belief without what the edge itself brought it, until no
    belief moves by more than SETTLED or ROUNDS are over.
    """
    if not chains:
        return []
    at = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    base = np.zeros((at[-1], K), np.float32)
    groups = []
    linked = {c for _, c, _ in edges}  # only chains with skip edges change between the rounds, so they are passed apart
    order = sorted(range(len(chains)), key=lambda i: (i in linked, len(chains[i])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < min(len(order), lo + 512) and len(chains[order[hi]]) * (hi + 1 - lo) <= BATCH_CELLS and (order[hi] in linked) == (order[lo] in linked):
            hi += 1
        mine, lo = order[lo:hi], hi
        length = len(chains[mine[-1]])
        place = at[np.array(mine)][:, None] + np.arange(length)
        mask = np.arange(length) < np.array([len(chains[i]) for i in mine])[:, None]
        place[~mask] = 0
        groups.append((mask, place, mine[0] in linked))
        for t in range(0, length, BATCH_CELLS):  # features of a part at a time: they take the most room
            x, part = _padded([chains[i][t : t + BATCH_CELLS] for i in mine], len(model["w"]) - 1)
            base[place[:, t : t + BATCH_CELLS][part]] = model["w"][x].sum(2)[part]
    token = np.array([at[c] + i for _, c, i in edges], np.int64)
    _, hub = np.unique(np.array([g for g, _, _ in edges], np.int64), return_inverse=True)
    to_token = np.zeros((len(token), K), np.float32)
    belief, before = np.empty_like(base), None
    for turn in range(ROUNDS):
        extra = np.zeros_like(base)
        np.add.at(extra, token, to_token)
        for mask, place, again in groups:
            if turn and not again:
                continue
            pot = base[place] + extra[place]
            pot[~mask] = 0
            if pot.shape[1] > CHAIN:  # the sums along a long chain outgrow single precision
                pot = pot.astype(np.float64)
            alpha, beta, z = _forward_backward(pot, model["trans"], mask)
            belief[place[mask]] = (alpha + beta - z[:, None, None])[mask]
        if not len(token) or (before is not None and np.abs(np.exp(belief[token]) - before).max() < SETTLED):
            break
        before = np.exp(belief[token])
        to_hub = _lse(model["skip"] + (belief[token] - to_token)[:, :, None], 1)
        to_hub -= _lse(to_hub, 1)[:, None]
        told = np.zeros((hub.max() + 1, K), np.float32)
        np.add.at(told, hub, to_hub)
        to_token = _lse(model["skip"] + (told[hub] - to_hub)[:, None, :], 2)
        to_token -= _lse(to_token, 1)[:, None]
    prob = np.exp(belief)
    return [prob[at[i] : at[i + 1]] for i in range(len(chains))]


# ---- one text -------------------------------------------------------------------------------------------------------


def _key(word: str) -> str:
    """What makes two tokens similar: letters only, without marks and case."""
    plain = unicodedata.normalize("NFKD", word.lower().removeprefix("al-"))
    return "".join(c for c in plain if c.isalpha() and not unicodedata.combining(c))


def chains_of(piece: Piece, longest: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The chains (first token, last + 1) of a text, and skip edges (group, chain, place) of its repeated or similar tokens.

    Chains are the windows of the text, or parts of them of at most `longest`.
    """
    spans = [(a, min(a + (longest or hi), hi)) for lo, hi in piece.windows() for a in range(lo, hi, longest or hi)]
    groups: dict[str, list[tuple[int, int]]] = {}
    for c, (lo, hi) in enumerate(spans):
        for i in range(lo, hi):
            w = piece.words[i]
            if len(w) >= 3 and w[0].isalpha() and (w[0].isupper() or piece.classes[i] or i in piece.marks):
                groups.setdefault(_key(w), []).append((c, i - lo))
    return spans, [(n, *x) for n, g in enumerate(groups.values()) if len(g) > 1 for x in g]


def silver(piece: Piece) -> list[int]:
    """Labels for training: candidates by their form, names where both parts are names."""
    labels = [0] * len(piece.words)
    for i, (label, form) in piece.marks.items():
        labels[i] = label
        if form == "tax" and len(piece.words[i]) == 11:
            near = {w.lower() for w in piece.words[max(0, i - 4) : i]}
            if not near & {"id", "nr", "no", "idnr", "tax", "steuer", "steuer-id", "nummer", "number"}:
                labels[i] = 0
    for lo, hi, at in piece.name_spans(0, len(piece.words)):
        if is_certain(piece, at):
            for i in range(lo, hi):
                labels[i] = NAME
    return labels


def is_certain(piece: Piece, at: list[int]) -> bool:
    """True if a span's words are a given name or initial and a family name by the lexicon."""
    kinds = [piece.classes[i] if len(piece.words[i]) > 1 else "initial" for i in at]
    kinds = [k for k in kinds if k not in ("part", "title")]
    ends = kinds[:1] + kinds[-1:]
    first, second = ({"given", "both", "initial"}, {"family", "both"})
    return len(kinds) >= 2 and ((ends[0] in first and ends[1] in second) or (ends[0] in second and any(k in first for k in kinds[1:])))


def read(model: dict, pieces: list[Piece | None], skip: bool = True) -> list[list[tuple[int, int, int]]]:
    """The items of each text, by the field; skip=False leaves the skip edges out."""
    index, spans, chains, edges, groups = model["index"], [], [], [], 0
    for piece in pieces:
        s, e = chains_of(piece) if piece else ([], [])
        if skip:
            edges += [(groups + g, len(chains) + c, i) for g, c, i in e]
        groups += len(e)
        chains += [[[index[x] for x in piece.features(i) if x in index] for i in range(*c)] for c in s]
        spans.append(s)
    probs, at, out = posterior(model, chains, edges), 0, []
    for piece, s in zip(pieces, spans):
        out.append(items(piece, s, probs[at : at + len(s)]) if s else [])
        at += len(s)
    return out


def items(piece: Piece, spans: list[tuple[int, int]], probs: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the items of a text, in order and apart."""
    score = np.zeros((len(piece.words), K), np.float32)
    for (lo, hi), p in zip(spans, probs):
        score[lo:hi] = p
    starts = piece.starts
    found: list[tuple[float, int, int, int]] = []
    for start, end, label, _ in piece.found:
        mine = [i for i in range(np.searchsorted(starts, start), np.searchsorted(starts, end)) if piece.words[i][0].isalnum()]
        if mine and score[mine, label].mean() > FORM:
            found.append((end - start + 1000, start, end, label))
    for lo, hi in spans:
        for a, b, at in piece.name_spans(lo, hi):
            words = [i for i in at if piece.classes[i] != "part"]
            # Every word must look like part of a name, the more so where the lexicon doesn't know both; an initial alone proves nothing.
            full = [i for i in words if len(piece.words[i]) > 1]
            certain = is_certain(piece, at)
            if len(words) >= 2 and full and min(score[i, NAME] for i in full) > (FORM if certain else UNSURE):
                end = starts[b - 1] + len(piece.words[b - 1])
                found.append((end - starts[a] + 500 * certain, starts[a], end, NAME))
    out: list[tuple[int, int, int]] = []
    for _, start, end, label in sorted(found, reverse=True):
        if all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, label))
    return sorted(out)


# ---- over a corpus --------------------------------------------------------------------------------------------------


def _lexicons(rows: pd.DataFrame, every: Broadcast | None) -> list[dict[str, str]]:
    """The lexicon of each row: the same for every one, or the row's own."""
    return [every.value] * len(rows) if every is not None else [dict(x) if x is not None else {} for x in rows["own"]]


def sampled(documents: DataFrame, train_docs: int) -> DataFrame:
    """The at most train_docs documents with text whose hashed ids are least: the same on every run, whatever the partitions."""
    order = ["_h", "doc_id", "text"]
    return documents.where("text is not null").withColumn("_h", F.xxhash64("doc_id", F.lit(11))).orderBy(*order).limit(train_docs)


def fit(documents: DataFrame, train_docs: int = TRAIN_DOCS, lexicon: Broadcast | None = None) -> dict:
    """The field's features, weights, transitions, skip potential and common words, from a sample of at most train_docs documents.

    documents have doc_id, text and, unless a lexicon for all is given, own: the
    names that occur in the text. Labels come from forms and from names of which both parts are in the lexicon. So
    that the field does not just learn these rules by heart, in about half of the
    documents it is not told what the lexicon knows of some words, in half of
    them not which form a candidate has: there the words around must do. Words
    between capitals that are in neither are the examples of what is no name.
    At most train_docs * 8 chains, in the order of the hashed ids, are used.
    """
    sample = checkpoint(sampled(documents, train_docs).repartition("_h"))
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])\p{Ll}[\p{L}'’\-]+"), F.lit(0)))
    common = sample.select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = frozenset(r["w"] for r in common.orderBy(F.desc("n"), "w").limit(MAX_FEATURES).collect())

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, doc, text, names in zip(f["_h"], f["doc_id"], f["text"], _lexicons(f, lexicon)):
                piece = Piece(text, names, common)
                spans, edges = chains_of(piece, CHAIN)
                truth = silver(piece)
                groups: dict[int, list[int]] = {}
                for g, c, i in edges:
                    groups.setdefault(g, []).append(truth[spans[c][0] + i])
                pairs = [[x, group_label(g)] for g in groups.values() for x in g]
                rng = np.random.default_rng(key % 2**63)
                mine = sorted({w.lower() for w in piece.words} & names.keys())
                piece.hide({w for w in mine if rng.random() < HIDDEN}, rng.random() < HIDDEN)
                for n, (lo, hi) in enumerate(spans):
                    features = [[piece.features(i) for i in range(lo, hi)]]
                    yield pd.DataFrame({"_h": key, "doc_id": doc, "n": n, "features": features, "labels": [truth[lo:hi]], "pairs": [pairs if n == 0 else []]})

    schema = "_h long, doc_id long, n int, features array<array<string>>, labels array<int>, pairs array<array<int>>"
    rows = sample.mapInPandas(label, schema).orderBy("_h", "doc_id", "n").limit(train_docs * 8).collect()
    counts: Counter = Counter(x for r in rows for f in r["features"] for x in f)
    kept = [x for x, n in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:MAX_FEATURES] if n >= MIN_COUNT]
    index = {x: i for i, x in enumerate(kept)}
    chains = [[[index[x] for x in f if x in index] for f in r["features"]] for r in rows]
    if chains:
        w, trans = train(chains, [list(r["labels"]) for r in rows], len(kept))
    else:
        w, trans = np.zeros((1, K), np.float32), np.zeros((K, K), np.float32)
    skip = skip_potential(Counter(tuple(p) for r in rows for p in r["pairs"]))
    return {"index": index, "w": w, "trans": trans, "skip": skip, "common": common}


def placeholders(text: str, found: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for start, end, label in found:
        out += [text[last:start], f"[{LABELS[label].upper()}]"]
        last = end
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, known: DataFrame, train_docs: int = TRAIN_DOCS, most_names: int = FEW_ROWS, per_batch: int = 128) -> DataFrame:
    """(doc_id, redacted, items): each text with every item replaced by a placeholder of its type, all else unchanged.

    items holds type, exact value and place (in code points). A null text
    stays null and has no items; an empty one stays empty. Texts are read
    whole. Names in known may be null or repeated; without known names only the
    other types, and names that their context gives away, are found. Up to
    most_names names of the lexicon go to every task, and nothing but words and
    counts is shuffled; of a larger lexicon each document gets, by a join, the
    names that it holds, with the same result.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    names, every, told = learned_names(docs, known), None, docs
    if names.count() <= most_names:
        every = spark.sparkContext.broadcast(dict(names.select("name", "kind").collect()))  # counted just above
    else:
        told = checkpoint(own_lexicons(docs, names))
    shared = spark.sparkContext.broadcast(fit(told, train_docs, every))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for whole in frames:
            for lo in range(0, len(whole), per_batch):
                f = whole.iloc[lo : lo + per_batch]
                pieces = [Piece(t, names, model["common"]) if t else None for t, names in zip(f["text"], _lexicons(f, every))]
                mine = read(model, pieces)
                texts = [placeholders(t, m) if m else t for t, m in zip(f["text"], mine)]
                found = [[{"pii_type": LABELS[k], "pii_value": t[a:b], "start": a, "end": b} for a, b, k in m] for t, m in zip(f["text"], mine)]
                yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "redacted": texts, "items": found})

    return told.mapInPandas(run, ITEMS)


def found_items(redacted: DataFrame) -> DataFrame:
    """Each distinct item of each document: doc_id, pii_type, pii_value."""
    one = redacted.select("doc_id", F.explode(F.array_distinct(F.transform("items", lambda i: F.struct(i["pii_type"].alias("t"), i["pii_value"].alias("v"))))).alias("i"))
    return one.select("doc_id", F.col("i.t").alias("pii_type"), F.col("i.v").alias("pii_value"))
