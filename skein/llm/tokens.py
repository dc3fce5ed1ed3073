"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

Texts are split into pieces by the tokenizer's pattern; the distinct pieces of a
batch are laid out in padded numpy matrices, one per length class, and in each
round every row merges its leftmost pair of minimum rank, until no pair of the
row is in the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import ship_package

#: Fixed value: the split of the byte-level tokenizers, with white space by its Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of ASCII letters only, which the standard library splits in half the time.
_BLANK = r"\t\n\x0b\x0c\r "
ASCII_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_BLANK}A-Za-z0-9]+"
    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_NONE = np.int32(2**31 - 1)
#: Bytes from which on a piece is merged by itself, all occurrences of the best pair a round.
LONG = 256
#: Pieces that a worker remembers.
REMEMBERED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in prints}
    rest = [b for b in range(256) if b not in set(prints)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What encoding needs of a tokenizer file: ids of the bytes and the hashed table of pairs (about 4 MB)."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    of_byte = np.zeros(256, np.int32)
    for letter, b in byte_letters().items():
        of_byte[b] = vocab[letter]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    size = 1 << int(np.ceil(np.log2(len(pairs) * 6)))
    keys = np.full(size, -1, np.int64)
    ranks = np.full(size, _NONE, np.int32)
    probes = 1
    for rank, (key, at) in enumerate(zip((left << 20 | right).tolist(), _slot(left, right, size).tolist())):
        n = 1
        while keys[at] != -1:
            at, n = (at + 1) % size, n + 1
        keys[at], ranks[at], probes = key, rank, max(probes, n)
    return {"bytes": of_byte, "keys": keys, "ranks": ranks, "merged": merged, "probes": probes}


def _slot(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed >> np.uint64(29)) & np.uint64(size - 1)).astype(np.int64)


def pair_ranks(table: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair, _NONE where it isn't in the table or an end is padding (below 0)."""
    keys, ranks = table["keys"], table["ranks"]
    a, b = left.astype(np.int64), right.astype(np.int64)
    out = np.full(a.shape, _NONE, np.int32)
    real = np.nonzero((a >= 0) & (b >= 0))
    key = a[real] << 20 | b[real]
    at = _slot(a[real], b[real], len(keys))
    found = np.full(key.shape, _NONE, np.int32)
    todo = np.arange(len(key))
    for _ in range(table["probes"]):
        here = keys[at[todo]]
        hit = here == key[todo]
        found[todo[hit]] = ranks[at[todo[hit]]]
        todo = todo[~hit & (here != -1)]
        if not len(todo):
            break
        at[todo] = (at[todo] + 1) % len(keys)
    out[real] = found
    return out


def _merge_rows(table: dict, matrix: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Token ids of each row of a padded matrix of byte ids."""
    out: list = [None] * len(matrix)
    row = np.arange(len(matrix))
    m, n = matrix, lengths.copy()
    ranks = pair_ranks(table, m[:, :-1], m[:, 1:])
    while len(row):
        best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
        low = np.take_along_axis(ranks, best[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(row), _NONE)
        done = low == _NONE
        if done.any():  # compaction: only rows with a pair left go on
            for i in np.nonzero(done)[0]:
                out[row[i]] = m[i, : n[i]].copy()
            go = ~done
            row, m, n, ranks, best, low = row[go], m[go], n[go], ranks[go], best[go], low[go]
            if not len(row):
                break
        every = np.arange(len(row))
        m[every, best] = table["merged"][low]
        n -= 1
        cols = np.arange(m.shape[1] - 1)
        m = np.take_along_axis(m, cols + (cols > best[:, None]), 1)  # close the gap at best + 1
        width = int(n.max())
        m = m[:, :width]
        cols = np.arange(max(ranks.shape[1] - 1, 0))
        ranks = np.take_along_axis(ranks, cols + (cols > best[:, None]), 1)[:, : max(width - 1, 0)]
        for side in (best - 1, best):  # the two pairs that the new token is part of
            ok = np.nonzero((side >= 0) & (side < ranks.shape[1]))[0]
            at = side[ok]
            right = np.where(at + 1 < n[ok], m[ok, at + 1], -1)
            ranks[ok, at] = pair_ranks(table, m[ok, at], right)
        short = np.arange(ranks.shape[1]) >= (n - 1)[:, None]
        ranks[short] = _NONE
    return out


def _merge_long(table: dict, ids: np.ndarray) -> np.ndarray:
    """As _merge_rows for one long row; all places of the best pair merge in one round.

    That is the same: a pair that a merge creates ranks after the merge itself.
    """
    while len(ids) > 1:
        ranks = pair_ranks(table, ids[:-1], ids[1:])
        low = ranks.min()
        if low == _NONE:
            break
        at = np.nonzero(ranks == low)[0]
        run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])  # in a run of touching places every other one merges
        start = np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1])
        at = at[(np.arange(len(at)) - start[run]) % 2 == 0]
        ids[at] = table["merged"][low]
        ids = np.delete(ids, at + 1)
    return ids


def encode_pieces(table: dict, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of each piece."""
    out: list = [None] * len(pieces)
    lengths = np.array([len(p) for p in pieces])
    for long in np.nonzero(lengths > LONG)[0]:
        out[long] = _merge_long(table, table["bytes"][np.frombuffer(pieces[long], np.uint8)]).tolist()
    top, least = 4, 0
    while least < LONG:
        mine = np.nonzero((lengths > least) & (lengths <= top))[0]
        if len(mine):
            n = lengths[mine]
            matrix = np.full((len(mine), int(n.max())), -1, np.int32)
            flat = table["bytes"][np.frombuffer(b"".join(pieces[i] for i in mine), np.uint8)]
            matrix[np.arange(matrix.shape[1]) < n[:, None]] = flat
            for i, ids in zip(mine, _merge_rows(table, matrix, n)):
                out[i] = ids.tolist()
        least, top = top, top * 2
    return out


class Encoder:
    """Encodes texts batch by batch; remembers the pieces it has met, within a bound."""

    def __init__(self, table: dict):
        import regex

        self.table, self.known = table, {}
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.split_ascii(t) if t.isascii() else self.split(t) for t in texts]
        new = [w for w in set(chain.from_iterable(words)) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(set(chain.from_iterable(words)))
        self.known.update(zip(new, encode_pieces(self.table, [w.encode("utf-8") for w in new])))
        return [list(chain.from_iterable(map(self.known.__getitem__, w))) for w in words]


@lru_cache(maxsize=4)
def _loaded(path: str) -> dict:
    return load(path)


def encoded(documents: DataFrame, text: str = "text", path: str | None = None, per_batch: int = 256) -> DataFrame:
    """documents with a column ids (array<int>): the token ids of `text`, without special tokens.

    Null and empty texts have the empty list. Strings of special tokens in a
    text are ordinary text. Rows stay in their partitions; nothing is shuffled.
    The pair table (about 4 MB, fixed by the tokenizer) is the only thing
    broadcast. Other columns are kept; a column called ids is replaced.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(_loaded(path or default_path()))
    keep = documents.drop("ids") if text != "ids" else documents
    schema = T.StructType([*keep.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, per_batch):
                batch = whole.slice(at, per_batch)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                ids = encoder.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"]
                )

    return keep.mapInArrow(run, schema)


def document_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encoded(documents.select("doc_id", "text"), path=path).select("doc_id", "ids")


def n_tokens(ids: Column | str = "ids") -> Column:
    return F.size(ids)
