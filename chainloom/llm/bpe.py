"""Problem 6: the whole corpus as ids of a public byte-level BPE tokenizer.

The merge loop keeps a doubly linked list of symbols and a priority queue of
(merge rank, position); an entry whose symbols have changed since it was queued
is stale and skipped.  Vocabularies are read once by the driver and broadcast
(a fixed table of about 50,000 entries); the folder is a parameter.  Pieces that
recur are looked up in a bounded per-worker memory, so the merge loop runs for
each distinct piece about once.  No shuffle takes place.

Defined results: null, empty and undecodable-as-text inputs give an empty list;
white space is encoded like any other text; the strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: how byte_bpe_50k and byte_bpe_multi_50k cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; the memory is emptied when it is full.
REMEMBERED = 400_000


def read_ranks(name: str, folder: str = DEFAULT_FOLDER) -> dict[bytes, int]:
    """Vocabulary of ``<folder>/<name>.tiktoken``: byte string -> id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by lowest-rank-first merging, leftmost first on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    symbols = [piece[i : i + 1] for i in range(size)]
    before = list(range(-1, size - 1))
    after = list(range(1, size + 1))
    alive = [True] * size
    queue: list[tuple[int, int, bytes]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < size:
            joined = symbols[left] + symbols[right]
            rank = ranks.get(joined)
            if rank is not None:
                heapq.heappush(queue, (rank, left, joined))

    for i in range(size - 1):
        offer(i)
    while queue:
        _, left, joined = heapq.heappop(queue)
        if not alive[left]:
            continue
        right = after[left]
        if right >= size or len(symbols[left]) + len(symbols[right]) != len(joined) or symbols[left] + symbols[right] != joined:
            continue  # stale: one of the two has been merged since
        symbols[left] = joined
        alive[right] = False
        following = after[right]
        after[left] = following
        if following < size:
            before[following] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    out, i = [], 0
    while i < size:
        out.append(ranks[symbols[i]])
        i = after[i]
    return out


class Encoder:
    """Text <-> ids for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[str, list[int]] = {}
        self.cut = regex.compile(PIECES).findall

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, extend = self.known, out.extend
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Concatenation of the vocabulary's strings."""
        if not hasattr(self, "strings"):
            self.strings = {i: s for s, i in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[object, Encoder] = {}


def _encoder(key: object, ranks: dict[bytes, int]) -> Encoder:
    """One encoder a worker and vocabulary, so its memory outlives a task."""
    if key not in _ENCODERS:
        _ENCODERS.clear() if len(_ENCODERS) > 4 else None
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Output (id column, ids array<bigint>): one row per input row, repeated ids included."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(tokenizer, folder))
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder((tokenizer, folder), shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids, ends = [], [0]
                for text in part.column(1).to_pylist():
                    ids.extend(encoder.encode(text))
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.asarray(ids, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])

    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {id_type}, ids array<bigint>")


def count_tokens(documents: DataFrame, tokenizers: list[str], folder: str = DEFAULT_FOLDER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Output (id column, tokenizer, n_tokens): sizes of each text, 0 for null and empty."""
    names = sorted(set(tokenizers))
    shared = documents.sparkSession.sparkContext.broadcast({n: read_ranks(n, folder) for n in names})
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [(n, _encoder((n, folder), shared.value[n])) for n in names]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for name, encoder in encoders:
                sizes = [len(encoder.encode(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * len(sizes), pa.string()), pa.array(sizes, pa.int64())],
                    names=[id_column, "tokenizer", "n_tokens"],
                )

    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {id_type}, tokenizer string, n_tokens bigint")
