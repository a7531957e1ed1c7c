"""Problem 6: encoding of the whole corpus with a public tokenizer.

Byte-level BPE. The text is cut into pieces by a fixed pattern; in every piece the mergeable pairs of neighbours stand
in a segment tree by (rank, place). Its root is the leftmost pair of the lowest rank; a merge updates three leaves, so a
piece of n bytes takes n log n steps, which long unbroken runs need.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every machine (a parameter of every operator here).
VOCABULARIES = "/opt/tokenizers"

# Fixed value: the pattern that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded pieces kept per Python worker, and the longest piece that is kept.
KEPT_PIECES, KEPT_CHARS = 200_000, 40


class PairTree:
    """Segment tree of keys, one leaf per place; the root is the smallest key."""

    def __init__(self, keys: list[int], none: int):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        self.node = node = [none] * size + keys + [none] * (size - len(keys))
        for k in range(size - 1, 0, -1):
            a, b = node[2 * k], node[2 * k + 1]
            node[k] = a if a < b else b

    def put(self, place: int, key: int) -> None:
        node, k = self.node, place + self.size
        node[k] = key
        while k > 1:
            a, b = node[k], node[k ^ 1]
            k >>= 1
            low = a if a < b else b
            if node[k] == low:
                break
            node[k] = low


class Encoder:
    """Encoder of one rank file (``token rank`` per line, tokens in base64)."""

    def __init__(self, file: str):
        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.cut = regex.compile(PATTERN)
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a piece, as bytes."""
        n, ranks = len(data), self.ranks
        if n < 2:
            return [data] if n else []
        shift = n.bit_length()
        mask, none = (1 << shift) - 1, 1 << 60
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = PairTree([(ranks.get(data[i : i + 2], none) << shift) | i for i in range(n - 1)], none)
        node = tree.node
        while node[1] < none:
            i = node[1] & mask
            j = after[i]
            k = after[j]
            part[i], part[j] = part[i] + part[j], None
            after[i] = k
            if j < n - 1:
                tree.put(j, none)
            if k < n:
                before[k] = i
                rank = ranks.get(part[i] + part[k])
                tree.put(i, none if rank is None else (rank << shift) | i)
            else:
                tree.put(i, none)
            h = before[i]
            if h >= 0:
                rank = ranks.get(part[h] + part[i])
                tree.put(h, none if rank is None else (rank << shift) | h)
        return [p for p in part if p is not None]

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.kept.get(text)
        if ids is None:
            ranks = self.ranks
            ids = tuple(ranks[token] for token in self.merge(text.encode()))
            if len(text) <= KEPT_CHARS:
                if len(self.kept) >= KEPT_PIECES:
                    self.kept.clear()
                self.kept[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            kept, piece = self.kept, self.piece
            for p in self.cut.findall(text):
                ids += kept.get(p) or piece(p)
        return ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        kept, piece = self.kept, self.piece
        return sum(len(kept.get(p) or piece(p)) for p in self.cut.findall(text))


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = VOCABULARIES) -> Encoder:
    """The encoder of ``{folder}/{name}.tiktoken``, one per Python worker."""
    return Encoder(f"{folder}/{name}.tiktoken")


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): the token ids of every document's text, without special tokens.

    Null and empty texts have the empty list. Every row gives one row; special tokens' strings are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder)
        for batch in batches:
            lists = [np.asarray(e.encode(text.as_py()), np.int32) for text in batch["text"]]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """The ``keep`` columns (text not among them) and ``n_tokens`` (long) of every row's text; 0 for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder)
        for batch in batches:
            n = pa.array([e.count(text.as_py()) for text in batch["__text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), n], names=[*keep, "n_tokens"])

    rows = documents.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    return rows.mapInArrow(run, f"{schema}, n_tokens long")
