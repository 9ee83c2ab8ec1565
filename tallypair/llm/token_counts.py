"""Token counts: byte-pair merging with a heap and a linked list, without emitting identifiers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space, and the split of a byte-level vocabulary that uses it.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Pieces whose counts a worker remembers; it starts anew when there are more.
REMEMBERED = 300_000
SHIFT = 24
_loaded: dict[str, Counter] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 letters stand
    for themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Counter:
    """Counts the tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab = said["model"]["vocab"]
        self.special = [x["content"] for x in said["added_tokens"]]
        self.byte_ids = [vocab[c] for c in _byte_letters()]
        self.merges = {}
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << SHIFT | vocab[b]] = (rank, vocab[a + b])
        self.known: dict[str, int] = {}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, piece: bytes) -> int:
        """Symbols that are left when the lowest-rank adjacent pair (the leftmost of equals) is merged
        until none can be."""
        ids, merges = [self.byte_ids[b] for b in piece], self.merges
        n = left = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m[0] * n + i for i in range(n - 1) if (m := merges.get(ids[i] << SHIFT | ids[i + 1]))]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or not (m := merges.get(ids[i] << SHIFT | ids[j])) or m[0] != rank:
                continue  # one of its symbols has been merged meanwhile
            ids[i], ids[j], left = m[1], -1, left - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(ids[i] << SHIFT | ids[k]):
                    heappush(heap, m[0] * n + i)
            if (p := before[i]) >= 0 and (m := merges.get(ids[p] << SHIFT | ids[i])):
                heappush(heap, m[0] * n + p)
        return left

    def count(self, text: str) -> int:
        parts = self.split.split(text) if self.split else [text]
        total, known = len(parts) - 1, self.known
        for part in parts:
            for piece in PIECES.findall(part):
                n = known.get(piece)
                if n is None:
                    n = self.merged(piece.encode())
                    if len(piece) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = n
                total += n
        return total


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text under the vocabulary file ``tokenizer`` (read on the executors).

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row per input row: repeated rows each count.
    A null or empty text has 0 bytes and 0 tokens. A special string inside a text is one token. Other
    columns are ignored. There is no shuffle: one narrow pass over two columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [own.count(x) if x else 0 for x in texts]
            size = [len(x.encode()) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
