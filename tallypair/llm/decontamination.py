"""Benchmark decontamination: suffix arrays of the training documents, searched for every test suffix."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, without, written
from .suffixes import suffix_order
from .words import LETTERS, LOWER, slices, texts_of, words_of

#: Test items are sent to the tasks in blocks of about so many bytes of text, eight times as much in memory.
BLOCK_BYTES = 4 << 20
#: Text bytes of one suffix array.
SHARD_BYTES = 4 << 20
#: A word of a text whose A-Z are lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCH = "item_id string, document_word long, item_word long, n_words long"
FOUND = f"doc_id long, row long, n_words long, matches array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"


class ItemSuffixes:
    """The suffixes of some test items that a window begins: hashes of the items' words, one item after
    the other, and where each suffix starts, its item's rest (``left``) and window (``need``) in words."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is not None, i or ""))
        number = {x: i for i, x in enumerate(self.ids)}
        self.said = [WORD.findall(t.encode().lower()) for _, t in items]
        raw, offsets = texts_of(pa.array([t for _, t in items], pa.string()))
        text, nth, (self.words,) = words_of(raw, offsets, LETTERS, LOWER)
        n = np.bincount(text, minlength=len(items))
        left, need = n[text] - nth, np.minimum(n, width)[text]
        self.starts = np.flatnonzero(left >= need)
        self.left, self.need, self.row, self.at = (x[self.starts] for x in (left, need, text, nth))
        self.item = np.array([number[i] for i, _ in items], np.int64)[self.row] if items else self.row


class SuffixArray:
    """All suffixes, in words, of a shard of documents, sorted by the hashes of their words to the documents' ends."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.text, self.nth, (self.words,) = words_of(raw, offsets, LETTERS, LOWER)
        self.counts = np.bincount(self.text, minlength=len(offsets) - 1)
        self.left = self.counts[self.text] - self.nth
        self.order, _ = suffix_order((self.words,), self.left, 1, int(self.counts.max(initial=1)))

    def _common(self, place: np.ndarray, tests: ItemSuffixes, which: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that the shard's suffixes at ``place`` and the test suffixes ``which`` have in common at their
        start, ``most`` at most, and whether the shard's comes before."""
        common, before = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        todo = np.flatnonzero(most > 0)
        k = 0
        while len(todo):
            ended = self.left[place[todo]] <= k
            there = self.words[np.minimum(place[todo] + k, len(self.words) - 1)]
            sought = tests.words[tests.starts[which[todo]] + k]
            before[todo] = ended | (there < sought)
            k += 1
            todo = todo[~ended & (there == sought)]
            common[todo] = k
            before[todo] = False
            todo = todo[most[todo] > k]
        return common, before

    def _edge(self, tests: ItemSuffixes, which: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
        """Binary search of test suffixes, of each its first ``most`` words: the first slot not before (or after) it."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.order), np.int64)
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) // 2
            common, before = self._common(self.order[middle], tests, which[todo], most[todo])
            if after:
                before |= common == most[todo]
            low[todo[before]] = middle[before] + 1
            high[todo[~before]] = middle[~before]
        return low

    def longest(self, tests: ItemSuffixes) -> np.ndarray:
        """Words of the longest match of each test suffix: with a neighbour of its own place in the array."""
        every = np.arange(len(tests.starts))
        best = np.zeros(len(every), np.int64)
        if len(self.order) and len(every):
            slot = self._edge(tests, every, tests.left)
            for side in (np.maximum(slot - 1, 0), np.minimum(slot, len(self.order) - 1)):
                best = np.maximum(best, self._common(self.order[side], tests, every, tests.left)[0])
        return best

    def search(self, tests: ItemSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Every (test suffix, word of the shard at which its window occurs): of the suffixes whose longest
        match holds their window, the slots between the window's edges."""
        which = np.flatnonzero(self.longest(tests) >= tests.need)
        low = self._edge(tests, which, tests.need[which])
        count = self._edge(tests, which, tests.need[which], True) - low
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(which, count), self.order[np.repeat(low, count) + inside]


def _longest(array: SuffixArray, tests: ItemSuffixes) -> tuple[np.ndarray, ...]:
    """Longest matches: windows that follow each other in a document and an item joined. Arrays by
    document: text, number of the item's row, item, word of the document, word of the item, words, window."""
    suffix, place = array.search(tests)
    text, at, row, item_at = array.text[place], array.nth[place], tests.row[suffix], tests.at[suffix]
    order = np.lexsort((at, at - item_at, row, text))
    text, at, row, item_at, size, item = text[order], at[order], row[order], item_at[order], tests.need[suffix][order], tests.item[suffix][order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (row[1:] != row[:-1]) | ((at - item_at)[1:] != (at - item_at)[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(text))[1:] - 1
    return text[first], row[first], item[first], at[first], item_at[first], at[last] + size[last] - at[first], size[first]


def _verbatim(raw: np.ndarray, offsets: np.ndarray, array: SuffixArray, tests: ItemSuffixes) -> list[tuple[int, int, int, int, int]]:
    """The longest matches as (text, item, word of the document, word of the item, words), their words
    compared; words alike in hash only part a match."""
    out, own, said = [], -1, []
    for text, row, item, at, item_at, n, need in zip(*(x.tolist() for x in _longest(array, tests)), strict=True):
        if text != own:
            own, said = text, WORD.findall(raw[offsets[text] : offsets[text + 1]].tobytes().lower())
        theirs, begin = tests.said[row], 0
        if said[at : at + n] == theirs[item_at : item_at + n]:
            out.append((text, item, at, item_at, n))
            continue
        for k in range(n + 1):
            if k == n or said[at + k] != theirs[item_at + k]:
                if k - begin >= need:
                    out.append((text, item, at + begin, item_at + begin, k - begin))
                begin = k + 1
    return out


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> list[DataFrame]:
    """For each block of test items: ``doc_id, row`` (a hash of id and text), ``n_words, matches`` of every input row, a match being
    ``item_id, document_word, item_word, n_words`` (words from 0). One block unless the items' texts are
    over ``BLOCK_BYTES``; a pass is narrow: the items go to the tasks, documents are not shuffled."""
    spark = docs.sparkSession
    items = written(benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null"), "test-items")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row"))

    def block(k: int) -> DataFrame:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(ItemSuffixes([(r.item_id, r.text) for r in part.collect()], width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            for batch in batches:
                raw, offsets = texts_of(batch.column(1))
                for a, b in slices(offsets, SHARD_BYTES):
                    cut = offsets[a : b + 1]
                    shard, ends = raw[cut[0] : cut[-1]], cut - cut[0]
                    array = SuffixArray(shard, ends)
                    found = _verbatim(shard, ends, array, tests)
                    text, item, *numbers = map(list, zip(*found, strict=True)) if found else [[]] * 5
                    fields = [pa.array([tests.ids[i] for i in item], pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(np.array(text, np.int64), minlength=b - a))])
                    matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["item_id", "document_word", "item_word", "n_words"]))
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(array.counts, pa.int64()), matches], ["doc_id", "row", "n_words", "matches"])

        return rows.mapInArrow(run, FOUND)

    return [block(k) for k in range(blocks)]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for matches in batch.column(2).to_pylist():
            hit, end = 0, 0
            for a, b in sorted((m["document_word"], m["document_word"] + m["n_words"]) for m in matches):
                hit += max(0, b - max(a, end))
                end = max(end, b)
            items = sorted({m["item_id"] for m in matches} - {None})
            out.append((hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every input row.

    A window is ``width`` successive words of an item, or all words of a shorter one. Null and wordless
    texts have no words and no hits; null and wordless items match nothing; items
    that share an id count once; those without an id hit like any other, but ``n_items`` and the hash are
    of ids only. Repeated documents each get a row; without items nothing is
    contaminated; an empty table gives no rows. Other columns are ignored.
    """
    blocks = verbatim_matches(docs, benchmark, width)
    rows = blocks[0].select("doc_id", "n_words", "matches")
    if len(blocks) > 1:
        # some more passes over the documents: the rows of one document meet, its matches together
        each = blocks
        every = each[0].withColumn("copies", F.lit(1))
        for x in each[1:]:
            every = every.unionByName(x.withColumn("copies", F.lit(0)))
        met = every.groupBy("doc_id", "row", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.sum("copies").alias("copies"))
        rows = met.withColumn("_", F.explode(F.expr("sequence(1, copies)"))).select("doc_id", "n_words", F.array_distinct("matches").alias("matches"))
    return rows.mapInArrow(_summed, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text holds no window of a test item. Null, empty and
    wordless texts stay; very long ones are searched whole; repeated rows go or stay together; rows that
    share an id, or have none, are judged each by its own text. An empty table gives no rows, an empty
    benchmark keeps all; columns of any other name pass unchanged."""
    hit = None
    for x in verbatim_matches(docs, benchmark, width):
        own = x.where(F.size("matches") > 0).select(F.col("row").alias("key"))
        hit = own if hit is None else hit.unionByName(own)
    return without(docs, written(hit.distinct(), "contaminated"))
