"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 10).

The alphabet is words (ASCII-lowercased runs of letters, digits and non-ASCII
characters), the test strings are the windows of 10 consecutive words of each item; an
item of fewer words is one window. Windows of one length form a set: a table of
word-pair blocks says how far the search may jump from the block that ends at the
current position (unseen blocks: the whole window less one word), at a block with shift zero the
hash of the window that ends there selects a bucket, and a direct comparison of the words
confirms each occurrence. Words are numbered, and all tables are packed arrays.

Defined results: null text has no words; a null item id counts for hits but names no
item; repeated items count once; overlapping and repeated occurrences count each word
once; an empty benchmark hits nothing; other columns are ignored.

The tables are broadcast in blocks of at most ``block_bytes`` of item text, measured
before collecting; further blocks are further narrow passes over the documents, so a
benchmark of any size is searched whole and no pass holds more than one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes

#: Bytes of item text whose tables are broadcast together; the tables take some ten times as much.
BLOCK_BYTES = 8 << 20
#: Words that are searched together, unless one text has more.
RUN_WORDS = 200_000
#: Every byte that separates words becomes a blank, A-Z become a-z.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Search for the windows of ``m`` words of items, given as arrays of word numbers.

    Tables are arrays: the sorted word-pair blocks with the shift of each, and the sorted
    hashes of the different windows (the buckets) with a place in the items' words to compare
    with and the items of each. Words are numbered below ``words``; -1 is a word of no item."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, m: int, words: int) -> None:
        self.m, self.words, self.block = m, words, min(2, m)
        self.far = m - self.block + 1
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        self.text = np.concatenate(texts).astype(np.int32)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        left = np.repeat(lengths, lengths) - place
        last = np.flatnonzero(left >= self.block)  # the first word of every block
        key, shift = self._blocks(self.text)[last], np.maximum(0, m - self.block - place[last])
        order = np.lexsort([shift, key])
        first = np.concatenate([[True], np.diff(key[order]) != 0])
        self.keys, self.shift = key[order][first], np.minimum(shift[order][first], 255).astype(np.uint8)
        start = np.flatnonzero(left >= m)
        hashes, owner = self.hashes(self.text, start), np.repeat(owners, lengths)[start]
        order = np.lexsort([owner, hashes])
        hashes, start, owner = hashes[order], start[order], owner[order]
        new = np.concatenate([[True], np.diff(hashes) != 0])
        group = np.cumsum(new) - 1
        # windows of one hash that are not equal have a bucket together; the others are one window
        apart = np.zeros(len(start), bool)
        for k in range(m):
            apart |= self.text[start + k] != self.text[start[new][group] + k]
        new |= apart
        once = new | np.concatenate([[True], np.diff(owner) != 0])
        start, owner, hashes, new = start[once], owner[once], hashes[once], new[once]
        self.at = np.flatnonzero(new)
        self.bucket, self.start = hashes[self.at], start[self.at]
        self.owner = owner
        self.at = np.append(self.at, len(owner))

    def _blocks(self, text: np.ndarray) -> np.ndarray:
        """The block that starts at each word (-1: in no item); with one word a block, the word."""
        if self.block == 1:
            return text.astype(np.int64)
        a, b = text[:-1].astype(np.int64), text[1:].astype(np.int64)
        return np.append(np.where((a < 0) | (b < 0), -1, a * self.words + b), -1)

    def hashes(self, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), np.uint64)
        for k in range(self.m):
            h = (h ^ text[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, number of the window) of every occurrence in an array of word numbers."""
        n, m = len(text), self.m
        if n < m:
            return
        blocks = self._blocks(text)
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        shift = np.where(self.keys[at] == blocks, self.shift[at], self.far)
        back = m - self.block  # from a window's last block to its start
        if not (shift[back:] == 0).any():
            return
        jump, at, ends = shift.tolist(), back, []
        while at <= n - self.block:
            if jump[at]:
                at += jump[at]
                continue
            ends.append(at)
            at += 1
        start = np.array(ends, np.int64) - back
        hashes = self.hashes(text, start)
        low, high = np.searchsorted(self.bucket, hashes), np.searchsorted(self.bucket, hashes, side="right")
        for k in np.flatnonzero(low < high).tolist():
            for w in range(low[k], high[k]):
                if (self.text[self.start[w] : self.start[w] + m] == text[start[k] : start[k] + m]).all():
                    yield int(start[k]), w

    def items(self, window: int) -> list[int]:
        return self.owner[self.at[window] : self.at[window + 1]].tolist()


class Searchers:
    """The searcher of each length of window among items ``(id as string, text)``."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            words = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)], np.int32)
            if len(words):
                by_length[min(window, len(words))].append((i, words))
        self.each = [WuManber([w for _, w in own], np.array([i for i, _ in own]), m, len(self.numbers)) for m, own in sorted(by_length.items())]

    def searched(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, WuManber, int]]]]:
        """Of runs of texts: (first text, the number after the last one, words of each, their
        occurrences as (text, start, searcher, window)). The texts of a run are searched as one,
        with a word of no item between two of them."""
        get, first = self.numbers.get, 0
        while first < len(texts):
            run, counts, last = [], [], first
            while last < len(texts) and len(run) < RUN_WORDS:
                words = words_of(texts[last])
                run.extend(map(get, words, repeat(-1)))
                run.append(-1)
                counts.append(len(words))
                last += 1
            begin = np.cumsum(np.array(counts) + 1) - np.array(counts) - 1
            text, found = np.array(run, np.int32), []
            for s in self.each:
                for start, window in s.search(text):
                    doc = int(np.searchsorted(begin, start, side="right")) - 1
                    found.append((first + doc, start - int(begin[doc]), s, window))
            yield first, last, np.array(counts), found
            first = last

    def found(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """(number of words, merged word intervals inside occurrences, items) of each text."""
        for first, last, counts, hits in self.searched(texts):
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            windows: dict[int, set] = defaultdict(set)
            for doc, start, s, window in hits:
                spans[doc].append((start, start + s.m))
                windows[doc].add((s.m, window))
            of = {s.m: s for s in self.each}
            for doc in range(first, last):
                items = {self.names[i] for m, w in windows.get(doc, ()) for i in of[m].items(w)}
                yield int(counts[doc - first]), merged(spans.get(doc, [])), items

    def hit(self, texts: list[bytes]) -> list[bool]:
        """Whether each text has an occurrence."""
        some = {doc for *_, hits in self.searched(texts) for doc, *_ in hits}
        return [i in some for i in range(len(texts))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, as intervals in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (item id as string, text), each of about ``block_bytes``."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r["item"], r["text"].encode()) for r in part.toLocalIterator()]


FOUND = "spans array<struct<start:int,end:int>>, items array<string>"


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text, n_words, spans, items)`` of every document: merged word intervals
    inside occurrences of a window, and the sorted ids of the items found."""
    sc = docs.sparkSession.sparkContext
    empty = lambda kind, name: F.expr(f"cast(array() as array<{kind}>)").alias(name)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), empty("struct<start:int,end:int>", "spans"), empty("string", "items"))
    kind = out.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for block in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        tables = sc.broadcast(Searchers(block, window))

        def run(batch: pa.RecordBatch, tables=tables) -> pa.RecordBatch:
            counts, spans, items = [], [], []
            each = tables.value.found(as_bytes(batch.column("text")))
            for (count, new, found), old, had in zip(each, batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                counts.append(count)
                if old:  # of the blocks before
                    new = merged([*new, *((x["start"], x["end"]) for x in old)])
                spans.append([{"start": s, "end": e} for s, e in new])
                items.append(sorted({x for x in found if x is not None} | set(had)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

        out = arrow_map(out, run, f"doc_id {kind}, text string, n_words long, {FOUND}")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` per document."""
    found = occurrences(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean_only(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, all columns as they were."""
    sc, out = docs.sparkSession.sparkContext, docs
    schema = docs.schema
    at = docs.columns.index(text_col)
    for block in _item_blocks(benchmark, item_col, item_text_col, block_bytes):
        tables = sc.broadcast(Searchers(block, window))

        def run(batch: pa.RecordBatch, tables=tables) -> pa.RecordBatch:
            clean = [not x for x in tables.value.hit(as_bytes(batch.column(at)))]
            return batch.filter(pa.array(clean, pa.bool_()))

        out = arrow_map(out, run, schema)
    return out
