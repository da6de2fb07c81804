"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded stretch of the words of consecutive documents. Its words are symbols of the alphabet that the test
phrases use; a word outside that alphabet can't stand in a phrase and parts two runs, and runs shorter than the shortest
phrase can't hold one. Over each shard a suffix array gives the Burrows-Wheeler transform, a wavelet matrix its ranks;
backward search finds all phrases at once, and occurrences are located by walking to sampled suffix positions. Spans of
occurrences are merged into removal spans.

Phrases are windows of `size` consecutive words of an item; an item with fewer words, but not none, is one phrase.

Cases: null and empty texts have no words and no hits; null, empty and wordless items have no phrases. Equal windows of
several items count for each item; rows of one item id count as one item (a null id as the empty string). Very long
texts are cut into shards that overlap by one word less than the longest phrase. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_bytes, keep_rows, slices, words, written

SHARD = 1 << 20  #: symbols of a shard
SAMPLE = 8  #: every so many positions are sampled
BLOCK_BYTES = 4 << 20  #: benchmark text carried by a pass (its phrases take some 14 times that); more text takes more passes


class FMIndex:
    """Over `text`: symbols from 1, and 0 between and after runs. No phrase holds a 0; zeros order by their position."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.n, self.symbols = len(text), symbols
        suffixes = suffix_array(text, symbols)
        self.bwt = text[suffixes - 1]
        self.bwt[suffixes == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.sampled = (suffixes % SAMPLE == 0) | (self.bwt == 0)
        self.samples = suffixes[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.levels = []
        level = self.bwt
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            ones = level >> bit & 1
            sums = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=sums[1:])
            self.levels.append((bit, sums, self.n - int(sums[-1])))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before the row."""
        low = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = ones[low], ones[at]
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur, and the rows from and to which their suffixes stand. Phrases end at the right."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        for step in range(phrases.shape[1]):
            over = lengths[which] == step
            if over.any():
                done.append((which[over], low[over], high[over]))
                which, low, high = which[~over], low[~over], high[~over]
            c = phrases[which, -1 - step]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            some = high > low
            which, low, high = which[some], low[some], high[some]
            if not len(which):
                break
        done.append((which, low, high))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        found, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            at = rows[todo]
            there = self.sampled[at]
            found[todo[there]] = self.samples[self.sample_rank[at[there]]] + steps
            todo = todo[~there]
            at = rows[todo]
            c = self.bwt[at]
            rows[todo] = self.first[c] + self.rank(c, at)
            steps += 1
        return found


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Prefix doubling; only groups that are still equal are sorted again. The text's last symbol is 0."""
    n, bits = len(text), int(symbols).bit_length()
    packed, depth = np.zeros(n, np.int64), max(1, 62 // bits)
    open_run = np.ones(n, bool)
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    for k in range(depth):
        part = padded[k : k + n] * open_run
        packed = packed << bits | part
        open_run &= part > 0
    order = np.argsort(packed, kind="stable")
    packed, single = packed[order], ~open_run[order]
    while True:
        new = np.concatenate([[True], (packed[1:] != packed[:-1]) | single[1:]])
        starts = np.flatnonzero(new)
        group = np.repeat(starts, np.diff(np.append(starts, n)))
        rank = np.empty(n, np.int64)
        rank[order] = group
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            return order
        packed, single = group, np.zeros(n, bool)
        key = group[slots] * (n + 1) + rank[order[slots] + depth]
        by = np.argsort(key, kind="stable")
        order[slots] = order[slots][by]
        packed = packed * (n + 1)
        packed[slots] = key[by]
        depth *= 2


class Phrases:
    """Windows of the items as symbols, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        self.symbol: dict[bytes, int] = {}
        numbers: dict[tuple[int, ...], int] = {}
        self.items: list[list[str]] = []
        for item, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in words(text)]
            for k in range(max(1, len(w) - size + 1)) if w else ():
                n = numbers.setdefault(tuple(w[k : k + size]), len(numbers))
                if n == len(self.items):
                    self.items.append([])
                self.items[n].append(item)
        self.lengths = np.array([len(p) for p in numbers], np.int64)
        self.longest, self.shortest = (int(self.lengths.max()), int(self.lengths.min())) if numbers else (0, 0)
        self.words = np.zeros((len(numbers), self.longest), np.int64)
        for k, p in enumerate(numbers):
            self.words[k, self.longest - len(p) :] = p

    def occurrences(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of occurrences and numbers of their phrases; `text` has 0 where no phrase can stand."""
        inside = np.concatenate([[0], (text > 0).astype(np.int8), [0]])
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = ends - starts >= self.shortest
        pieces: list[tuple[int, int]] = []
        held = 0
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            while True:
                c = min(b, a + SHARD)
                pieces.append((a, c))
                held += c - a + 1
                if held >= SHARD:
                    yield self._in_shard(text, pieces)
                    pieces, held = [], 0
                if c == b:
                    break
                a = c - self.longest + 1
        if pieces:
            yield self._in_shard(text, pieces)

    def _in_shard(self, text: np.ndarray, pieces: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([b - a for a, b in pieces])
        first = np.cumsum(np.append(0, sizes[:-1] + 1))
        total = int(sizes.sum() + len(sizes))
        back = np.arange(total) + np.repeat(np.array([a for a, _ in pieces]) - first, sizes + 1)
        shard = text[np.minimum(back, len(text) - 1)]
        shard[first + sizes] = 0
        index = FMIndex(shard, len(self.symbol))
        which, low, high = index.search(self.words, self.lengths)
        many = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        return back[index.locate(rows)], np.repeat(which, many)

    def scan(self, texts: list[bytes | None], spans: list[list[int]], items: list[list[str]]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Words of each text, its removal spans (start, end, start, ... in words) and the items found, beside those given."""
        coded, get = [], self.symbol.get
        for t in texts:
            coded.append(np.array([get(w, 0) for w in words(t)] + [0], np.int64))
        sizes = np.array([len(c) for c in coded])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.zeros(edge[-1] + 1, np.int64)
        found: list[set[str]] = [set(x) for x in items]
        if len(self.lengths):
            for at, which in self.occurrences(np.concatenate(coded)):
                np.add.at(marks, at, 1)
                np.add.at(marks, at + self.lengths[which], -1)
                pairs = np.unique(np.stack([np.searchsorted(edge, at, "right") - 1, which]), axis=1)
                for d, p in pairs.T.tolist():
                    found[d].update(self.items[p])
        for k, s in enumerate(spans):
            for a, b in zip(s[::2], s[1::2]):
                marks[edge[k] + a] += 1
                marks[edge[k] + b] -= 1
        hit = np.concatenate([[0], (np.cumsum(marks)[:-1] > 0).astype(np.int8), [0]])
        turns = np.diff(hit)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        merged: list[list[int]] = [[] for _ in texts]
        for d, a, b in zip((np.searchsorted(edge, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
            merged[d] += [a - int(edge[d]), b - int(edge[d])]
        return (sizes - 1).tolist(), merged, [sorted(x) for x in found]


def without(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    bounds = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, end = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[end : bounds[a][0]])
        end = bounds[b - 1][1]
    return b"".join([*out, text[end:]])


def benchmark_blocks(benchmark: DataFrame) -> tuple[int, DataFrame]:
    """How many blocks of about BLOCK_BYTES of text the benchmark makes, and its items."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES)), rows


def phrases_of(rows: DataFrame, block: int, blocks: int, size: int) -> Phrases:
    """The phrases of a block, which the driver reads; its size is bounded by the number of blocks."""
    own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    return Phrases([(r.item_id, None if r.text is None else bytes(r.text)) for r in own.sort("item_id", "text").collect()], size)


def removal_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, cut: bool = False) -> DataFrame:
    """doc_id, n_words, spans (array<long> of starts and ends in words), items (array<string>) and, with `cut`, text without the spans.

    A pass carries at most about BLOCK_BYTES of benchmark text to the executors, as checked; larger benchmarks are dealt
    by hash into several passes over the documents, whose spans and items are merged document by document. What a pass finds
    is written before the next block comes, so the driver holds one block at a time."""
    schema = "doc_id long,text binary,n_words long,spans array<long>,items array<string>"
    df = id_and_bytes(docs).selectExpr("doc_id", "text", "0L AS n_words", "CAST(array() AS array<long>) AS spans", "CAST(array() AS array<string>) AS items")
    blocks, rows = benchmark_blocks(benchmark)
    for block in range(blocks):
        last = block == blocks - 1
        df = df.mapInArrow(_pass(phrases_of(rows, block, blocks, size), last, cut), schema)
        df = df if last else written(df, "spans")
    return df if cut else df.drop("text")


def _pass(phrases: Phrases, last: bool, cut: bool):
    kinds = arrow_schema("doc_id long,text binary,n_words long,spans array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                n, spans, items = phrases.scan(texts, part.column(3).to_pylist(), part.column(4).to_pylist())
                kept = texts if not last else [t if t is None else without(t, s) for t, s in zip(texts, spans)] if cut else [None] * len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(spans, kinds.field("spans").type), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return removal_spans(docs, benchmark, size).select(
        "doc_id", "n_words",
        F.expr("aggregate(transform(spans, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows whose text holds no phrase, with all their columns."""
    blocks, rows = benchmark_blocks(benchmark)
    for block in range(blocks):
        phrases = phrases_of(rows, block, blocks, size)
        docs = keep_rows(docs, lambda texts, p=phrases: [not s for s in p.scan(texts, [[]] * len(texts), [[]] * len(texts))[1]])
        docs = docs if block == blocks - 1 else written(docs, "clean")
    return docs
