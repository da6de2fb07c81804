"""Stupid-backoff scores of documents, from n-gram counts over all documents.

Four tables, joined by key:
  chunks    bounded runs of consecutive documents as sequences of word numbers (written in the shared folder);
  requests  for each chunk and each bucket of hashes the distinct n-grams of the chunk and their counts: n-grams are
            exploded and counted before the shuffle, so a frequent n-gram is one entry of a chunk;
  counts    in each bucket the sums over chunks, joined back to the requests that asked;
  scores    chunks joined to their answers by chunk, scores summed by document.

An n-gram's count leaves out the document that is scored, or every n-gram would have been seen. The score of a word is
log(count / count of its context) at the highest order seen, plus log(ALPHA) for each order backed off; a word that no
other document has gets 1 / words as its share, one order further down. Words are lower-cased runs of digits, letters and
non-ASCII characters; n-grams don't cross documents and are told apart by 64-bit hashes.

Cases: null, empty and wordless texts score 0 with 0 words (mean null). Very long texts are a chunk of their own. Repeated
rows count, and score, once each. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, mixed, slices, words, written

ORDER, ALPHA = 2, 0.4
CHUNK = 1_500_000  #: words of a chunk, unless a document has more
BUCKET = 1 << 20  #: n-grams of a bucket, about

_CHUNK = "chunk long,doc_ids array<long>,lengths array<int>,vocabulary binary,sequence binary,n_words long"


def planes(x: np.ndarray) -> bytes:
    """The numbers as planes of their first bytes, second bytes and so on: high planes are nearly all zero and compress away."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers_of(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    numbers = Numbers()
    ids, lengths, sequence, held = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
        seq = np.concatenate([*sequence, np.zeros(0, np.int32)]).astype("<i4")
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | made]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([hashes.tobytes()], pa.binary()), pa.array([planes(seq)], pa.binary()), pa.array([len(seq)])],
            names=["chunk", "doc_ids", "lengths", "vocabulary", "sequence", "n_words"],
        )

    for batch in batches:
        for part in slices(batch):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                w = words(t)
                if held and held + len(w) > CHUNK:
                    yield chunk()
                    made += 1
                    numbers, ids, lengths, sequence, held = Numbers(), [], [], [], 0
                sequence.append(np.array([numbers[x] for x in w], np.int32))
                ids.append(i)
                lengths.append(len(w))
                held += len(w)
    if ids:
        yield chunk()


def keys(vocabulary: bytes, sequence: bytes, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the positions at which an n-gram ends and the n-grams' hashes."""
    h = np.frombuffer(vocabulary, np.uint64)[numbers_of(sequence, "<i4")]
    inside = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, key = [], mixed(h)
    for n in range(1, order + 1):
        at = np.flatnonzero(inside >= n - 1)
        if n > 1:
            key = np.concatenate([key[:1], mixed(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])])
        out.append((at, key[at]))
    return out


def _requests(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every = np.concatenate([k for _, k in keys(row["vocabulary"], row["sequence"], np.array(row["lengths"], np.int64), order)])
                got, n = np.unique(every, return_counts=True)
                cuts = np.searchsorted(got >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64))
                cuts = np.append(cuts, len(got))
                full = [b for b in range(1 << bits) if cuts[b + 1] > cuts[b]]
                for k in range(0, len(full), 64):
                    some = full[k : k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some)), pa.array([planes(np.diff(got[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))) for b in some], pa.binary()), pa.array([planes(n[cuts[b] : cuts[b + 1]].astype("<u4")) for b in some], pa.binary())],
                        names=["bucket", "chunk", "keys", "counts"],
                    )

    return run


def _answers(bucket: pa.Table) -> pa.Table:
    parts = [np.cumsum(numbers_of(p, "<u8"), dtype=np.uint64) for p in bucket["keys"].to_pylist()]
    distinct = np.unique(np.concatenate(parts))
    places = [np.searchsorted(distinct, p) for p in parts]
    sums = np.zeros(len(distinct), "<u8")
    for at, counts in zip(places, bucket["counts"].to_pylist()):
        sums[at] += numbers_of(counts, "<u4")
    return pa.table({"chunk": bucket["chunk"], "bucket": bucket["bucket"], "sums": pa.array([planes(sums[at]) for at in places], pa.binary())})


def _runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, the keys in it, where runs of one key in one document begin, and how long they are."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    return order, key, first, np.diff(np.append(first, len(key)))


def _scores(order: int, alpha: float, total: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        lengths = np.array(row["lengths"], np.int64)
        by_order = keys(row["vocabulary"], row["sequence"], lengths, order)
        by_bucket = sorted(zip(answers["bucket"].to_pylist(), answers["sums"].to_pylist()))
        sums = np.concatenate([numbers_of(s, "<u8") for _, s in by_bucket] or [np.zeros(0, "<u8")]).astype(np.int64)
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        runs = [_runs(key, doc[at]) for at, key in by_order]
        distinct = np.unique(np.concatenate([key[first] for _, key, first, _ in runs]))
        others: list[np.ndarray] = []
        for (at, _), (order_, key, first, own) in zip(by_order, runs):
            left = np.zeros(len(doc), np.int64)
            if len(first):
                left[at[order_]] = np.repeat(sums[np.searchsorted(distinct, key[first])] - own, own)
            others.append(left)
        rest = np.maximum(1, total - lengths)[doc]
        score, open_ = np.zeros(len(doc)), np.ones(len(doc), bool)
        backed = np.zeros(len(doc))
        for n in range(order, 0, -1):
            at = np.zeros(len(doc), bool)
            at[by_order[n - 1][0]] = True
            context = rest if n == 1 else np.append(0, others[n - 2][:-1])
            seen = open_ & at & (others[n - 1] > 0)
            score[seen] = np.log(others[n - 1][seen] / context[seen]) + backed[seen] * math.log(alpha)
            open_ &= ~seen
            backed[open_ & at] += 1
        score[open_] = -np.log(rest[open_]) + backed[open_] * math.log(alpha)
        sums_ = np.bincount(doc, score, len(lengths))
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(lengths), "log_score": sums_})

    return run


def stupid_backoff(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, log_score (sum over the words) and mean_log_score (null without words)."""
    chunks = written(id_and_bytes(docs).mapInArrow(_chunks, _CHUNK), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, total) * order / BUCKET)))
    requests = chunks.mapInArrow(_requests(order, bits), "bucket int,chunk long,keys binary,counts binary")
    answers = requests.groupBy("bucket").applyInArrow(_answers, "chunk long,bucket int,sums binary")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(order, alpha, total), "doc_id long,n_words long,log_score double")
    return scored.select("doc_id", "n_words", "log_score", F.expr("IF(n_words > 0, log_score / n_words, NULL)").alias("mean_log_score"))
