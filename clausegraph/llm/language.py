"""Language identification as mixture inference.

Each language has a distribution over hashed byte trigrams of words, counted over every training text. A document's
trigrams are drawn from a mixture of languages: expectation-maximisation starts from all of them and estimates the
proportions, and of nested sets of languages (the one with the least fitted proportion leaves first) the one with the best
penalised likelihood is selected. The prediction is the selected set's largest proportion; the score is that language's
proportion before selection. Work grows with the square of the number of languages, and slices of text shrink with it.

Cases: null texts and texts without a letter are `und` with score 0. Texts with letters that no training text has are
equally likely in all languages, and ties go to the first language by name. Rows without a language or an id don't
train; with no training rows every text is `und`. Very long texts count whole; repeated rows get equal predictions;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_bytes, slices

BITS = 15
FEATURES = 1 << BITS
STEPS = 8  #: rounds of expectation-maximisation for each set
PENALTY = 1.0  #: times half the logarithm of the number of trigrams, for each language beyond the first
LETTER = re.compile(r"[^\W\d_]")
#: Letters to lower case, other ASCII to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (ascending), features and counts of the hashed trigrams of words with a space on both sides."""
    keys = []
    for k, t in enumerate(texts):
        joined = b" " + b" ".join((t or b"").translate(LETTERS).split()) + b" "
        b = np.frombuffer(joined, np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            keys.append((code >> np.uint32(32 - BITS)).astype(np.int64) | k << BITS)
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return found >> BITS, found & (FEATURES - 1), counts


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(LETTER.search(text.decode("utf-8", "replace")))


def profiles(docs: DataFrame, held_out: str) -> tuple[list[str], np.ndarray]:
    """Languages by name and the logarithm of their trigrams' probabilities, over all rows that aren't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch.select(["lang", "text"]), 8 << 20):
                langs, texts = np.array(part.column(0).to_pylist(), object), part.column(1).to_pylist()
                d, f, c = trigrams(texts)
                for lang in set(langs):
                    own = (langs == lang)[d]
                    sums.setdefault(lang, np.zeros(FEATURES, np.int64))
                    sums[lang] += np.bincount(f[own], c[own], FEATURES).astype(np.int64)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "feature", "n"])

    train = docs.where(f"NOT ({held_out}) AND lang IS NOT NULL AND doc_id IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    rows = train.mapInArrow(count, "lang string,feature int,n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # at most FEATURES rows a language
    langs = sorted(got["lang"].unique())
    table = np.full((FEATURES, len(langs)), 0.5)
    table[got["feature"], [langs.index(x) for x in got["lang"]]] += got["n"]
    return langs, np.log(table / table.sum(axis=0))


def mixtures(texts: list[bytes | None], log_p: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most likely language of each text, the proportions of all languages (those of the first, full mixture), and
    those of the selected set (0 outside it)."""
    d, f, c = trigrams(texts)
    n, k = len(texts), log_p.shape[1]
    proportions, best = np.full((n, k), 1 / k), np.zeros(n, np.int64)
    selected = np.zeros((n, k))
    if not len(d):
        return best, proportions, selected
    there, first = np.unique(d, return_index=True)
    row = np.searchsorted(there, d)
    logs = log_p[f]
    alone = np.add.reduceat(logs * c[:, None], first)
    total = np.add.reduceat(c, first).astype(float)
    active = np.ones(alone.shape, bool)
    shift = logs.max(axis=1)
    p = np.exp(logs - shift[:, None])
    base = np.add.reduceat(shift * c, first)
    value, choice, full = np.full(len(there), -np.inf), None, None
    pi = active / active.sum(axis=1, keepdims=True)
    chosen = pi
    for size in range(k, 0, -1):
        for _ in range(steps if size > 1 else 1):
            part = p * pi[row]
            part *= (c / part.sum(axis=1))[:, None]
            pi = np.add.reduceat(part, first) / total[:, None]
        fit = base + np.add.reduceat(np.log((p * pi[row]).sum(axis=1)) * c, first) - penalty * 0.5 * np.log(total) * (size - 1)
        if full is None:
            full = pi
        better = fit > value
        value, chosen = np.where(better, fit, value), np.where(better[:, None], pi, chosen)
        if size > 1:
            least = np.where(active, pi, np.inf)
            least = np.where(least == least.min(axis=1, keepdims=True), alone, np.inf).argmin(axis=1)
            active[np.arange(len(least)), least] = False
            pi = np.where(active, np.maximum(pi, 1e-9), 0)
            pi /= pi.sum(axis=1, keepdims=True)
    proportions[there], best[there], selected[there] = full, chosen.argmax(axis=1), chosen
    return best, proportions, selected


def identify(docs: DataFrame, held_out: str = "crc32(CAST(doc_id AS STRING)) % 4 = 2") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the selected set by name) and proportions (of each of them).

    `held_out` is the SQL of the rows that don't train."""
    held_out = f"coalesce({held_out}, false)"
    langs, log_p = profiles(docs, held_out)
    schema = "doc_id long,lang_pred string,score double,languages array<string>,proportions array<double>"
    kinds = arrow_schema(schema)
    most = (8 << 20) * 4 // max(4, len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                texts = part.column(1).to_pylist()
                best, share, chosen = mixtures(texts, log_p) if langs else ([0] * len(texts), *[np.zeros((len(texts), 1))] * 2)
                known = [bool(langs) and has_letter(t) for t in texts]
                pred = [langs[b] if ok else "und" for b, ok in zip(best, known)]
                score = [float(min(1.0, share[i, best[i]])) if ok else 0.0 for i, ok in enumerate(known)]
                sets = [np.flatnonzero(chosen[i]) if ok else [] for i, ok in enumerate(known)]
                columns = [pa.array(pred, pa.string()), pa.array(score), pa.array([[langs[j] for j in x] for x in sets], kinds.field("languages").type), pa.array([[float(chosen[i, j]) for j in x] for i, x in enumerate(sets)], kinds.field("proportions").type)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=kinds)

    found = id_and_bytes(docs).mapInArrow(run, schema)
    return found.select("doc_id", F.expr(held_out).alias("held_out"), "lang_pred", "score", "languages", "proportions")
