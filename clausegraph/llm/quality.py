"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of
all documents' vote patterns estimates how each labeller votes on good and on bad documents; the pattern's posterior
labels a bounded sample (about TRAIN_DOCS documents, chosen by hash), on which a hashed linear scorer is trained. The
scorer then scores every whole text; no gold label is used.

Cases: null and empty texts are scored like any other (they hold no words and are voted bad). Very long texts are read
whole. Repeated rows get equal scores. With no rows, or one class only, every document gets the pattern's posterior.
Other columns are ignored by `quality_scores` and kept by `quality_filter`.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, per_document, shared_dir

TRAIN_DOCS = 4000  #: expected size of the training sample; at most twice as many are taken
DIM = 4096  #: hashed features
ROUNDS = 100
LEAST_RATIO = 20  #: a vote for bad is at least so many times as likely on a bad document as on a good one
THRESHOLD = 0.5  #: least score that is accepted

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, OTHER = b"0123456789", bytes(range(128, 256))
MARKS = b"*#$%&|~^_=<>{}[]\\@+"
JUNK = re.compile(rb"[*#$%&~^_=]{3}")
SENTENCE = re.compile(rb"[.!?][\"')]?[\x20\t]*(?:\n|$)")


def measures(text: bytes | None) -> dict[str, float | None]:
    """What the labellers look at; None where a text is too short to tell, or where blanks may not part words: in texts mostly
    of characters beyond ASCII, words are counted by their bytes, and measures of single words tell nothing."""
    t = text or b""
    w = t.split()
    n = len(w)
    count = lambda some: len(t) - len(t.translate(None, some))
    letters = count(UPPER + LOWER + OTHER)
    lines = [x for x in t.split(b"\n") if x.strip()]
    solid = max(1, len(t) - count(b" \t\n\r\x0b\x0c"))
    few = n < 20
    wide = 2 * count(OTHER) > max(1, letters)
    if wide:
        n = max(n, letters // 6)
    return {
        "words": float(n),
        "upper": None if letters < 40 else count(UPPER) / letters,
        "marks": None if not n else count(MARKS) / solid,
        "junk": None if not n else len(JUNK.findall(t)) / n,
        "bars": None if few else t.count(b"|") / n,
        "shouts": None if not n else t.count(b"!!") / n,
        "distinct": None if few or wide else len(set(w)) / math.sqrt(n),
        "runs": None if n < 8 or wide else sum(map(bytes.__eq__, w, w[1:])) / n,
        "lines": None if len(lines) < 4 else len(set(lines)) / len(lines),
        "ends": None if few or wide else len(SENTENCE.findall(t)) / len(lines),
        "letters": None if few else letters / solid,
        "length": None if few or wide else solid / n,
        "digits": None if few else count(DIGITS) / solid,
    }


#: Labeller: the measure, votes bad, votes good (a lower and an upper bound each).
LABELLERS = (
    ("words", (-1, 0.5), (20, 1e18)), ("upper", (0.4, 2), (-1, 0.15)), ("marks", (0.1, 2), (-1, 0.02)), ("junk", (0.2, 9e9), (-1, 0.02)),
    ("bars", (0.2, 9e9), (-1, 0.02)), ("shouts", (0.2, 9e9), (-1, 0.05)), ("distinct", (-1, 2.0), (3.0, 1e18)), ("runs", (0.15, 2), (-1, 0.05)),
    ("lines", (-1, 0.5), (0.9, 2)), ("ends", (-1, 0.05), (0.5, 1e18)), ("letters", (-1, 0.6), (0.85, 2)), ("length", (12, 1e18), (2.5, 9)), ("digits", (0.2, 2), (-1, 0.05)),
)


def votes(m: dict[str, float | None]) -> int:
    """The votes as one number in base three: 0 abstains, 1 is bad, 2 is good."""
    code = 0
    for name, bad, good in LABELLERS:
        x = m[name]
        code = code * 3 + (0 if x is None else 1 if bad[0] < x <= bad[1] else 2 if good[0] < x <= good[1] else 0)
    return code


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Probability of good for each pattern, by expectation-maximisation over the labellers' accuracies and the classes' share."""
    k = len(LABELLERS)
    v = np.stack([patterns // 3 ** (k - 1 - j) % 3 for j in range(k)], axis=1)
    bad = (v == 1).sum(axis=1)
    post = np.where(bad == 0, 0.95, 0.3 / np.maximum(bad, 1))
    for _ in range(rounds):
        tables = np.empty((k, 3, 2))
        for y, w in enumerate((counts * (1 - post), counts * post)):
            for j in range(k):
                tables[j, :, y] = np.bincount(v[:, j], w, 3) + 0.01
        tables /= tables[:, 1:].sum(axis=1, keepdims=True)
        tables[:, 0] = 1  # who abstains tells nothing
        # A vote for bad is evidence of bad, or rare kinds of junk would settle as a habit of good documents.
        tables[:, 1, 0] = np.maximum(tables[:, 1, 0], np.minimum(0.99, LEAST_RATIO * tables[:, 1, 1]))
        tables[:, 2, 0] = 1 - tables[:, 1, 0]
        share = np.clip((counts * post).sum() / counts.sum(), 0.01, 0.99)
        logs = np.log([1 - share, share]) + sum(np.log(tables[j][v[:, j]]) for j in range(k))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return new


def hashed(text: bytes | None, m: dict[str, float | None]) -> np.ndarray:
    """Unit vector of hashed byte trigrams (square roots of their shares), beside hashed tokens of each measure's range."""
    x = np.zeros(DIM, np.float32)
    t = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    if len(t) > 2:
        code = (t[:-2] * np.uint32(0x9E3779B1) ^ t[1:-1] * np.uint32(0x85EBCA77) ^ t[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        x += np.sqrt(np.bincount(code >> np.uint32(20), minlength=DIM) / (len(t) - 2))
    for j, (name, bad, good) in enumerate(LABELLERS):
        v = m[name]
        zone = 0 if v is None else 1 if bad[0] < v <= bad[1] else 2 if good[0] < v <= good[1] else 3
        x[(j * 4 + zone) * 2654435761 % DIM] += 0.5
    return x / np.linalg.norm(x)


def train(x: np.ndarray, p: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the logistic scorer for soft labels (the last one is the bias), by accelerated gradient steps."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, rate = w.copy(), 3.0
    for k in range(steps):
        got = 1 / (1 + np.exp(-(x @ ahead[:-1] + ahead[-1])))
        err = (got - p) / len(p)
        new = ahead - rate * np.append(x.T @ err + ridge * ahead[:-1], err.sum()).astype(np.float32)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def fitted(docs: DataFrame, train_docs: int = TRAIN_DOCS):
    """A function from whole texts to probabilities of good, fitted to the votes on all documents."""
    shared_dir(docs.sparkSession)
    pattern = per_document(docs, "doc_id long,pattern long", lambda _, texts: {"pattern": [votes(measures(t)) for t in texts]})
    seen = pattern.groupBy("pattern").count().collect()  # at most 3 ** len(LABELLERS) rows
    codes, counts = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float)
    total = int(counts.sum())
    posterior = dict(zip(codes.tolist(), estimate(codes, counts).tolist())) if total else {}

    def features(_, texts):
        got = [measures(t) for t in texts]
        return {"pattern": [votes(m) for m in got], "x": [hashed(t, m).astype(np.float16).tobytes() for t, m in zip(texts, got)]}

    share = min(1.0, train_docs / max(1, total))
    chosen = F.pmod(F.xxhash64(F.xxhash64("text"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = per_document(docs.where(chosen), "doc_id long,pattern long,x binary", features).limit(2 * train_docs).collect()
    weights = None
    p = np.array([posterior.get(r.pattern, 0.5) for r in sample], np.float32)
    if (p > 0.5).any() and (p < 0.5).any():
        weights = train(np.stack([np.frombuffer(bytes(r.x), np.float16) for r in sample]).astype(np.float32), p)

    def score(texts: list[bytes | None]) -> list[float]:
        out = []
        for t in texts:
            m = measures(t)
            if weights is None:
                out.append(posterior.get(votes(m), 0.5))
            else:
                out.append(float(1 / (1 + np.exp(-(hashed(t, m) @ weights[:-1] + weights[-1])))))
        return out

    return score


def quality_scores(docs: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of good), accepted."""
    score = fitted(docs, train_docs)
    scored = per_document(docs, "doc_id long,score double", lambda _, texts: {"score": score(texts)})
    return scored.withColumn("accepted", F.col("score") >= threshold)


def quality_filter(docs: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the scorer accepts, with all their columns."""
    score = fitted(docs, train_docs)
    return keep_rows(docs, lambda texts: [s >= threshold for s in score(texts)])
