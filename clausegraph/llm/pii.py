"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap; boosted regression trees score each from its format and its
context; calibrated thresholds select what is redacted. Spans of the base kinds (e-mail, IP address, card, phone) that
their fixed rules accept always stay; the trees add spans of any kind that those rules miss.

The trees are trained on synthetic labelled spans made from a fixed seed (`TRAINING_SPANS` of them), so the model is the
same for any input; half of the calibration follows from spans that training doesn't see.

Numbers parted by a blank or a sign make one run of digits, so every window of a run's digit groups with 8 to 19 digits is
proposed too; what joins a window to the rest of its run is a feature, and windows of longer runs are in the training spans.

Cases: a null or empty text has no spans. Generators are linear in the text's length, also over long runs of digits or
letters. Repeated rows give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import per_document

#: Order of kinds in spans: the base kinds first.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
TRAINING_SPANS = 6000
MIN_PRECISION = 0.98
SCORED = 1 << 14  #: candidates whose features are held at a time
RANGES = (("phone", 8, 15), ("card", 13, 19), ("id", 9, 12))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+")
GROUP = re.compile(r"[0-9]+")
JOINED_LEFT = re.compile(r"[0-9]([\x20().\-/]{1,2})$")
JOINED_RIGHT = re.compile(r"([\x20().\-/]{1,2})[0-9]")
ASSIGNED = re.compile(r"[=:]")
VALUE = re.compile(r"[\x20\"']{0,3}([A-Za-z0-9+/_\-]{8,})")
NAME = re.compile(r"([A-Za-z_-]{2,24})[\x20\"']{0,3}$")
AT_WORD = re.compile(r"([A-Za-z0-9._+-]{1,64})\x20?[\[(]at[\])]\x20?([A-Za-z0-9-]{1,63}\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z]{2,24})")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign back over the local part, never past the end of the span before."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that don't overlap; those that fail the kind's test are dropped, without retries."""
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return found


def windows(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The run of digits and every window of its groups, by the kinds that their number of digits allows."""
    groups = [(m.start() - (m.start() > start and text[m.start() - 1] == "("), m.end(), m.end() - m.start()) for m in GROUP.finditer(text, start, end)]
    for k, (a, _, _) in enumerate(groups):
        n = 0
        for _, b, size in groups[k : k + 19]:
            n += size
            if n > 19:
                break
            yield from ((kind, a, b) for kind, low, high in RANGES if low <= n <= high)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data, of any length and overlap; most are not."""
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            yield from windows(text, *m.span())
    for m in ASSIGNED.finditer(text):
        if (v := VALUE.match(text, m.end())) and NAME.search(text, max(0, m.start() - 32), m.start()):
            yield ("secret", *v.span(1))
    if "at]" in text or "at)" in text:
        yield from (("email", *m.span()) for m in AT_WORD.finditer(text))


def candidates(text: str) -> list[tuple[str, int, int]]:
    return list(proposals(text))


#: Words that often stand before each kind.
CUES = {
    "phone": re.compile(r"\b(?:phone|tel|call|fax|mobile|cell)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|payment)\b", re.I),
    "id": re.compile(r"\b(?:ssn|social|passport|tax|identity|national)\b", re.I),
    "email": re.compile(r"\b(?:mail|email|contact|write)\b", re.I),
    "secret": re.compile(r"(?:password|passwd|pwd|secret|token|api|key|auth)", re.I),
}
COUNTS = re.compile(r"\b(?:order|invoice|page|version|ref|no|item|isbn|part|lot|total)\b", re.I)


def joined(found: re.Match | None) -> float:
    """0 if no digits adjoin, 1 if they do past blanks, 2 past a sign."""
    return 0.0 if found is None else 1.0 if found[1].isspace() else 2.0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 12]
    d = only_digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    letters = sum(c.isalpha() for c in s)
    counts = [s.count(c) for c in set(s)]
    return [
        KINDS.index(kind), len(s), len(d), letters / len(s), len(groups), groups[0], groups[-1], max(groups),
        s.count("-"), s.count(" "), s.count("."), s.count("/"), float(s[0] == "("), float(luhn(d)) if d else 0.0,
        -sum(c / len(s) * math.log2(c / len(s)) for c in counts), len(set(d)),
        float(bool(CUES[kind].search(before))), float(bool(COUNTS.search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#"), float(after[:1] in "%€°"),
        float(bool(re.search(r"[a-z]", s)) and bool(d)), float(s.isalpha()),
        joined(JOINED_LEFT.search(before) if d else None), joined(JOINED_RIGHT.match(after) if d else None),
    ]


class Boosted:
    """Gradient-boosted trees for the logistic loss, with a sigmoid fitted to held-out margins."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.25):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        mean = y.mean()
        self.base = math.log(mean / (1 - mean))
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, 17)[1:-1])) for col in x.T]
        margin, self.nodes = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grown(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.nodes.append(tree)
            margin += self._value(tree, x)
        return self

    def _grown(self, x, g, h, rows, depth):
        best = (1e-3, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        whole = total_g**2 / (total_h + 1)
        for j, cuts in enumerate(self.cuts) if depth else ():
            for c in cuts:
                left = x[rows, j] <= c
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - whole
                if gain > best[0] and hl > 0.5 and total_h - hl > 0.5:
                    best = (gain, j, c)
        if best[1] is None:
            return self.rate * total_g / (total_h + 1)
        _, j, c = best
        left = x[rows, j] <= c
        return (j, c, self._grown(x, g, h, rows[left], depth - 1), self._grown(x, g, h, rows[~left], depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._value(low, x), self._value(high, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._value(t, x) for t in self.nodes)

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Platt scaling by Newton steps, with smoothed targets."""
        m = self.margin(x)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a = np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a[0] * m + a[1])))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - t) * m).sum(), (p - t).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            move = np.linalg.solve(hess, grad)
            a -= move
            if np.abs(move).max() < 1e-9:
                break
        self.scale = a
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.margin(x) + self.scale[1])))


def synthetic(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of `n` candidate spans in made-up sentences, about half of them personal data."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "ti", "lo", "me", "ra", "st", "ou", "qu", "i"]) for _ in range(r.randint(1, 4)))

    def card(k: int, good: bool) -> str:
        while luhn(s := str(r.randint(3, 6)) + digits(k - 1)) != good:
            pass
        return s if r.random() < 0.6 else r.choice(" -").join(s[i : i + 4] for i in range(0, len(s), 4))

    good = {
        "phone": lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"]),
        "card": lambda: card(r.choice([13, 14, 15, 16, 16]), True),
        "id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: r.choice([lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 32, 40]))), lambda: "".join(r.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(r.randint(12, 40)))])(),
        "email": lambda: f"{word()}.{word()} [at] {word()} [dot] com",
    }
    bad = {
        "phone": lambda: r.choice([f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1900, 2099)} {digits(2)}", digits(r.randint(8, 15)), f"{digits(4)}/{digits(4)}", f"{digits(1)}.{digits(8)}"]),
        "card": lambda: r.choice([card(16, False), digits(13), f"{digits(3)} {digits(5)} {digits(5)}"]),
        "id": lambda: r.choice([digits(r.randint(9, 12)), f"{digits(4)}-{digits(6)}", f"{digits(3)}.{digits(6)}", f"{digits(3)} {digits(3)} {digits(3)}"]),
        "secret": lambda: r.choice([word() + word() + word() + word() + "ationing", "https-" + word() + "-" + word(), digits(8)]),
        "email": lambda: f"{word()} (at) {word()}.{word()}",
    }
    cue = {"phone": ["call", "phone", "tel:"], "card": ["card", "visa", "payment"], "id": ["ssn", "passport", "tax id"], "secret": ["password", "token", "api_key", "secret"], "email": ["contact", "mail", "write to"]}
    rows, labels, kinds = [], [], []
    while len(rows) < n:
        kind, yes = r.choice(list(good)), r.random() < 0.5
        span = (good if yes else bad)[kind]()
        before = " ".join(word() for _ in range(r.randint(0, 5))) + " "
        if kind == "secret":
            before += (r.choice(cue[kind]) if yes else r.choice(["color", "note", "see", word()])) + r.choice([" = ", "=", ": ", ' = "'])
        elif r.random() < (0.6 if yes else 0.03):
            before += r.choice(cue[kind]) + " "
        elif not yes and r.random() < 0.5:
            before += r.choice(["order", "invoice", "page", "ref", "total", "$", "version"]) + " "
        start, end, after = 0, len(span), r.choice([" ", ", ", ". ", " " + word(), "\n"])
        if kind in ("phone", "card", "id") and r.random() < 0.4:
            near = lambda: r.choice([good[kind], good[kind], good["phone"], good["card"], good["id"], bad["phone"]])() + " "
            if yes:
                left, right = r.choice([("", near()), (near(), ""), (near(), near())])
                span, start, end = left + span + " " + right, len(left), len(left) + end
            else:  # a part of a longer run
                parts = r.choice([[good[kind]()], [span], [good[kind](), good[kind]()], [near()[:-1], near()[:-1]], [near()[:-1], good[kind](), near()[:-1]]])
                span, whole, at = " ".join(parts), set(), 0
                for part in parts:
                    whole.add((at, at + len(part)))
                    at += len(part) + 1
                wrong = [(a, b) for k, a, b in candidates(span) if k == kind and (a, b) not in whole]
                if not wrong:
                    continue
                start, end = r.choice(wrong)
        text = before + span + after
        rows.append(features(text, kind, len(before) + start, len(before) + end))
        labels.append(float(yes))
        kinds.append(kind)
    return np.array(rows), np.array(labels), kinds


def trained(n: int = TRAINING_SPANS, precision: float = MIN_PRECISION, seed: int = 7) -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the least calibrated probability whose held-out precision reaches `precision`."""
    x, y, _ = synthetic(n // 2, seed)
    cx, cy, kinds = synthetic(n // 2, seed + 1)
    model = Boosted().fit(x, y).calibrate(cx, cy)
    p, thresholds = model.probability(cx), {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(cy[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model, thresholds


def merged(spans: list[tuple[str, int, int]]) -> list[int]:
    """Starts and ends, in turn and ascending, of what the spans cover."""
    out: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def is_free(covered: list[int], start: int, end: int) -> bool:
    """Whether a span overlaps none of what is covered."""
    at = bisect_right(covered, start)
    return at % 2 == 0 and (at == len(covered) or end <= covered[at])


def all_spans(texts: list[str], model: Boosted, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """For each text its base spans, and those with the added ones, both in the order of kinds and starts."""
    base = [base_spans(t) for t in texts]
    extra: list[list] = [[] for _ in texts]
    covered = [merged(b) for b in base]
    ahead = ((k, c) for k, t in enumerate(texts) for c in proposals(t) if is_free(covered[k], c[1], c[2]))
    good: list[tuple] = []
    while block := list(islice(ahead, SCORED)):
        p = model.probability(np.array([features(texts[k], *c) for k, c in block]))
        good += [(-x, k, c) for x, (k, c) in zip(p.tolist(), block) if x >= thresholds[c[0]]]
    taken: list[list] = [[] for _ in texts]  # starts and ends of the added spans, ascending
    for _, k, (kind, a, b) in sorted(good, key=lambda g: g[0]):
        if is_free(taken[k], a, b):
            at = bisect_right(taken[k], a)
            taken[k][at:at] = [a, b]
            extra[k].append((kind, a, b))
    in_order = lambda s: sorted(s, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return [(in_order(b), in_order(b + e)) for b, e in zip(base, extra)]


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_personal_data(docs: DataFrame, training_spans: int = TRAINING_SPANS, precision: float = MIN_PRECISION, redact: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) and, with `redact`, redacted."""
    model, thresholds = trained(training_spans, precision)

    def work(_, texts):
        plain = [(t or b"").decode("utf-8", "replace") for t in texts]
        got = all_spans(plain, model, thresholds)
        made = {f"n_{kind}": [sum(s[0] == kind for s in b) for b, _ in got] for kind in KINDS[:4]}
        made["base_sha256"] = [hashlib.sha256(shown(b).encode()).hexdigest() for b, _ in got]
        made["spans"] = [shown(s) for _, s in got]
        if redact:
            made["redacted"] = [redacted(t, s) for t, (_, s) in zip(plain, got)]
        return made

    return per_document(docs, "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string" + ",redacted string" * redact, work)
