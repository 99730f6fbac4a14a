"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by the non-negative unbiased risk of logistic loss: with the
class prior p, the negatives' risk is that of the unlabelled rows less p times that of the positives taken as negatives; where
a batch makes it negative, the step goes the other way. The prior is estimated beforehand from the same two samples: the
largest share of positives that the unlabelled scores leave room for, over all score bins that hold enough positives.

Features are figures of the whole text and do not depend on language. Training samples are bounded (MAX_ROWS each), drawn by
hash; every document is scored whole.

Defined cases: null and empty texts have all figures zero and are scored; rows without a label are unlabelled only; without
positives or unlabelled rows each score is 0.5; repeated rows and null ids are rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, map_batches, text_hash, utf8

MAX_ROWS, HIDDEN, EPOCHS, BATCH, RATE, SEED = 20_000, 16, 60, 512, 0.02, 7
THRESHOLD = 0.3

_SYMBOLS = b"#*$%&|<>=~^_\\{}[]@+/"
_PUNCTUATION = b".,;:!?'\"()-"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_LEADS = (b"-", b"*", b"|", b"#", b">")
FEATURES = ("words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_lines", "line_words", "end_marks", "bullets",
            "symbols", "punctuation", "exclamation", "upper", "digits", "bars", "ellipsis", "upper_words", "high_bytes", "repeated_pairs")


def features(text: bytes | None) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    size, words = len(text), text.split()
    n = max(len(words), 1)
    count = lambda kinds: size - len(text.translate(None, kinds))
    counts = Counter(words)
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    m = max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = Counter(zip(words, words[1:]))
    upper = count(_UPPER)
    return [
        np.log1p(len(words)), np.log1p(lengths.mean() if len(words) else 0), float((lengths > 14).sum()) / n, float((lengths < 4).sum()) / n,
        len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / m, np.log1p(len(words) / m),
        sum(x.endswith((b".", b"!", b"?", b'"')) for x in lines) / m, sum(x.startswith(_LEADS) for x in lines) / m,
        count(_SYMBOLS) / n, count(_PUNCTUATION) / n, count(b"!") / n, upper / size, count(_DIGITS) / size, text.count(b"|") / n,
        text.count(b"...") / n, sum(w.isupper() for w in counts) / max(len(counts), 1), (size - upper - count(_LOWER) - count(_DIGITS)) / size,
        sum(v for v in pairs.values() if v > 1) / n,
    ]


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, sample: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = sample.mean(axis=0), sample.std(axis=0) + 1e-6
        d = sample.shape[1]
        self.p = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std).clip(-8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.p
        return np.tanh(self.standard(x) @ w + b) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))

    def train(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        """Adam on batches of both samples; each batch's negative risk is kept from falling below zero."""
        rng = np.random.default_rng(seed)
        xp, xu = self.standard(positive), self.standard(unlabelled)
        first, second, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(xu)), max(1, len(xu) // BATCH)):
                a, u = xp[rng.integers(0, len(xp), BATCH)], xu[rows]
                w, b, v, c = self.p
                x = np.concatenate([a, u])
                h = np.tanh(x @ w + b)
                z = h @ v + c[0]
                s = 1 / (1 + np.exp(-z))
                n = len(a)
                negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
                grad_z = np.concatenate([-prior * s[:n] / n, s[n:] / len(u)])
                if negative >= 0:
                    grad_z[:n] += prior * (s[:n] - 1) / n
                else:
                    grad_z = -grad_z
                dh = np.outer(grad_z, v) * (1 - h * h)
                grads = [x.T @ dh + 1e-4 * w, dh.sum(axis=0), h.T @ grad_z + 1e-4 * v, np.array([grad_z.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        return self


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled.

    A network tells the halves of the two samples apart; on the other halves, the tail of the highest scores that holds a
    share q of the positives can hold no less than prior * q of the unlabelled. The smallest ratio of the two tails, with a
    margin for chance, bounds the prior from above and is close to it where some texts are surely positive.
    """
    net = Network(np.concatenate([positive, unlabelled])).train(positive[::2], unlabelled[::2], 0.5, epochs=20)
    p, u = np.sort(net.scores(positive[1::2]))[::-1], np.sort(net.scores(unlabelled[1::2]))[::-1]
    if not len(p) or not len(u):
        return 0.5
    margin = np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    bounds = []
    for q in np.linspace(0.05, 1.0, 96):
        cut = p[min(len(p) - 1, int(q * len(p)))]
        tail_p, tail_u = (p >= cut).mean(), (u >= cut).mean()
        bounds.append(((tail_u + margin) / tail_p, tail_u / tail_p))
    return float(np.clip(min(bounds)[1], 0.05, 0.98))


def _drawn(texts: DataFrame, most: int, total: int) -> np.ndarray:
    """Features of about `most` rows at most, drawn by hash."""
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("pu")), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(total, 1)) * (1 << 30)))

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"f": [features(t) for t in cols["text"]]}

    rows = map_batches(texts.filter(draw).select("text"), run, "f array<double>", heavy="text").collect()
    x = np.array(sorted(r.f for r in rows), np.float64).reshape(-1, len(FEATURES))
    # A fixed order, so that training does not depend on the order of tasks.
    return x[np.random.default_rng(SEED).permutation(len(x))]


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
        label_col: str = "quality", max_rows: int = MAX_ROWS) -> Network | None:
    """Learn from rows for which `trains`, an expression on the documents' own columns, holds."""
    texts = docs.filter(trains).select(column(id_col).alias("doc_id"), utf8(column(text_col)).alias("text"))
    good = labels.filter(column(label_col) == 1).select(column(label_id).alias("doc_id")).distinct()
    # Labels are thinned before the join, so that only the sample's rows meet their texts.
    n_good, n_all = good.count(), texts.count()
    keep = F.pmod(F.xxhash64("doc_id", F.lit("good")), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.25 * max_rows / max(n_good, 1)) * (1 << 30)))
    # At most about 1.25 * max_rows ids.
    positive = _drawn(texts.join(F.broadcast(good.filter(keep)), "doc_id", "left_semi"), max_rows, 0)
    unlabelled = _drawn(texts, max_rows, n_all)
    if not len(positive) or not len(unlabelled):
        return None
    prior = estimate_prior(positive, unlabelled)
    net = Network(np.concatenate([positive, unlabelled])).train(positive, unlabelled, prior)
    net.prior = prior
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each document score and predicted."""
    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), utf8(column(text_col)).alias("text"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        x = np.array([features(t) for t in cols.pop("text")], np.float64).reshape(-1, len(FEATURES))
        scores = net.scores(x) if net is not None else np.full(len(x), 0.5)
        return cols | {"score": scores.tolist(), "predicted": (scores >= threshold).astype(int).tolist()}

    return map_batches(texts, run, f"doc_id {dict(texts.dtypes)['doc_id']}, thash bigint, score double, predicted int", heavy="text")
