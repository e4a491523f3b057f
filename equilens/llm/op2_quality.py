"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1 in the training folds) and unlabelled web text (any
documents, labels unseen) train a small network by the non-negative unbiased
risk  pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))  with the logistic loss;
whenever the negative part falls below 0 the step goes back up that part. The
class prior pi is estimated from the same two samples: a first classifier
tells positives from unlabelled rows, and pi is the least ratio of unlabelled
to positive rows above any of its score levels (best-bin estimation), on rows
it was not fitted on; where no level tells the two apart, all documents are
good and pi is 1. Finally the output is shifted so that the prior's share of
all documents scores 0.5 or more, which for a prior of 1 is each of them.

Documented bounds of the networks' steps: at most ``MOST_POSITIVES`` positives
and ``MOST_UNLABELLED`` unlabelled rows, taken by hash of the id over the whole
tables. The prior (but for the rows its classifier was fitted on) and the cut
come from the scores of all documents: two passes over the texts, each ending
in one histogram. Scoring reads every whole text, row by row, in the scan's own tasks:
nothing is shuffled and memory is one Arrow batch.

Features see the text only: shares of character classes and of class pairs
and triples, word and line lengths, and how often words and lines repeat.

Defined cases: null and empty texts have all-zero shares and are scored like
any text; without labelled positives every score is 0.5; repeated rows are
each scored; null labels are no labels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, isolate, restore

FOLDS, HELD_OUT = 3, 1
MOST_POSITIVES, MOST_UNLABELLED = 6_000, 12_000
HIDDEN, STEPS, PRIOR_STEPS, BATCH, RATE, DECAY = 24, 600, 150, 512, 2e-3, 1e-3
MARGIN = 4.0
#: Standard errors by which a level must tell positives from unlabelled rows, else all are taken for good.
APART = 2.5
#: Bins of a histogram of logits.
BINS = 1 << 16

#: Character classes: each of these is a class of its own, then come groups.
_SINGLE = b" \n*$%&#|!?.,;:<>{}[]()=/\\_-+@\"'~^`"
_N = len(_SINGLE) + 6
_CLASS = np.zeros(256, np.int64)
for _i, _b in enumerate(_SINGLE):
    _CLASS[_b] = _i
for _b in range(256):
    if _b not in _SINGLE:
        _CLASS[_b] = len(_SINGLE) + (0 if 0x61 <= _b <= 0x7A else 1 if 0x41 <= _b <= 0x5A else 2 if 0x30 <= _b <= 0x39
                                     else 3 if _b >= 0xC0 else 4 if _b >= 0x80 else 5)
_GROUPS = 6   # letters low, letters high, digits, non-ASCII, white space, other
_GROUP = np.zeros(256, np.int64)
for _b in range(256):
    _GROUP[_b] = (0 if 0x61 <= _b <= 0x7A else 1 if 0x41 <= _b <= 0x5A else 2 if 0x30 <= _b <= 0x39 else 3 if _b >= 0x80
                  else 4 if _b in b" \t\n\x0b\x0c\r" else 5)
DIMS = _N + _GROUPS ** 3 + 12


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIMS, np.float32)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    out[:_N] = np.sqrt(np.bincount(_CLASS[data], minlength=_N) / n)
    g = _GROUP[data]
    if n > 2:
        triple = (g[:-2] * _GROUPS + g[1:-1]) * _GROUPS + g[2:]
        out[_N:_N + _GROUPS ** 3] = np.sqrt(np.bincount(triple, minlength=_GROUPS ** 3) / (n - 2))
    words, lines = raw.split(), raw.split(b"\n")
    kinds, n_words = len(set(words)), max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[-12:] = (math.log1p(n) / 10, kinds / n_words, pairs / max(n_words - 1, 1), lengths.mean() / 10, lengths.std() / 10,
                 min(lengths.max(), 100) / 100, len(set(lines)) / len(lines), math.log1p(len(lines)) / 10,
                 math.log1p(n / len(lines)) / 10, sum(w[:1].isupper() for w in words) / n_words,
                 sum(w[-1:] in (b".", b"!", b"?") for w in words) / n_words, kinds / math.sqrt(n_words) / 30)
    return out


class Net:
    """One hidden layer; trained by Adam on any gradient of the loss by the output."""

    def __init__(self, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / math.sqrt(dims), (dims, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x, self.h = x, np.tanh(x @ self.p[0] + self.p[1])
        return self.h @ self.p[2] + self.p[3][0]

    def step(self, g: np.ndarray) -> None:
        back = np.outer(g, self.p[2]) * (1 - self.h ** 2)
        grads = [self.x.T @ back + DECAY * self.p[0], back.sum(0), self.h.T @ g + DECAY * self.p[2], np.array([g.sum()])]
        self.t += 1
        for i, gr in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * gr
            self.v[i] = 0.999 * self.v[i] + 0.001 * gr * gr
            self.p[i] -= RATE * (self.m[i] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[i] / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _batches(n_p: int, n_u: int, rng, most: int):
    """``most`` mini-batches of both samples, in ever new orders."""
    parts, done = max(1, -(-(n_p + n_u) // BATCH)), 0
    while done < most:
        p, u = rng.permutation(n_p), rng.permutation(n_u)
        for k in range(min(parts, most - done)):
            yield (p[k::parts] if n_p >= parts else p), (u[k::parts] if n_u >= parts else u)
        done += parts


def reach(w: list[np.ndarray]) -> float:
    """No logit is larger than this: hidden units are at most 1."""
    return float(np.abs(w[2]).sum() + np.abs(w[3][0])) + 1e-3


def bins(z: np.ndarray, most: float) -> np.ndarray:
    return np.clip(((z + most) * (BINS / (2 * most))).astype(np.int64), 0, BINS - 1)


def at_or_above(counts: np.ndarray) -> np.ndarray:
    """Share of the rows from each bin on."""
    return counts[::-1].cumsum()[::-1] / max(counts.sum(), 1)


def separate(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> tuple[Net, np.ndarray, np.ndarray]:
    """A network that tells positives from unlabelled rows, the positives it wasn't fitted on and the unlabelled rows it was."""
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(len(pos)), rng.permutation(len(unl))
    net, hp, hu = Net(pos.shape[1], seed), len(pos) // 2, len(unl) // 2
    for a, b in _batches(hp, hu, rng, PRIOR_STEPS):
        x = np.concatenate([pos[p[a]], unl[u[b]]])
        y = np.concatenate([np.ones(len(a)), np.zeros(len(b))])
        w = np.where(y == 1, 0.5 / len(a), 0.5 / len(b))
        net.step(w * (sigmoid(net.forward(x)) - y))
    return net, p[hp:], u[:hu]


def best_bin(hp: np.ndarray, hu: np.ndarray) -> float:
    """The least ratio of the unlabelled to the positive rows above a level, with a margin for the size
    of the tails, from histograms of both; 1 where no level tells the two apart."""
    n_p, n_u = hp.sum(), max(hu.sum(), 1)
    tail_p, tail_u = at_or_above(hp), at_or_above(hu)
    levels = np.unique(np.minimum(np.searchsorted(1 - (tail_p + tail_u) / 2, np.linspace(0, 0.98, 99)), BINS - 1))
    tail_p, tail_u = tail_p[levels], tail_u[levels]
    both = (tail_p * n_p + tail_u * n_u) / (n_p + n_u)
    if not (tail_p - tail_u > APART * np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))).any():
        return 1.0
    # a wide margin: small samples must not take a chance dip of a thin tail for the prior
    margin = MARGIN * (math.sqrt(math.log(20) / (2 * n_p)) + math.sqrt(math.log(20) / (2 * n_u)))
    with np.errstate(divide="ignore", invalid="ignore"):
        best = int(np.nanargmin(np.where(tail_p > 0, (tail_u + margin) / tail_p, np.inf)))
    return float(np.clip(tail_u[best] / tail_p[best], 0.02, 1))


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 5, counted=None) -> float:
    """Best-bin estimate: fit positives against unlabelled rows on half of each, compare the tails of the
    positives' other half and of the unlabelled rows: all that ``counted`` (network, rows of ``unl`` to
    leave out) counts, or the other half of ``unl``."""
    net, p, fitted = separate(pos, unl, seed)
    most = reach(net.p)
    hu = counted(net, fitted) if counted else np.bincount(bins(net.forward(np.delete(unl, fitted, 0)), most), minlength=BINS)
    return best_bin(np.bincount(bins(net.forward(pos[p]), most), minlength=BINS), hu)


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = 3, counted=None) -> dict:
    """Non-negative PU risk minimisation; returns what ``score`` needs. ``counted`` (model, rows of ``unl`` to
    leave out) gives the histogram of all documents' logits; without it ``unl`` stands for them."""
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    pos, unl = np.clip((pos - mean) / scale, -6, 6).astype(np.float64), np.clip((unl - mean) / scale, -6, 6).astype(np.float64)

    def model_of(net: Net) -> dict:
        return {"mean": mean, "scale": scale, "w": [x.astype(np.float32) for x in net.p]}

    prior = class_prior(pos, unl, counted=counted and (lambda net, rows: counted(model_of(net), rows)))
    net, rng = Net(pos.shape[1], seed), np.random.default_rng(seed)
    for a, b in _batches(len(pos), len(unl), rng, STEPS):
        out = net.forward(np.concatenate([pos[a], unl[b]]))
        s = sigmoid(out)
        fp, fu = out[:len(a)], out[len(a):]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients: of the positive part, and of the negative part of the risk
        plus = np.concatenate([prior * (s[:len(a)] - 1) / len(a), np.zeros(len(b))])
        minus = np.concatenate([-prior * s[:len(a)] / len(a), s[len(a):] / len(b)])
        net.step(plus + minus if negative >= 0 else -minus)
    # 0.5 is put where the estimated share of the documents lies above it: the last bin's edge that leaves so many,
    # and a little less, so that rounding takes none of that bin
    most = reach(net.p)
    above = at_or_above(counted(model_of(net), []) if counted else np.bincount(bins(net.forward(unl), most), minlength=BINS))
    cut = int(np.flatnonzero(above >= prior - 1e-12).max(initial=0))
    net.p[3] = net.p[3] - ((cut - 0.1) * 2 * most / BINS - most)
    return {**model_of(net), "prior": prior}


def logit(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    w = model["w"]
    return (np.tanh(z @ w[0] + w[1]) @ w[2] + w[3][0]).astype(np.float64)


def score(x: np.ndarray, model: dict | None) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else sigmoid(logit(x, model))


def histogram(texts: DataFrame, model: dict) -> np.ndarray:
    """How many rows of ``texts`` (text) have their logit in each of ``BINS`` bins: one aggregate, of at most ``BINS`` rows."""
    most = reach(model["w"])

    @F.pandas_udf("int")
    def bin_of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="int32")
        return pd.Series(bins(logit(np.stack([features(t) for t in texts]), model), most).astype(np.int32))

    out = np.zeros(BINS, np.int64)
    for bin_, n in texts.select(bin_of("text").alias("bin")).groupBy("bin").agg(F.count(F.lit(1))).collect():
        out[bin_] = n
    return out


def _sample_features(docs: DataFrame, ids: DataFrame, most: int) -> tuple[list[int], np.ndarray]:
    """Ids and feature rows of at most ``most`` documents, the first by hash of their id; ids hold (doc)."""
    picked = ids.select("doc").distinct().orderBy(F.xxhash64(F.lit(11), "doc"), "doc").limit(most)

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    # at most `most` ids are broadcast; ids that repeat in the table are taken once
    rows = (docs.join(F.broadcast(picked), "doc").select("doc", vector("text").alias("x"))
            .groupBy("doc").agg(F.min("x").alias("x")).collect())
    rows.sort(key=lambda r: r["doc"])
    return [r["doc"] for r in rows], np.array([r["x"] for r in rows], np.float32).reshape(len(rows), DIMS)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED) -> dict | None:
    """Fit on the training folds; None without any trusted positive."""
    base, at = isolate(docs)
    lab, l = isolate(labels)
    every = base.select(F.col(at[id_col]).cast("long").alias("doc"), F.col(at[text_col]).alias("text"))
    slim = every.where(F.col("doc").isNotNull())
    trusted = (lab.where((F.col(l[label_col]) == 1) & (fold(l[id_col], FOLDS) != HELD_OUT))
               .select(F.col(l[id_col]).cast("long").alias("doc")))
    _, pos = _sample_features(slim, trusted, most_positives)
    ids, unl = _sample_features(slim, slim, most_unlabelled)

    def counted(model: dict, rows) -> np.ndarray:
        if not len(rows):
            return histogram(every, model)
        # at most half of ``most_unlabelled`` ids are broadcast; the rows that a network was fitted on would mislead the estimate
        fitted = docs.sparkSession.createDataFrame([(ids[k],) for k in rows], "doc long")
        return histogram(every.join(F.broadcast(fitted), "doc", "left_anti"), model)

    return fit(pos, unl, counted=counted) if len(pos) > 1 and len(unl) > 1 else None


def score_column(model: dict | None, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(score(np.stack([features(t) for t in texts]), model))

    return run(text)


def keep_good(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored under 0.5; columns as they were."""
    base, at = isolate(docs)
    return restore(base.where(score_column(model, F.col(at[text_col])) >= 0.5), docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
                       score_column(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
