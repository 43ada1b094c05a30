"""Toxicity by a linear-chain conditional random field over words.

Words are runs of word characters.  A word's features are hashed: itself, its prefixes of 3 to 6 characters and its
suffix of 3, lower-cased; the chain has two states, plain and toxic.  Token labels for training come from the document
labels: in a document marked toxic, the words that carry a feature which is significantly tied to the label are toxic,
all others are plain.  Emissions and transitions are trained
together by the chain's likelihood.  Forward-backward marginals give each word's chance of being toxic; a document's score is a
logistic function of the largest marginal, of the expected number of toxic words and of that number's share of all
words, fitted on the same sample; words of marginal 0.5 or more are reported with their offsets.

Training takes a bounded sample: at most ``SAMPLE`` documents of each label (three times as many plain ones), those of
least hash of doc_id, and at most ``SAMPLE_CHARS`` characters in all; everything else covers all rows and whole texts.

Defined cases: null and empty texts have no words and get the score of a text without toxic words; null labels are not
learned from; without toxic or without plain training rows every score is that label's share (0 without rows); repeated
rows give repeated results; an empty table gives an empty result; only the id, text and label columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import held_out, tidy

BUCKETS = 1 << 18
SAMPLE = 1000
SAMPLE_CHARS = 16_000_000
CACHE_WORDS = 400_000
SEGMENT = 256

_WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"={w}", *(f"<{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), *([f">{w[-3:]}"] if len(w) > 3 else [])]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


#: Sequences up to which scalar steps are quicker than steps through arrays.
FEW = 4


def chains(odds: np.ndarray, offsets: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds of the toxic state at each place, its emission included, and backward odds, its emission excluded.

    ``odds``: toxic to plain emission odds; sequence i takes offsets[i] to offsets[i + 1]; trans[a, b]: factor of going
    from a to b, 1 being toxic.  Both passes keep one number for each sequence and step through all sequences at once,
    longest first, so finished ones drop off the end; what the ``FEW`` longest have beyond the others is done one by one.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    start, lengths = offsets[:-1][order], lengths[order]
    alone = min(FEW, len(lengths))
    common = int(lengths[alone]) if len(lengths) > alone else 0  # steps that are made through arrays
    alive = np.searchsorted(-lengths, -np.arange(common + 1), side="left")  # sequences longer than t
    (pp, pt), (tp, tt) = trans.tolist()
    forward, backward = np.empty_like(odds), np.empty_like(odds)
    state = np.empty(0)
    for t in range(common):
        k = alive[t]
        at = start[:k] + t
        state = odds[at] if t == 0 else odds[at] * (state[:k] * tt + pt) / (state[:k] * tp + pp)
        forward[at] = state
    tails = np.ones(len(order))
    for i in range(alone):
        lo, hi = int(start[i]) + common, int(start[i] + lengths[i])
        if lo >= hi:
            continue
        own, out = odds[lo:hi].tolist(), []
        x = float(state[i]) if common else None
        for o in own:
            x = o if x is None else o * (x * tt + pt) / (x * tp + pp)
            out.append(x)
        forward[lo:hi] = out
        x, out = 1.0, [1.0]
        for o in reversed(own[1:]):
            x = (tt * x * o + tp) / (pt * x * o + pp)
            out.append(x)
        backward[lo:hi] = out[::-1]
        tails[i] = (tt * x * own[0] + tp) / (pt * x * own[0] + pp)
    state = tails
    for t in range(common - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        m = alive[t + 1] if t + 1 < common else 0  # those whose next place was passed here
        if m:
            after = state[:m] * odds[at[:m] + 1]
            state[:m] = (tt * after + tp) / (pt * after + pp)
        backward[at] = state[:k]
    return forward, backward


def marginals(odds: np.ndarray, offsets: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Chance of the toxic state at each place of each sequence."""
    forward, backward = chains(odds, offsets, trans)
    forward *= backward
    return forward / (1 + forward)


def expected_steps(odds: np.ndarray, forward: np.ndarray, backward: np.ndarray, pair: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected numbers of steps from state to state; ``pair`` marks the places whose next one is of the same sequence."""
    before, after = forward[:-1][pair], (odds * backward)[1:][pair]
    weight = [np.full(len(before), trans[0, 0]), trans[0, 1] * after, trans[1, 0] * before, trans[1, 1] * before * after]
    total = weight[0] + weight[1] + weight[2] + weight[3]
    return np.array([(w / total).sum() for w in weight]).reshape(2, 2)


@dataclass
class Model:
    weights: np.ndarray  # of the feature buckets: log odds of toxic to plain
    bias: float
    trans: np.ndarray
    readout: np.ndarray  # of the document score; the last is the constant
    constant: float | None = None

    def emission(self, word: str) -> float:
        return float(np.clip(self.bias + sum(self.weights[_bucket(f)] for f in features(word)), -30, 30))

    def score(self, p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(summary(p, offsets) @ self.readout, -30, 30)))


def summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Columns: largest marginal, log of one plus the sum of those that count, root of that sum per word, 1."""
    n = np.diff(offsets)
    # Chances below a tenth do not add up, else a very long text would be toxic for its length alone.
    total = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.1, p, 0.0))])
    sums = np.maximum(0, total[offsets[1:]] - total[offsets[:-1]])
    peak = np.zeros(len(n))
    if len(p):
        full = n > 0
        peak[full] = np.maximum.reduceat(p, offsets[:-1][full])
    return np.stack([peak, np.log1p(sums), np.sqrt(sums / np.maximum(1, n)), np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * w)
    return w


def tied_features(words: list[np.ndarray], own: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Features whose document counts go with the label: at least 4 standard deviations and five times the share.

    ``words``: numbers of each document's words; ``own``: features of each numbered word.
    """
    hit: Counter[str] = Counter()
    every: Counter[str] = Counter()
    for doc, t in zip(words, toxic, strict=True):
        found = {f for w in np.unique(doc).tolist() for f in own[w]}
        every.update(found)
        if t:
            hit.update(found)
    share = toxic.mean()
    n1, n0 = toxic.sum(), (~toxic).sum()
    tied = set()
    for f, a in hit.items():
        n = every[f]
        if a >= 4 and a - n * share >= 4 * np.sqrt(n * share * (1 - share)) and (a + 0.5) / (n1 + 1) >= 5 * (n - a + 0.5) / (n0 + 1):
            tied.add(f)
    return tied


def fit(texts: list[str], toxic: np.ndarray, prior: float, steps: int = 50, ridge: float = 1e-4) -> Model:
    """CRF and readout from texts and their labels; ``prior``: share of toxic texts among all training rows."""
    trans = np.ones((2, 2))
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, trans, np.zeros(4), float(prior))
    number: dict[str, int] = {}
    words = [np.fromiter((number.setdefault(m[0], len(number)) for m in _WORDS.finditer(t)), np.int32) for t in texts]
    flat = np.concatenate(words)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in words])])
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    own = [features(w) for w in number]
    tied = tied_features(words, own, toxic)
    bad = np.array([any(f in tied for f in fs) for fs in own], bool)
    label = bad[flat] & toxic[owner] if len(flat) else np.zeros(0, bool)
    lookup = np.array([b for fs in own for b in map(_bucket, fs)], np.int64)
    row = np.repeat(np.arange(len(own)), [len(fs) for fs in own])
    # Long documents are trained on in segments; each keeps its neighbours but for the cut.
    cuts = np.unique(np.concatenate([offsets, *(np.arange(a, b, SEGMENT) for a, b in zip(offsets[:-1], offsets[1:], strict=True))])).astype(np.int64)
    pair = np.ones(max(0, len(flat) - 1), bool)
    pair[cuts[(cuts > 0) & (cuts < len(flat))] - 1] = False
    seen = np.zeros((2, 2))
    if len(flat) > 1:
        np.add.at(seen, (label[:-1][pair].astype(int), label[1:][pair].astype(int)), 1)
    # Emissions and transitions are trained together, from the smoothed rates of the labelled chain on.
    rate = (seen + 1) / (seen + 1).sum()
    steps_log = np.log(np.clip(rate / np.outer(rate.sum(axis=1), rate.sum(axis=0)), 0.05, 20))
    weights, bias = np.zeros(BUCKETS), float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))) if len(label) else 0.0
    observed = np.bincount(flat, label, len(own))
    used = np.unique(lookup)
    slope, size = np.zeros(len(used) + 5), np.zeros(len(used) + 5)
    pace = np.concatenate([np.full(len(used), 0.3), np.full(5, 0.1)])
    for k in range(1, steps + 1):
        emit = np.clip(bias + np.bincount(row, weights[lookup], len(own)), -30, 30)
        odds, trans = np.exp(emit)[flat], np.exp(steps_log)
        forward, backward = chains(odds, cuts, trans)
        moved = seen - expected_steps(odds, forward, backward, pair, trans) if len(flat) > 1 else np.zeros((2, 2))
        forward *= backward
        gap = observed - np.bincount(flat, forward / (1 + forward), len(own))
        g = np.concatenate([np.bincount(lookup, gap[row], BUCKETS)[used], [gap.sum()], moved.ravel()]) / len(texts)
        g[: len(used)] -= ridge * weights[used]
        g[len(used) + 1 :] -= ridge * steps_log.ravel()
        slope, size = 0.8 * slope + 0.2 * g, 0.98 * size + 0.02 * g * g
        by = pace * (slope / (1 - 0.8**k)) / (np.sqrt(size / (1 - 0.98**k)) + 1e-5)
        weights[used] += by[: len(used)]
        bias += by[len(used)]
        steps_log = np.clip(steps_log + by[len(used) + 1 :].reshape(2, 2), -5, 5)
    trans = np.exp(steps_log)
    emit = np.clip(bias + np.bincount(row, weights[lookup], len(own)), -30, 30)
    p = marginals(np.exp(emit)[flat], offsets, trans)
    share = toxic.mean()
    weight = np.where(toxic, prior / share, (1 - prior) / (1 - share))
    return Model(weights.astype(np.float32), bias, trans, _logistic(summary(p, offsets), toxic.astype(float), weight))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("lid")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sizes = texts.select("id", F.length("text").alias("chars")).join(marked, F.col("id") == F.col("lid")).select("id", "chars", "toxic")
    totals = {r["toxic"]: r["n"] for r in sizes.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return fit([], np.zeros(0, bool), 0.0)
    prior = totals.get(1, 0) / sum(totals.values())
    chosen: dict = {}
    for kind, most in ((1, sample), (0, 3 * sample)):
        left = chars // 4 if kind else chars - chars // 4
        for r in sizes.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(most).collect():
            if r["chars"] <= left:
                left -= r["chars"]
                chosen[r["id"]] = kind
    rows = texts.where(F.col("id").isin(list(chosen))).groupBy("id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["id"])
    return fit([r["text"] for r in rows], np.array([chosen[r["id"]] == 1 for r in rows], bool), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, n_words, n_toxic_words and toxic_spans (start:end in characters, joined by commas)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        class Emissions(dict):
            def __missing__(self, word: str) -> float:
                self[word] = x = float(np.exp(model.emission(word)))
                return x

        odds = Emissions()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if len(odds) > CACHE_WORDS:
                odds.clear()
            parts, lengths = [], []
            for t in texts:
                found = _WORDS.findall(t) if t else ()
                lengths.append(len(found))
                parts.append(np.fromiter(map(odds.__getitem__, found), np.float64, len(found)))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            p = marginals(np.concatenate(parts) if parts else np.zeros(0), offsets, model.trans)
            scores = model.score(p, offsets)
            hot = np.flatnonzero(p >= 0.5)
            owner = np.searchsorted(offsets, hot, side="right") - 1
            spans = [""] * len(texts)
            counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0)
            for i in np.unique(owner).tolist():
                marked = set((hot[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")] - offsets[i]).tolist())
                spans[i] = ",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(_WORDS.finditer(texts[i])) if k in marked)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(lengths, pa.int64()), pa.array(counts.astype(np.int64), pa.int64()), pa.array(spans, pa.string())],
                names=["id", "score", "n_words", "n_toxic_words", "toxic_spans"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, score double, n_words bigint, n_toxic_words bigint, toxic_spans string").withColumnRenamed("id", id_col)
