"""Language identification in two steps: family first, then one-versus-one linear SVMs within the family.

A text is described by the relative frequencies of hashed byte bigrams and trigrams of its ASCII-lower-cased UTF-8
bytes, scaled by one over the root of each bucket's mean.  Families are told apart by one-versus-rest linear SVMs,
languages of one family by one-versus-one linear SVMs that vote.  Both are linear in the frequencies, so a text is
scored by adding up one weight for each n-gram and classifier, in one pass over the whole text.

Training takes a bounded sample (``sample`` rows, those of least hash of doc_id among labelled training rows, at most
that many in every language together); everything else covers all rows.

Defined cases: null text and texts without a letter give ``und`` with score 0; null lang rows are never learned from;
with one learned language every text with a letter gets it, score 1; with none at all, every text gets ``und``; tied
votes go to the larger summed margin, then to the first language by name; repeated rows give repeated results; an empty
table gives an empty result; only the id, text and (for training) lang columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import held_out, tidy

BUCKETS = 4096
SAMPLE = 2400
UNKNOWN = "und"
#: Bytes whose n-grams are held at once.
SLICE = 1 << 20

# ISO 639-1 codes by language family; a code that is not listed forms a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb yi af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, np.int8)
_LETTER[65:91] = _LETTER[97:123] = 1


def ngram_buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams, then of the bigrams, that start at each byte but the last two."""
    b = _LOWER[data]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    return np.stack([three >> shift, two[:-1] >> shift])


def frequencies(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.float32)
    at = ngram_buckets(data).ravel()
    return (np.bincount(at, minlength=BUCKETS) / len(at)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) that minimise squared hinge loss plus ridge, by Nesterov's method; y is -1 or 1.

    Rows are weighted so that both classes count alike.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    forward = lambda w: x @ w[:-1] + w[-1]
    backward = lambda r: np.append(x.T @ r, r.sum())
    v = np.random.default_rng(0).normal(size=x.shape[1] + 1).astype(x.dtype)
    for _ in range(12):  # largest curvature, by power iteration
        v /= np.linalg.norm(v)
        v = backward(weight * forward(v))
    rate = 1 / (2 * np.linalg.norm(v) * 1.05 + ridge)
    w = np.zeros(x.shape[1] + 1, x.dtype)
    last = w
    for k in range(steps):
        z = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * forward(z))
        grad = -2 * backward((weight * y * slack).astype(x.dtype)) + ridge * np.append(z[:-1], 0)
        last, w = w, (z - rate * grad).astype(x.dtype)
    return w


@dataclass
class Model:
    """Languages, families, and one column of weights for each classifier; the last row of weights is the bias."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (BUCKETS + 1, families + pairs)

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str]) -> Model:
        langs = sorted(set(y))
        families = sorted({family_of(a) for a in langs})
        if not langs:
            return cls([], [], [], np.zeros((BUCKETS + 1, 0)))
        scale = 1 / np.sqrt(np.maximum(x.mean(axis=0), 1 / BUCKETS / 50))
        x *= scale.astype(x.dtype)  # in place: the caller's rows are not needed again
        names = np.array(y)
        kin = np.array([family_of(a) for a in y])
        columns = [linear_svm(x, np.where(kin == f, 1, -1)) for f in families] if len(families) > 1 else [np.zeros(BUCKETS + 1)]
        pairs = [(i, j) for i, j in combinations(range(len(langs)), 2) if family_of(langs[i]) == family_of(langs[j])]
        for i, j in pairs:
            own = (names == langs[i]) | (names == langs[j])
            columns.append(linear_svm(x[own], np.where(names[own] == langs[i], 1, -1)))
        weights = np.stack(columns, axis=1).astype(np.float64)
        weights[:-1] *= scale[:, None]
        return cls(langs, families, pairs, weights)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margins of every classifier for every text; data holds the bytes of all texts, offsets where each begins."""
        lo = offsets[:-1]
        hi = np.maximum(lo, offsets[1:] - 2)
        out = np.zeros((len(lo), self.weights.shape[1]))
        for at in range(0, max(0, len(data) - 2), SLICE):
            two, one = ngram_buckets(data[at : at + SLICE + 2])
            end = at + len(two)
            rows = slice(np.searchsorted(hi, at, "right"), np.searchsorted(lo, end, "left"))
            a, b = np.clip(lo[rows], at, end) - at, np.clip(hi[rows], at, end) - at
            for k in range(self.weights.shape[1]):
                w = self.weights[:-1, k]
                total = np.concatenate([[0.0], np.cumsum(w[two] + w[one])])
                out[rows, k] += total[b] - total[a]
        return out / np.maximum(1, 2 * (hi - lo))[:, None] + self.weights[-1]

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row."""
        sure = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
        nf = len(self.families)
        family = margins[:, :nf].argmax(axis=1)
        first = sure[np.arange(len(margins)), family] if nf > 1 else np.ones(len(margins))
        lang, score = np.zeros(len(margins), np.int64), first.copy()
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            own = [i for i, a in enumerate(self.langs) if family_of(a) == name]
            votes = np.zeros((len(rows), len(own)))
            least = np.ones((len(rows), len(own)))
            for k, (i, j) in enumerate(self.pairs):
                if i in own:
                    m, p = margins[rows, nf + k], sure[rows, nf + k]
                    a, b = own.index(i), own.index(j)
                    votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
                    votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
                    least[:, a] = np.minimum(least[:, a], p)
                    least[:, b] = np.minimum(least[:, b], 1 - p)
            best = votes.argmax(axis=1)
            lang[rows] = np.array(own)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return lang, score


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """Training rows of least hash, at most ``sample``: ids are compared first, so texts of other rows are not moved."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    mark = F.xxhash64(F.col("id"))
    kept = usable.select(mark.alias("mark")).orderBy("mark").limit(sample)
    edge = kept.agg(F.max("mark")).first()[0]
    return usable.where(mark <= F.lit(edge)) if edge is not None else usable.where(F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 256):
            found = [frequencies(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["id", "lang", "x"])

    kind = narrow.schema["id"].dataType.simpleString()
    rows = sorted(_sampled(narrow, sample).mapInArrow(tidy(describe), f"id {kind}, lang string, x binary").limit(2 * sample).collect(), key=lambda r: (r["id"], r["lang"], bytes(r["x"])))
    langs = [r["lang"] for r in rows]
    x = np.empty((len(rows), BUCKETS), np.float32)
    for k in range(len(rows)):
        x[k], rows[k] = np.frombuffer(rows[k]["x"], np.float32), None
    return Model.fit(x, langs)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what is made for a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _told(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    texts = pa.array(["" if t is None else t for t in texts.to_pylist()], pa.string()) if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # Most texts show a letter at once; the others are read as text.
    known = np.array([bool(_LETTER[data[a : min(a + 64, b)]].any()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], bool)
    for i in np.flatnonzero(~known):
        known[i] = any(c.isalpha() for c in texts[i].as_py())
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    lang, score = model.predict(model.margins(data, offsets))
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(lang.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score of every row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            if batch.num_rows:
                names, score = _told(shared.value, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told, all columns as they are: one pass without a shuffle."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            if batch.num_rows:
                names, _ = _told(shared.value, batch.column(at))
                yield batch.filter(pa.array([x != UNKNOWN for x in names]))

    return docs.mapInArrow(tidy(run), docs.schema)
