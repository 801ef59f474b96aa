"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a sample of all training documents the unlabelled set, which holds toxic
ones too. With the class prior p, the risk of a classifier is p R+(positives) + R-(unlabelled) - p R-(positives); where
the difference of the last two, an estimate of a risk, gets negative, its gradient is turned round (Kiryo et al., 2017).
Three logistic classifiers in numpy, on words, on pieces of words and on both, are averaged.

A document's features are sums over its distinct words, so scoring looks every word up once and remembers it.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

#: Documents to fit on, at most (by a threshold on a hash, so about): positives, and unlabelled ones.
POSITIVES = 6000
UNLABELLED = 12000
FEATURES = 2048
STEPS = 300
REMEMBERED = 1 << 19
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = ("words", "pieces", "both")


def word_features(word: str) -> list[str]:
    """The word itself, and its runs of four and five characters with the ends marked."""
    marked = f"<{word}>"
    return [f"={word}", *{marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}]


def distinct_words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def nnpu(x: "Rows", positive: np.ndarray, prior: float, width: int, steps: int = STEPS, rate: float = 0.1, decay: float = 3e-4) -> np.ndarray:
    """Weights and bias (last) of a logistic classifier under the non-negative PU risk. Weights stay non-negative: the
    features are those that speak for a positive, so a document without any can't get ahead of one with some.

    Adam over all documents at a time, with a rate that falls to zero: on parts of them the corrected risk would get
    negative by chance, over and over."""
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        f = np.clip(x.dot(w), -30, 30)
        s = 1 / (1 + np.exp(-f))
        # logistic losses: l(f, 1) = log(1 + e^-f) has the gradient s - 1, l(f, -1) = log(1 + e^f) has s
        negative = np.mean(np.logaddexp(0, f[u])) - prior * np.mean(np.logaddexp(0, f[p]))
        rest = np.zeros(len(f))
        rest[u], rest[p] = s[u] / len(u), -prior * s[p] / len(p)
        slope = -rest
        if negative >= 0:
            slope = rest
            slope[p] += prior * (s[p] - 1) / len(p)
        g = x.grad(slope)
        g[:width] += decay * w[:width]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * 0.5 * (1 + np.cos(np.pi * t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:width] = np.maximum(w[:width], 0)
    return w


def threshold(f: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """Where to cut the classifier's values: the highest point with the least non-negative PU risk in errors, which is
    prior * (positives missed) + max(0, unlabelled taken - prior * positives taken); halfway to the next value below."""
    cuts = np.unique(f)[::-1]
    p, u = np.sort(f[positive]), np.sort(f[~positive])
    taken_p, taken_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    risk = prior * (1 - taken_p) + np.maximum(0, taken_u - prior * taken_p)
    best = int(np.argmin(risk))
    return float(cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2


class Rows:
    """A sparse matrix: for each document the numbers of its features, repeats counted."""

    def __init__(self, features: list[np.ndarray], width: int):
        self.owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.features, self.n, self.width = np.concatenate(features), len(features), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.features], self.n) + w[-1]

    def grad(self, slope: np.ndarray) -> np.ndarray:
        out = np.bincount(self.features, slope[self.owner], self.width + 1)
        out[-1] = slope.sum()
        return out


def fit(docs: list[tuple[bool, str]], prior: float) -> list[tuple[str, list[float]]]:
    """Weights by feature, one a classifier, from (is it a positive, its distinct words in a string); the empty feature is the bias."""
    positive = np.array([p for p, _ in docs], bool)
    if not positive.any() or positive.all():
        return []
    # what no positive has can't be told from the rest of the unlabelled text
    names: dict[str, int] = {}
    for f in sorted({f for w in {w for p, words in docs if p for w in words.split()} for f in word_features(w)}):
        names[f] = len(names)
    known: dict[str, int] = {}
    coded = [np.fromiter((known.setdefault(w, len(known)) for w in words.split()), np.int32) for _, words in docs]
    of_word, feature = array("i"), array("i")
    for word, i in known.items():
        mine = [names[f] for f in word_features(word) if f in names]
        feature.extend(mine)
        of_word.extend([i] * len(mine))
    of_word, feature = np.frombuffer(of_word, np.int32), np.frombuffer(feature, np.int32)
    n_p, n_u = positive.sum(), (~positive).sum()
    count = lambda mask: np.bincount(np.concatenate([c for c, m in zip(coded, mask) if m]), minlength=len(known))
    p, u = (np.bincount(feature, count(mask)[of_word], len(names)) for mask in (positive, ~positive))
    rate_p, rate_u = p / n_p, (u + 1) / n_u
    z = (rate_p - rate_u) / np.sqrt(rate_u / n_u + rate_p / n_p + 1e-12)
    good = np.flatnonzero((z > 3) & (p >= 3) & (rate_p > 2 * rate_u))
    all_names = list(names)
    out: dict[str, list[float]] = {"": [0.0] * len(_PARTS)}
    for part, kind in enumerate(_PARTS):
        chosen = [i for i in good.tolist() if kind == "both" or all_names[i].startswith("=") == (kind == "words")]
        chosen = sorted(chosen, key=lambda i: (-z[i], all_names[i]))[:FEATURES]
        code = np.full(len(names), -1, np.int64)
        code[chosen] = np.arange(len(chosen))
        mine = code[feature] >= 0
        order = np.argsort(of_word[mine], kind="stable")
        listed = code[feature][mine][order]
        ends = np.searchsorted(of_word[mine][order], np.arange(len(known) + 1))
        rows = [np.concatenate([listed[ends[w] : ends[w + 1]] for w in c] or [np.zeros(0, np.int64)]) for c in (c[(ends[c + 1] > ends[c])] for c in coded)]
        x = Rows(rows, len(chosen))
        weights = nnpu(x, positive, prior, len(chosen))
        weights[-1] -= threshold(x.dot(weights), positive, prior)
        out[""][part] = float(weights[-1])
        for i, w in zip(chosen, weights):
            out.setdefault(all_names[i], [0.0] * len(_PARTS))[part] = float(w)
    return list(out.items())


class Scorer:
    def __init__(self, model: list[tuple[str, list[float]]]):
        weights = dict(model)
        self.bias = np.array(weights.pop("", [-30.0] * len(_PARTS)))
        self.weights = {f: np.array(w) for f, w in weights.items()}
        self.words: dict[str, np.ndarray | None] = {}

    def word(self, word: str) -> np.ndarray | None:
        found = [self.weights[f] for f in word_features(word) if f in self.weights]
        return np.sum(found, axis=0) if found else None

    def score(self, text: str) -> float:
        total, known = self.bias, self.words
        for word in distinct_words(text):
            if word in known:
                w = known[word]
            else:
                if len(known) >= REMEMBERED:
                    known.clear()
                w = known[word] = self.word(word)
            if w is not None:
                total = total + w
        return float(np.mean(1 / (1 + np.exp(-np.clip(total, -30, 30)))))


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: list[tuple[str, list[float]]]) -> Scorer:
    key = hashlib.sha256(repr(model).encode()).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> list[tuple[str, list[float]]]:
    """The model: up to 3 * FEATURES named weights. ``learn`` is a condition on the id, for documents and labels alike.

    The prior is the share of toxic among learnable labels. Of several labels of an id, toxic wins; null labels count as
    none. About ``positives`` confirmed toxic documents and ``unlabelled`` others, by a hash of the id, are reduced to their distinct words where they
    lie, and one task fits on those.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null").where(learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n, n_pos = known.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(learn)
    n_docs = own.count()
    if not n_pos or not n_docs:
        return []
    prior = min(0.5, max(1e-3, n_pos / n))
    chance = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    confirmed = known.where("label = 1").where(chance("p") < positives / n_pos).select("doc_id", F.lit(True).alias("positive"))  # about ``positives`` rows
    sample = own.join(F.broadcast(confirmed), "doc_id", "left").withColumn("unlabelled", chance("u") < unlabelled / n_docs)
    sample = sample.where("positive or unlabelled").select(F.coalesce("positive", F.lit(False)).alias("positive"), "unlabelled", "text")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(distinct_words(t.as_py() or ""))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string()), pa.array([0] * len(words), pa.int32())], names=["positive", "unlabelled", "words", "one"])

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("words", "ascending")])  # the same fit whatever the partitions
        docs = []
        for p, u, words in zip(*(rows.column(c).to_pylist() for c in ("positive", "unlabelled", "words"))):
            docs += [(True, words)] * p + [(False, words)] * u
        model = fit(docs, prior)
        return pa.table([pa.array([f for f, _ in model], pa.string()), pa.array([w for _, w in model], pa.list_(pa.float64()))], names=["feature", "weights"])

    reduced_rows = sample.mapInArrow(reduced, "positive boolean, unlabelled boolean, words string, one int")
    found = reduced_rows.groupBy("one").applyInArrow(fitted, "feature string, weights array<double>").collect()
    return sorted((r.feature, list(r.weights)) for r in found)


def toxicity(text: Column, model: list[tuple[str, list[float]]]) -> Column:
    """Score from 0 to 1 of a text by ``model``; null texts count as empty. Without a model, scores are about 0."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        score = _scorer(model).score
        return pa.array([score(x.as_py() or "") for x in texts], pa.float64())

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id mod ``folds`` is 0; false for null ids), score, predicted.

    Only ids that aren't held out are learnt from, and only texts are scored. Rows are scored one by one, so ids may be
    null or repeat, and texts of any length count whole. Without any toxic label, all scores are about 0; an empty table
    gives no rows. Other columns of either table aren't read, whatever their names.
    """
    model = train(docs, labels, id_remainder(F.col("doc_id"), folds) != 0, id_col, text_col, label_col)
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(id_remainder(F.col(id_col), folds) == 0, F.lit(False)).alias("held_out"),
        toxicity(F.col(text_col), model).alias("score"),
    )
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
