"""Language identification by multilingual mixture inference.

A language is a distribution over character trigrams, counted over all documents learnt from. A document is a mixture of
languages, each of its words being in one of them: expectation-maximisation finds the languages' proportions from the
words' trigram likelihoods. Which languages are in the mixture is settled by penalised likelihood: starting with the
best single language, the next in proportion joins as long as the likelihood gains more than the penalty of a further
parameter. The prediction is the language with the greatest proportion, the score is that proportion.

All steps run over many documents at once in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, id_remainder, trim

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
#: Nats that a further language must gain, times the logarithm of the number of words.
PENALTY = 4.0
UNKNOWN = "und"
#: Characters and languages (their product) handled at once.
_CELLS = 1 << 20


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and whether a letter or a mark."""
    kind = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.array([k == "L" for k in kind])
    return letter, letter | np.array([k == "M" for k in kind])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, in order; the first letter of each word; each word's text.

    A word is a run of letters and marks that has a letter."""
    letter, wordy = _letters()
    points = np.frombuffer((" " + "  ".join(texts) + " ").lower().encode("utf-32-le", "replace"), np.uint32)
    lengths = [len(t.lower()) + 2 for t in texts]
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(points)]
    inside = wordy[points]
    seen = np.where(inside, points, 32).astype(np.uint64)
    h = seen[:-2] * np.uint64(0x9E3779B1) + seen[1:-1] * np.uint64(0x85EBCA77) + seen[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    at = np.flatnonzero(inside[1:-1])  # the middle is at + 1
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    spoken = np.add.reduceat(letter[points[at + 1]], starts) > 0 if len(starts) else np.zeros(0, bool)
    if not spoken.all():  # runs of marks only
        keep = np.repeat(spoken, np.diff(np.append(starts, len(at))))
        at = at[keep]
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return bucket[at], starts, owner[at[starts] + 1]


def _groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """Trigram counts by language (little-endian 64-bit, one a bucket), over all documents where ``learn`` holds and
    language and text aren't null. The model has a quarter of a megabyte a language, whatever the corpus; of over 256
    languages it is refused with a ValueError."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = [batch.column(1)[int(i)].as_py() for i in np.flatnonzero(langs == lang)]
                if lang not in totals:
                    if len(totals) >= 64:
                        yield from flush()
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                for a, b in _groups(texts, 1 << 18):
                    totals[lang] += np.bincount(trigrams(texts[a:b])[0], minlength=BUCKETS)
            trim()
        yield from flush()

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    own = own.where(learn).where("lang is not null and text is not null").select("lang", "text")
    sums = own.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    n_langs = own.agg(F.count_distinct("lang")).first()[0]
    if n_langs * BUCKETS * 8 > BROADCAST_BYTES:
        raise ValueError(f"{n_langs} languages make a model that is too large to send to every task")
    tables: dict[str, np.ndarray] = {}
    for batch in sums.toArrow().to_batches():
        langs = batch.column(0).to_pylist()
        for lang, bucket, n in zip(langs, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            tables.setdefault(lang, np.zeros(BUCKETS, "<i8"))[bucket] = n
    return sorted((lang, t.tobytes()) for lang, t in tables.items())


def _em(like: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document, and each document's log-likelihood; ``like``: by word and language."""
    n = np.diff(np.append(starts, len(like)))[:, None]
    total = None
    for _ in range(rounds):
        part = like * share[owner]
        total = part.sum(1)
        part /= total[:, None]
        share = np.add.reduceat(part, starts, axis=0) / n
    total = (like * share[owner]).sum(1)
    return share, np.add.reduceat(np.log(total), starts)


def mixture(like: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language and its proportion for each document. ``like``: log-likelihoods by word and language, ``starts``: the
    first word of each document, none being empty."""
    n_langs, n_docs = like.shape[1], len(starts)
    n = np.diff(np.append(starts, len(like)))
    alone = np.add.reduceat(like, starts, axis=0)
    best = alone.argmax(1)
    score, height = np.ones(n_docs), alone.max(1)
    if n_langs == 1:
        return best, score
    top = like.max(1)
    like = np.maximum(np.exp(like - top[:, None]), 1e-30)
    height = height - np.add.reduceat(top, starts)
    owner = np.repeat(np.arange(n_docs), n)
    full, _ = _em(like, starts, owner, np.full((n_docs, n_langs), 1 / n_langs), ROUNDS)
    chosen = np.zeros((n_docs, n_langs), bool)
    chosen[np.arange(n_docs), best] = True
    going = np.arange(n_docs)
    for _ in range(n_langs - 1):
        rest = np.where(chosen[going], -1, full[going])
        more = chosen[going].copy()
        more[np.arange(len(going)), rest.argmax(1)] = True
        mine = np.zeros(n_docs, bool)
        mine[going] = True
        words = np.repeat(mine, n)
        first = np.concatenate([[0], np.cumsum(n[going])[:-1]])
        share = np.where(more, full[going] + 0.01, 0)
        share, now = _em(like[words], first, np.repeat(np.arange(len(going)), n[going]), share / share.sum(1)[:, None], ROUNDS // 2)
        better = now - height[going] > PENALTY * np.log(n[going] + 1)
        kept = going[better]
        if not len(kept):
            break
        chosen[kept], height[kept] = more[better], now[better]
        best[kept], score[kept] = share[better].argmax(1), share[better].max(1)
        going = kept
    return best, score


def identify(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``logs``: log-probabilities by bucket and language."""
    out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    whole = [t or "" for t in texts]
    if not langs:
        return out, scores
    for a, b in _groups(whole, max(1, _CELLS // len(langs))):
        bucket, words, owner = trigrams(whole[a:b])
        if not len(words):
            continue
        like = np.add.reduceat(logs[bucket], words, axis=0).astype(np.float64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        best, score = mixture(like, starts)
        for doc, i, s in zip((owner[starts] + a).tolist(), best.tolist(), score.tolist()):
            out[doc], scores[doc] = langs[i], min(1.0, max(0.0, s))
    return out, scores


def language(text: Column, model: list[tuple[str, bytes]]) -> Column:
    """struct<lang_pred: string, score: double> of a text: ``und`` and 0 if it is null, has no letter, or the model has
    no language."""
    langs = [lang for lang, _ in model]

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        counts = np.stack([np.frombuffer(t, "<i8") for _, t in model], axis=1) + SMOOTHING if model else np.zeros((BUCKETS, 0))
        names, scores = identify(texts.to_pylist(), langs, np.log(counts / counts.sum(0)).astype(np.float32))
        trim()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return found(text)


def not_held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) != 2


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id mod 4 is 2; false for null ids), lang_pred and score.

    Learns from the text and language of documents with an id that isn't held out, predicts from texts alone. Rows are
    scored one by one, so ids may be null or repeat, and a very long text is taken whole, by itself; other columns aren't
    read. A table without any language gives ``und`` throughout, an empty one no rows.
    """
    model = train(docs, not_held_out(F.col("doc_id")), id_col, text_col, lang_col)
    held_out = F.coalesce(id_remainder(F.col(id_col), 4) == 2, F.lit(False))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), language(F.col(text_col), model).alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that have no language, or none with ``least`` of the text."""
    model = train(docs, not_held_out(F.col("doc_id")), id_col, text_col, lang_col)
    found = language(F.col(text_col), model)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
