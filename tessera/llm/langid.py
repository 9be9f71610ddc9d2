"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A subword is a run of two to four UTF-8 bytes inside a word, word edges included; digits and ASCII punctuation part
words.  Its hash picks a row of the embedding table; a text is the mean of its rows.  As the layer above is linear, the
scorer holds the product of both (one small row of logits per bucket) and sums it over the whole text in blocks.
Training takes a bounded hash sample of the rows with a language (``SAMPLE`` per language, at most ``LANGUAGES``
languages by name order of the hash sample, texts of at most ``SAMPLE_CHARS``); prediction reads every text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_batches, fold

BUCKETS = 1 << 16
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE = 1200  # training rows of each language at most
LANGUAGES = 256
SAMPLE_CHARS = 20_000
THIN = 1 << 40
EPOCHS = 4
RATE = 0.5
BLOCK = 1 << 18  # bytes hashed at once
UNKNOWN = "und"
#: ASCII capitals become small letters; all other ASCII than letters becomes a space.
LETTERS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subword_hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the subwords of a byte array (it starts and ends with a space), per block and length."""
    for s in range(0, len(data), BLOCK):
        part = data[s:s + BLOCK + max(GRAMS) - 1].astype(np.uint32)
        own = min(BLOCK, len(data) - s)
        space = part == 32
        for n in GRAMS:
            m = min(own, len(part) - n + 1)
            if m <= 0:
                continue
            h, inside = part[:m].copy(), np.ones(m, bool)
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ part[k:k + m]
                if k < n - 1:
                    inside &= ~space[k:k + m]
            if n == 2:
                inside = ~(space[:m] & space[1:1 + m])
            h = (h ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            yield (h >> np.uint32(16))[inside] & np.uint32(BUCKETS - 1)


def spelled(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY) + b" ", np.uint8)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # BUCKETS, languages: the embedding times the softmax layer
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in subword_hashes(spelled(text)):
            total += self.logits[h].sum(0, dtype=np.float64)
            n += len(h)
        z = total / max(1, n) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether it is below the calibrated bound of rejection."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject_below)


def train(texts: list[str], langs: list[str], seed: int = 11) -> LanguageModel:
    """SGD over texts as bags of buckets; every fifth text is left out and sets temperature and rejection.

    No text: a model without languages, which answers ``und``.
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, len(names)), np.float32)
    bags = []
    for t in texts:
        found = list(subword_hashes(spelled(t)))
        ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
        bags.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    y = np.array([names.index(v) for v in langs])
    spare = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~spare) if (~spare).any() else np.arange(len(y))
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            ids, share = bags[k]
            if not len(ids):
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ table[ids]
            z = mean @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            # the mean spreads the step over all rows; scaling by their number keeps it as large as the layer's
            table[ids] -= np.outer(share * (rate * len(ids)) ** 0.5 * 4, back)
    model = LanguageModel(names, (table @ layer).astype(np.float32))
    calibrate(model, [texts[k] for k in np.flatnonzero(spare)], y[spare])
    return model


def calibrate(model: LanguageModel, texts: list[str], y: np.ndarray, errors: float = 0.5) -> None:
    """Temperature of the least log loss on the spare texts; reject under the probability below which at least
    ``errors`` of the spare texts are wrong (the chance level if none is)."""
    model.reject_below = 1 / max(1, len(model.languages))
    if not texts:
        return
    best = (np.inf, 1.0)
    raw = [np.log(np.maximum(model.probabilities(t), 1e-300)) for t in texts]
    for temperature in np.geomspace(0.02, 20, 40):
        z = np.array(raw) / temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean()
        if loss < best[0] - 1e-9:
            best = (loss, temperature, p)
    model.temperature = float(best[1])
    top, right = best[2].max(1), best[2].argmax(1) == y
    order = np.argsort(top)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(top) + 1)
    bad = np.flatnonzero(wrong >= errors)
    if len(bad):
        model.reject_below = max(model.reject_below, float(top[order[bad[-1]]]))


def fit_languages(docs: DataFrame, train_where=None) -> LanguageModel:
    """Learn from rows with a text and a language that fulfil ``train_where``; the sample is first in hash order."""
    rows = docs.where("text is not null and lang is not null")
    if train_where is not None:
        rows = rows.where(train_where)
    rows = rows.where(F.char_length("text") <= SAMPLE_CHARS)
    names = rows.groupBy("lang").count().orderBy(F.xxhash64("lang"), "lang").limit(LANGUAGES).collect()
    if not names:
        return train([], [])
    # one pass: rows thinned by hash to about twice the sample, of which the first in hash order are taken
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(THIN))
    wanted = F.coalesce(*[F.when(F.col("lang") == r["lang"], min(THIN, 2 * SAMPLE * THIN // r["count"] + 1)) for r in names])
    thin = rows.where(spot < wanted).select("doc_id", "lang", spot.alias("spot")).distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "doc_id"))
    picked = thin.withColumn("turn", turn).where(F.col("turn") <= SAMPLE).select("doc_id", "lang")
    words = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).distinct()
    got = sorted(words.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["lang"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got])


def predicted_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, each text read whole."""
    bounded_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; learns from rows that are not held out.

    Null texts and texts without a letter: ``und``, score 0, rejected.  Repeated rows and null ids each get a row;
    rows without a language are predicted but not learned from; no training row at all: ``und``; extra columns are
    not read.
    """
    model = fit_languages(docs, fold("doc_id", 4) != 2)
    out = predicted_languages(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
