"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word has three rows: two by hashes of itself, so words that share one seldom share both, and one by a hash of its
first ``STEM`` bytes, so inflected forms share what they mean; rows that fewer than two training texts touched are
zero, so unknown words are neutral.  Filters of several widths slide over the whole
text, each keeps its maximum, and a logistic layer adds them up.  The decision threshold is calibrated for each
language, where the language is the group of letters that the text itself uses: the table's columns beside the text
are no input.  Training takes a bounded hash sample of the labelled rows (``SAMPLE`` per label, texts of at most
``SAMPLE_CHARS``); scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fold, free_name, schema_with, texts_of

SHIFT = 18
ROWS = 1 << SHIFT  # rows of each embedding table; row 0 is padding
DIM = 6  # numbers per row
TABLES, STEM = 3, 5
WIDTHS = (1, 2, 3)
FILTERS = 12  # of each width
SAMPLE = 3000  # training rows of each label at most
SAMPLE_CHARS = 50_000  # longer texts are not trained on; all texts are scored
EPOCHS = 8
FALSE_ALARM = 4.0
CHUNK = 1 << 16  # words convolved at once
PUNCTUATION = b".,;:!?\"'()[]{}<>|#*$%&=+-_/\\"

# Letters that mark the spelling of a language group.
LETTERS = {"es": "ñíóáú¿¡", "fr": "èçêàâùœ", "de": "äöüß", "cyr": "оеаинт", "greek": "αοιετσ"}


def language_group(text: str) -> str:
    """The group whose marked letters are most frequent; ``plain`` if they are fewer than 2 in 1000 characters."""
    low = text.lower()
    counts = {g: sum(map(low.count, letters)) for g, letters in LETTERS.items()}
    best = max(counts, key=counts.get)
    return best if 500 * counts[best] >= max(1, len(text)) else "plain"


class WordRows(dict):
    """Word to its row numbers, packed into one integer; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        bare = word.strip(PUNCTUATION) or word
        keys = (bare, bare[::-1] + b"#", bare[:STEM] + b"*")
        self[word] = packed = sum((zlib.crc32(k) % (ROWS - 1) + 1) << SHIFT * t for t, k in enumerate(keys))
        return packed

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def row_of(packed: np.ndarray, table: int) -> np.ndarray:
    return packed >> SHIFT * table & ROWS - 1


@dataclass
class ToxicityModel:
    tables: np.ndarray  # TABLES, ROWS, DIM
    filters: list[np.ndarray]  # per width: width, TABLES * DIM, FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]  # logit at which a language group's score is 0.5
    scale: float = 1.0

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[t][row_of(rows, t)] for t in range(TABLES)], 1)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Maximum of every filter over each whole text (len(texts), 3 * FILTERS)."""
        reach = max(WIDTHS) - 1
        out = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        pieces = [(k, s) for k, t in enumerate(texts) for s in range(0, max(1, len(t)), CHUNK)]
        at = 0
        while at < len(pieces):
            held, of, n = [], [], 0
            while at < len(pieces) and n < CHUNK:
                k, s = pieces[at]
                piece = np.zeros(max(1, min(CHUNK, len(texts[k]) - s)) + reach, np.int64)
                own = texts[k][s:s + len(piece)]  # goes on into the next piece, so no window is lost
                piece[:len(own)] = own
                held.append(piece)
                of.append(k)
                n += len(piece)
                at += 1
            x = self.embed(np.concatenate(held))
            ends = np.cumsum([len(p) for p in held])
            starts = ends - [len(p) for p in held]
            valid = np.ones(len(x), bool)
            for back in range(1, reach + 1):
                valid[ends - back] = False
            for j, (w, b) in enumerate(zip(self.filters, self.biases)):
                act = convolved(x, w) + b
                act[~valid] = -np.inf
                np.maximum.at(out[:, j * FILTERS:(j + 1) * FILTERS], of, np.maximum.reduceat(act, starts, axis=0))
        return np.maximum(out, 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts) @ self.out + self.out_bias

    def scores(self, texts: list[np.ndarray], groups: list[str]) -> np.ndarray:
        level = np.array([self.thresholds.get(g, self.thresholds[""]) for g in groups])
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.logits(texts) - level), -60, 60)))


def convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    act = x @ w[0]
    for k in range(1, len(w)):
        act[:-k] += x[k:] @ w[k]
    return act


def train(texts: list[np.ndarray], labels: np.ndarray, groups: list[str], seed: int = 7) -> ToxicityModel:
    """Adagrad on the logistic loss; every fifth text is left out of the fit and sets scale and thresholds.

    No text, or texts of one label only: a constant model (score about the label's share, under 0.5 without any).
    """
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.05, (TABLES, ROWS, DIM)).astype(np.float32)
    tables[:, 0] = 0
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out, none = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32) * rng.choice([-1, 1, 1], len(WIDTHS) * FILTERS), not len(labels)
    model = ToxicityModel(tables, filters, biases, out.astype(np.float32), 0.0, {"": 0.0})
    if none or labels.min() == labels.max():
        model.tables[:] = 0
        model.out[:] = 0
        model.out_bias = 3.0 if not none and labels.min() else -3.0
        return model
    spare = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~spare)
    seen = np.zeros((TABLES, ROWS), np.int32)
    for k in fit:
        rows = np.unique(texts[k])
        for t in range(TABLES):
            seen[t][np.unique(row_of(rows, t))] += 1
    weight = np.where(labels == 1, 0.5 / max(1, (labels[fit] == 1).sum()), 0.5 / max(1, (labels[fit] == 0).sum())) * len(fit)
    past_t, past_f, past_o = np.zeros((TABLES, ROWS), np.float32) + 1e-6, [np.zeros_like(f) + 1e-6 for f in filters], np.zeros_like(model.out) + 1e-6
    past_b = [np.zeros(FILTERS) + 1e-6 for _ in WIDTHS]
    reach, rate = max(WIDTHS) - 1, 0.1
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            rows = np.concatenate([texts[k], np.zeros(reach, np.int64)]) if len(texts[k]) else np.zeros(reach + 1, np.int64)
            x = model.embed(rows)
            n = len(rows) - reach
            at, pool = [], []
            for w, b in zip(model.filters, model.biases):
                act = convolved(x, w)[:n] + b
                top = act.argmax(0)
                at.append(top)
                pool.append(act[top, np.arange(FILTERS)])
            raw = np.concatenate(pool)
            hidden = np.maximum(raw, 0)
            z = float(hidden @ model.out + model.out_bias)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]) * weight[k]
            if abs(err) < 1e-3:
                continue
            back = err * model.out * (raw > 0)
            grad = err * hidden + 1e-4 * model.out
            past_o += grad ** 2
            model.out -= rate * grad / np.sqrt(past_o)
            model.out_bias -= 0.05 * err
            spots, moves = [], []
            for j, w in enumerate(model.filters):
                g = back[j * FILTERS:(j + 1) * FILTERS]
                for d in range(len(w)):
                    spot = at[j] + d
                    spots.append(spot)
                    moves.append(g[:, None] * w[d].T)
                    gw = x[spot].T * g
                    past_f[j][d] += gw ** 2
                    w[d] -= rate * 0.5 * gw / np.sqrt(past_f[j][d])
                past_b[j] += g ** 2
                model.biases[j] -= (rate * 0.5 * g / np.sqrt(past_b[j])).astype(np.float32)
            spots, moves = np.concatenate(spots), np.concatenate(moves)
            for t in range(TABLES):
                own, where = np.unique(row_of(rows[spots], t), return_inverse=True)
                step = np.zeros((len(own), DIM), np.float32)
                np.add.at(step, where, moves[:, t * DIM:(t + 1) * DIM])
                past_t[t][own] += (step ** 2).mean(1)
                model.tables[t][own] -= rate * step / np.sqrt(past_t[t][own])[:, None]
            model.tables[:, 0] = 0
    model.tables[seen < 2] = 0  # words of fewer than two texts stay neutral
    calibrate(model, [texts[k] for k in np.flatnonzero(spare)], labels[spare], [groups[k] for k in np.flatnonzero(spare)])
    return model


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of the least error; a clean text rejected counts FALSE_ALARM fold."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    pos, neg = max(1, y.sum()), max(1, (1 - y).sum())
    error = np.concatenate([[0], np.cumsum(y)]) / pos + FALSE_ALARM * (neg - np.concatenate([[0], np.cumsum(1 - y)])) / neg
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gaps = np.concatenate([[0], z[1:] - z[:-1], [0]])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(cuts[best[gaps[best].argmax()]])


def calibrate(model: ToxicityModel, texts: list[np.ndarray], y: np.ndarray, groups: list[str], least: int = 20) -> None:
    """Threshold over all spare texts, and for each language group with ``least`` texts of either label."""
    if not len(texts) or y.min() == y.max():
        return
    z, g = model.logits(texts), np.array(groups)
    model.thresholds = {"": best_threshold(z, y)}
    for name in sorted(set(groups)):
        own = g == name
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            model.thresholds[name] = best_threshold(z[own], y[own])
    model.scale = float(np.clip(4 / max(1e-3, abs(np.median(z[y == 1]) - model.thresholds[""])), 0.05, 20))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_where=None) -> ToxicityModel:
    """Learn from labelled rows that fulfil ``train_where`` (a condition on doc_id; default: all).

    The sample is the rows first in hash order, of either label; ids with contradicting labels are left out.
    """
    truth = labels.where("doc_id is not null and toxic is not null")
    if train_where is not None:
        truth = truth.where(train_where)
    truth = truth.groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("high")).where("y = high")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [truth.where(F.col("y") == y).orderBy(*order).limit(SAMPLE).select("doc_id", "y") for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most 2 * SAMPLE rows
    words = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id")
    rows = sorted(words.distinct().collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    hashed = WordRows()
    return train([hashed.of(r["text"]) for r in rows], np.array([r["y"] for r in rows], np.float32),
                 [language_group(r["text"]) for r in rows])


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str) -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text as column ``name``; null counts as empty."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordRows()
        for batch in batches:
            texts = texts_of(batch, at)
            scores = model.scores([hashed.of(t) for t in texts], [language_group(t) for t in texts]) if texts else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.asarray(scores, np.float64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, schema_with(docs, name, "double"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from the rows that are not held out.

    Null and empty texts score as a text without words; repeated rows and null ids each get a row; an empty label
    table gives scores under 0.5; extra columns are not read.
    """
    model = fit_toxicity(docs, labels, fold("doc_id", 5) != 0)
    scored = with_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the classifier doesn't reject."""
    name = free_name(docs, "toxicity")
    model = fit_toxicity(docs, labels, fold("doc_id", 5) != 0)
    return with_toxicity(docs, model, name).where(F.col(name) < 0.5).drop(name)
