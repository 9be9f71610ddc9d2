"""LM scoring: Brown class-based bigrams with exchange clustering.

p(w | history) = p(class of w | class of the word before) * p(w | class of w).  The ``DICTIONARY`` most frequent training
words (fewer words than that: all) are put into ``CLASSES`` classes by exchange clustering: in rounds, half of the words
at a time each move to the class under which their neighbours are most likely, their own counts taken out of the class
they are in.  Their neighbours are counted once, over the whole training text: every word of the dictionary by itself, all
others by the class of their spelling, which never changes.  They lie as one row per word in a Spark table; a round sends
out the class of each word and gets back sums by class.
All other words, words seen fewer than ``LEAST`` times and words never seen have a class by their spelling, so every
word has one, and the classes of rare words say what an unknown word costs.  Counts of words are never cut off:
those in the dictionary travel with the job, all others meet their counts in a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, dropped, fold, texts_of, written

DICTIONARY = 1 << 18  # words that travel with a job
CLASSES = 64
LEAST = 4
SPELLINGS = 24
END = b"\n"  # no word holds white space
END_CLASS = CLASSES + SPELLINGS
ALL_CLASSES = END_CLASS + 1
ROUNDS = 8
KEPT_WORDS = 300_000  # words a task counts before it hands its counts on
KEPT_PAIRS = 1 << 21
DIGIT = re.compile(rb"[0-9]")
BINS = 16  # of word counts, per doubling
PRIOR = 10.0  # weight of the class frequencies in the class transitions


def spelling(word: bytes) -> int:
    """Class of a word outside the dictionary: digits, last character, letters beyond ASCII, length."""
    if word == END:
        return END_CLASS
    last = 1 if word[-1:] in b".!?" else 2 if word[-1:] in b",;:" else 0
    digits = DIGIT.search(word) is not None
    return CLASSES + ((last * 2 + digits) * 2 + (not word.isascii())) * 2 + (len(word) > 9)


def stream(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of the texts one after the other, each text closed by END, and the number of tokens of each."""
    tokens: list[bytes] = []
    sizes = []
    for t in texts:
        words = t.encode("utf-8", "replace").lower().split()
        tokens += words
        tokens.append(END)
        sizes.append(len(words) + 1)
    return tokens, np.array(sizes, np.int64)


def numbers(tokens: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(ids.get, tokens, repeat(-1)), np.int32, len(tokens))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for t in texts_of(batch, 0):
                seen.update(t.encode("utf-8", "replace").lower().split())
                seen[END] += 1
                if len(seen) >= KEPT_WORDS:
                    yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each word, whose entries stand together, with its codes and counts as packed arrays."""
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    ends = np.append(head, len(word)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(word[head].astype(np.int32)), *[pa.Array.from_buffers(
            pa.binary(), len(head), [None, pa.py_buffer(ends * 4), pa.py_buffer(a.astype(np.int32))])
            for a in (code, n)]], names=["word", "codes", "counts"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of packed arrays, and how many each row has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(data, np.int32, (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.empty(0, np.int32)
    return values, np.diff(ends) // 4


def neighbours(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(word, codes, counts): for each dictionary word all its neighbours, code 2 * neighbour + side, in packed arrays.

    A neighbour is a word's number in the dictionary, or the dictionary's size plus the class by spelling less ``CLASSES``.
    """
    size = len(ids)
    span = 2 * (size + ALL_CLASSES - CLASSES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept = 0

        def out() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            held.clear()
            pairs.sort()
            head = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            word, code = np.divmod(pairs[head], span)
            return _packed(word, code, np.diff(np.append(head, len(pairs))))

        for batch in batches:
            tokens, _ = stream(texts_of(batch, 0))
            if not tokens:
                continue
            tokens.insert(0, END)  # as in the model, END stands before the first text
            own = numbers(tokens, ids).astype(np.int64)
            at, number, _, spelled = _outside(tokens, own)
            near = own.copy()
            near[at] = spelled[number] + (size - CLASSES)
            for word, other, side in ((own[1:], near[:-1], 0), (own[:-1], near[1:], 1)):
                ok = word >= 0
                held.append(word[ok] * span + other[ok] * 2 + side)
                kept += len(held[-1])
            if kept >= KEPT_PAIRS:
                yield out()
                kept = 0
        if kept:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.empty(0, np.int64), np.empty(0, np.int64)  # of the last word, added up; it may go on
        for batch in batches:
            code, lengths = _unpacked(batch.column(1))
            word = np.repeat(batch.column(0).to_numpy().astype(np.int64), lengths)
            pair, where = np.unique(np.concatenate([pair, word * span + code]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, _unpacked(batch.column(2))[0]]), len(pair)).astype(np.int64)
            cut = np.searchsorted(pair, pair[-1] // span * span) if len(pair) else 0
            if cut:
                yield _packed(*np.divmod(pair[:cut], span), n[:cut])
                pair, n = pair[cut:], n[cut:]
        if len(pair):
            yield _packed(*np.divmod(pair, span), n)

    kind = "word int, codes binary, counts binary"
    parts = docs.select("text").mapInArrow(count, kind)
    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(merge, kind)


def _cells(classes: np.ndarray) -> np.ndarray:
    """Of each code its side and its neighbour's class, as one number."""
    return (np.append(classes, np.arange(CLASSES, ALL_CLASSES))[:, None] + np.array([0, ALL_CLASSES])).ravel()


def _profiles(batch: pa.RecordBatch, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch, and how often a neighbour of each class stands on either side of them."""
    word = batch.column(0).to_numpy()
    code, lengths = _unpacked(batch.column(1))
    at = np.repeat(np.arange(len(word)) * (2 * ALL_CLASSES), lengths) + cells[code]
    n, _ = _unpacked(batch.column(2))
    return word, np.bincount(at, n, len(word) * 2 * ALL_CLASSES).reshape(len(word), -1)


def exchanged(table: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each dictionary word after exchange rounds; words that close a text keep theirs."""
    best, best_score = classes, -np.inf
    for turn in range(rounds + 1):

        def sums(batches: Iterator[pa.RecordBatch], classes: np.ndarray = classes) -> Iterator[pa.RecordBatch]:
            total, cells = np.zeros((ALL_CLASSES, 2 * ALL_CLASSES)), _cells(classes)
            for batch in batches:
                word, x = _profiles(batch, cells)
                np.add.at(total, classes[word], x)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "n"])

        got = table.mapInArrow(sums, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # by class
        total = np.zeros(ALL_CLASSES * 2 * ALL_CLASSES)
        total[got.column("at").to_numpy()] = got.column("n").to_numpy()
        total = total.reshape(ALL_CLASSES, -1)
        share = (total + 0.1) / (total.sum(1, keepdims=True) + 0.1 * total.shape[1])
        score = float((total * np.log(share)).sum())
        if score > best_score:
            best, best_score = classes, score
        if turn == rounds or score < best_score:
            break

        def move(batches: Iterator[pa.RecordBatch], classes: np.ndarray = classes, total: np.ndarray = total,
                 logs: np.ndarray = np.log(share[:CLASSES]), turn: int = turn) -> Iterator[pa.RecordBatch]:
            cells = _cells(classes)
            for batch in batches:
                word, x = _profiles(batch, cells)
                now = classes[word]
                fit = x @ logs.T
                rest = total[now] - x
                own = np.log((rest + 0.1) / (rest.sum(1, keepdims=True) + 0.1 * rest.shape[1]))
                inside = now < CLASSES
                fit[np.flatnonzero(inside), now[inside]] = (x * own).sum(1)[inside]
                to = np.where(inside & (word % 2 == turn % 2), fit.argmax(1), now)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(to.astype(np.int32))], names=["word", "class"])

        moved = table.mapInArrow(move, "word int, class int").toArrow()  # at most one row per dictionary word
        classes = classes.copy()
        classes[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return best


@dataclass
class ClassModel:
    ids: dict[bytes, int]
    counts: np.ndarray
    classes: np.ndarray
    total: int  # training tokens
    distinct: int  # of them
    denominators: np.ndarray  # log10 of a class's tokens, smoothed
    transitions: np.ndarray  # log10

    @property
    def base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def _outside(tokens: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Places of tokens outside the dictionary, the number of each one's word, those words, and the words' classes."""
    at = np.flatnonzero(own < 0)
    words: dict[bytes, int] = {}
    number = np.fromiter((words.setdefault(tokens[k], len(words)) for k in at.tolist()), np.int64, len(at))
    return at, number, list(words), np.fromiter(map(spelling, words), np.int64, len(words))


def trained(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of all texts of ``docs``, and the counts (word, n) of all words outside its dictionary."""
    counts = written(word_counts(docs), "lm-words")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the dictionary: bins of counts from the highest down, as long as their words fit
    bin_of = F.floor(F.log2("n") * BINS)
    floor, held = 1 << 30, 0
    for r in sorted(counts.groupBy(bin_of.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        held += r["count"]
        if held > DICTIONARY:
            break
        floor = r["bin"]
    top = counts.where(bin_of >= floor).toArrow()  # DICTIONARY rows at most
    found = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words, n = [w for _, w in found], np.array([c for c, _ in found], np.int64)
    ids = {w: k for k, w in enumerate(words)}
    others = counts.where(bin_of < floor)
    classes = np.array([spelling(w) if w == END or c < LEAST else k % CLASSES
                        for k, (w, c) in enumerate(zip(words, n.tolist()))], np.int64)
    if words:
        table = written(neighbours(docs, ids), "lm-neighbours")
        classes = exchanged(table, classes)
        dropped(table)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL_CLASSES ** 2, np.int64)
        for batch in batches:
            tokens, _ = stream(texts_of(batch, 0))
            if tokens:
                own = numbers(tokens, ids)
                at, number, _, spelled = _outside(tokens, own)
                own = classes[own] if len(classes) else own.astype(np.int64)
                own[at] = spelled[number]
                before = np.append(END_CLASS, own[:-1])
                total += np.bincount(before * ALL_CLASSES + own, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    got = docs.select("text").mapInArrow(pairs, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(ALL_CLASSES ** 2)
    seen[got.column("at").to_numpy()] = got.column("n").to_numpy()
    seen = seen.reshape(ALL_CLASSES, ALL_CLASSES)
    overall = (seen.sum(0) + 1) / (seen.sum() + ALL_CLASSES)
    transitions = np.log10((seen + PRIOR * overall) / (seen.sum(1, keepdims=True) + PRIOR))

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(ALL_CLASSES, np.int64), np.zeros(ALL_CLASSES, np.int64)
        for batch in batches:
            own = np.array([spelling(w) for w in batch.column(0).to_pylist()], np.int64)
            tokens += np.bincount(own, batch.column(1).to_numpy(), ALL_CLASSES).astype(np.int64)
            types += np.bincount(own, minlength=ALL_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ALL_CLASSES)), pa.array(tokens), pa.array(types)], names=["class", "n", "types"])

    tokens, types = np.bincount(classes, n, ALL_CLASSES), np.bincount(classes, minlength=ALL_CLASSES).astype(float)
    for r in others.mapInArrow(spelt, "class long, n long, types long").groupBy("class").agg(
            F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        tokens[r["class"]] += r["n"]
        types[r["class"]] += r["types"]
    model = ClassModel(ids, n, classes, int(whole[0]), int(whole[1]), np.log10(tokens + 0.5 * (types + 1)), transitions)
    return model, others


def scored(docs: DataFrame, model: ClassModel, others: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row (see ``lm_scores``)."""
    words = np.log10(model.counts + 0.5)
    base, inner = words - model.base, words - model.denominators[model.classes] if len(words) else words

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = stream(texts_of(batch, 1))
            if not tokens:
                continue
            own = numbers(tokens, model.ids)
            out, number, names, spelled = _outside(tokens, own)
            inside = own >= 0
            classes = model.classes[own] if len(words) else own.astype(np.int64)
            classes[out] = spelled[number]
            at = np.cumsum(sizes) - sizes
            known, first, second = np.zeros(len(own), np.int64), np.zeros(len(own)), model.transitions[
                np.append(END_CLASS, classes[:-1]), classes]
            if len(words):
                known[inside] = model.counts[own[inside]] > 0
                first[inside] = base[own[inside]]
                second[inside] += inner[own[inside]]
            # words outside the dictionary: one row for each text and word, to meet their counts
            pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[out] * max(1, len(names)) + number, return_counts=True)
            text, number = pair // max(1, len(names)), pair % max(1, len(names))
            row = pa.array(np.append(np.arange(len(sizes)), text))
            none, zero = np.zeros(len(sizes), np.int64), np.zeros(len(pair), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(2).take(row),
                 pa.concat_arrays([pa.nulls(len(sizes), pa.binary()), pa.array(names, pa.binary()).take(pa.array(number))]),
                 *[pa.array(np.append(a, b)) for a, b in (
                     (none, times), (none, spelled[number]), (none + 1, zero), (sizes, zero), (np.add.reduceat(known, at), zero),
                     (np.add.reduceat(first, at), zero.astype(float)), (np.add.reduceat(second, at), zero.astype(float)))]],
                names=["doc_id", "text_hash", "word", "times", "class", "rows", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        local, f"doc_id {kind}, text_hash long, word binary, times long, class long, rows long, n_tokens long, "
        "n_known long, base_score double, score double")
    rows = written(rows, "lm-rows")
    sums = ["rows", "n_tokens", "n_known", "base_score", "score"]
    rare = rows.where("word is not null").join(others, "word", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    smoothed = F.log10(count + F.lit(0.5))
    denominator = F.get(F.array(*[F.lit(float(d)) for d in model.denominators]), F.col("class").cast("int"))
    rare = rare.select(
        "doc_id", "text_hash", "rows", "n_tokens", F.when(count > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * (smoothed - F.lit(model.base))).alias("base_score"),
        (F.col("times") * (smoothed - denominator)).alias("score"))
    whole = rows.where("word is null").select("doc_id", "text_hash", *sums).unionByName(rare)
    whole = whole.groupBy("doc_id", "text_hash").agg(*[F.sum(c).alias(c) for c in sums])
    # rows that repeat were summed together: each gets its share
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return whole.select("doc_id", *[(F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")],
                        *[(F.col(c) / F.col("rows")).alias(c) for c in ("base_score", "score")])


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows that are not held out.

    A null text counts as empty: one END token.  Repeated rows and null ids each get a row; without any training row
    all counts are zero; extra columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession, rows=500)
    model, others = trained(docs.where(fold("doc_id", 5) != 1))
    out = scored(docs, model, others)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
