"""Alignment of two tokenizers' tokens by interval coalescing, and how often token ids are linked across documents.

Tokens of both tokenizers are byte intervals of one text.  Sorted by start (lexsort), with the running maximum of their
ends (maximum.accumulate), a group ends wherever a start reaches that maximum: up to there all tokens of either side
have ended.  Inside a group every token of A is linked with every token of B.

A text whose white space is single spaces and line ends falls into words at which both tokenizers have a cut, so no group
reaches over a word's edge: words are encoded and aligned once each, all new words of a batch side by side, as long as
they are remembered.  Any other text is one such piece by itself.

A linked pair's count is the number of documents that hold it.  The most frequent pairs (at most ``HOT``, of a bounded
size) are looked up in a broadcast table; all others meet their counts in a join, where no key has more rows than the
bound on their counts.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, bounded_batches, free_name, texts_of, words_of, written

REMEMBERED = 150_000  # words that a worker keeps of late, and as many from before
HOT = 1 << 19  # linked pairs in the broadcast table
CROWDED = 4096  # links of a group beyond which its pairs are counted before they are written out
STATE = "_tessera_worker_state"
SPACE = "▁"  # a piece's sign for a space


def _byte_of() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: printable Latin-1 for itself, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def _sums(values: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """The values' sums by the lists they stand for."""
    total = np.append(0, np.cumsum(values))
    return np.diff(total[np.cumsum([0, *map(len, lists)])])


class TwoTokenizers:
    """A byte-level BPE file (A) and a sentence piece model (B), loaded where they are first used."""

    def __init__(self, a_path: str, b_path: str):
        self.a_path, self.b_path, self._loaded = a_path, b_path, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    @property
    def loaded(self) -> types.SimpleNamespace:
        if self._loaded is None:
            kept = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__
            if (self.a_path, self.b_path) not in kept:
                kept[self.a_path, self.b_path] = self._load()
            self._loaded = kept[self.a_path, self.b_path]
        return self._loaded

    def _load(self) -> types.SimpleNamespace:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        a = Tokenizer.from_file(self.a_path)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte_of, vocabulary = _byte_of(), a.get_vocab()
        a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        b = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # no piece goes on over a space or line end, so words may be encoded by themselves
        by_word = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        return types.SimpleNamespace(
            a=a, b=b, a_bytes=a_bytes, b_bytes=b_bytes, a_len=np.array([len(x) for x in a_bytes]),
            b_len=np.array([len(x) for x in b_bytes]), by_word=by_word, words=Remembered(REMEMBERED))

    @property
    def width(self) -> int:
        """A pair of ids (a, b) is the number a * width + b."""
        return len(self.loaded.b_bytes)

    def encoded(self, texts: list[str], words: bool) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A, ids of B and whether both give back the text, of words or whole texts.

        A word that begins with a line end follows another; all else has a space before it (which B adds itself).
        """
        at = self.loaded
        follows = [words and t[0] == "\n" for t in texts]
        full = [t if f else f" {t}" for t, f in zip(texts, follows)]
        a = [e.ids for e in at.a.encode_batch_fast(full, add_special_tokens=False)]
        b = [ids[1:] if f else ids for ids, f in zip(at.b.encode(texts, num_threads=1), follows)]
        raw = [f.encode() for f in full]
        joined = b"".join(raw)
        # a text is given back if it is wherever the texts before it are: compared one by one only if not all are
        if all(b"".join(map(table.__getitem__, chain.from_iterable(x))) == joined for table, x in ((at.a_bytes, a), (at.b_bytes, b))):
            size = np.array(list(map(len, raw)))
            if all((_sums(table[_flat(x)], x) == size).all() for table, x in ((at.a_len, a), (at.b_len, b))):
                return a, b, [True] * len(raw)
        same = [b"".join(map(at.a_bytes.__getitem__, x)) == r == b"".join(map(at.b_bytes.__getitem__, y))
                for x, y, r in zip(a, b, raw)]
        return a, b, same

    def aligned(self, texts: list[str], words: bool) -> list[tuple | None]:
        """Per word or whole text: four counts (tokens of A and B, groups, links), the groups as text, linked pairs, and linked pairs
        of crowded groups with their number; None where the tokens don't give back the text."""
        at = self.loaded
        a, b, same = self.encoded(texts, words)
        good = [k for k, s in enumerate(same) if s]
        out: list[tuple | None] = [None] * len(texts)
        if not good:
            return out
        sides = [a, b] if len(good) == len(texts) else [[x[k] for k in good] for x in (a, b)]
        ids = [_flat(side) for side in sides]
        ends = [np.cumsum(table[i]) for table, i in zip((at.a_len, at.b_len), ids)]
        starts = [e - table[i] for e, table, i in zip(ends, (at.a_len, at.b_len), ids)]
        side = np.repeat([0, 1], [len(i) for i in ids])
        start, end, ids = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        group = np.empty(len(ids), np.int64)
        group[order] = np.append(0, np.cumsum(start[order][1:] >= reach[:-1]))
        order = np.lexsort((start, side, group))  # group by group, A before B
        group, side, ids = group[order], side[order], ids[order]
        n = int(group[-1]) + 1
        n_a, n_b = np.bincount(group[side == 0], minlength=n), np.bincount(group[side == 1], minlength=n)
        first = np.append(0, np.cumsum(n_a + n_b))  # of each group, in the order of tokens
        # pieces begin where a group does: their tokens follow one another
        tokens = np.cumsum([0, *map(add, map(len, sides[0]), map(len, sides[1]))])
        edge = np.searchsorted(first, tokens)
        # links of ordinary groups, pair by pair
        links = n_a * n_b
        plain = links <= CROWDED
        from_a = np.flatnonzero((side == 0) & plain[group])
        times = n_b[group[from_a]]
        pair_a = np.repeat(from_a, times)
        nth = np.arange(len(pair_a)) - np.repeat(np.cumsum(times) - times, times)
        g = group[pair_a]
        pairs = ids[pair_a] * len(at.b_bytes) + ids[first[g] + n_a[g] + nth]
        ends_of = (8 * np.append(0, np.cumsum(np.where(plain, links, 0)))[edge]).tolist()
        after = np.where(group[1:] != group[:-1], ";", np.where(side[1:] != side[:-1], "|", ","))
        after[tokens[1:-1] - 1] = "\n"  # between pieces
        written_out = "".join(map(add, map(str, ids.tolist()), [*after.tolist(), ""])).split("\n")
        counts = np.add.reduceat(np.stack([n_a, n_b, np.ones(n, np.int64), links], 1), edge[:-1], axis=0)
        crowded = np.flatnonzero(~plain)
        owner = np.searchsorted(edge, crowded, side="right") - 1
        heavy: dict[int, list] = {}
        for c, o in zip(crowded.tolist(), owner.tolist()):
            mid = first[c] + n_a[c]
            (x, nx), (y, ny) = (np.unique(i, return_counts=True) for i in (ids[first[c]:mid], ids[mid:first[c + 1]]))
            heavy.setdefault(o, []).append(((x[:, None] * len(at.b_bytes) + y).ravel(), (nx[:, None] * ny).ravel()))
        counts, pairs = counts.tobytes(), pairs.tobytes()
        for j, (k, groups, low, high) in enumerate(zip(good, written_out, ends_of, ends_of[1:])):
            out[k] = counts[32 * j:32 * j + 32], groups, pairs[low:high], heavy.get(j)
        return out

    def documents(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Per whole text: the four counts, the groups as text, the distinct linked pairs and how often each is linked."""
        none = np.zeros(0, np.int64)
        at = self.loaded
        split = [words_of(t) if at.by_word else (None, []) for t in texts]
        split = [None if first is None else [first, *rest] for first, rest in split]
        new = at.words.unknown(set().union(*filter(None, split)))
        at.words.add(list(zip(new, self.aligned(new, True) if new else [])))
        for text, words in zip(texts, split):
            if not text:
                found: list = [None]
            elif words is None:
                found = self.aligned([text], False)
            else:
                found = list(map(at.words.now.__getitem__, words))
            if None in found:
                yield np.zeros(4, np.int64), "", none, none
                continue
            counts, groups, pairs, heavy = zip(*found)
            pair, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
            more = [h for hs in heavy if hs for h in hs]
            if more:
                both = np.concatenate([pair, *[p for p, _ in more]]), np.concatenate([times, *[t for _, t in more]])
                pair, at_pair = np.unique(both[0], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at_pair, both[1])
                times = total
            yield np.frombuffer(b"".join(counts), np.int64).reshape(-1, 4).sum(0), ";".join(groups), pair, times
        at.words.turn()


def aligned(docs: DataFrame, tokenizers: TwoTokenizers) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times of every row.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3`` (ids of A and B in order); ``pairs`` are the distinct linked pairs of ids in
    ascending order, as a * width + b, ``times`` how often each is linked.  Null and empty texts, and texts that either
    side's tokens don't give back, have no tokens: zeros, an empty text and no pairs.  Repeated rows and null ids each
    get a row; extra columns are not read; an empty table gives no rows.  Texts are never cut.
    """
    bounded_batches(docs.sparkSession, rows=64, size="2m")
    kind = docs.schema["doc_id"].dataType.simpleString()
    code = "int" if len(tokenizers.loaded.a_bytes) * tokenizers.width < 1 << 31 else "long"
    as_code = pa.int32() if code == "int" else pa.int64()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(tokenizers.documents(texts_of(batch, 1)))
            counts = np.stack([c for c, _, _, _ in got]) if got else np.zeros((0, 4), np.int64)
            stops = pa.array(np.cumsum([0, *[len(p) for _, _, p, _ in got]]), pa.int32())
            lists = [pa.ListArray.from_arrays(stops, pa.array(np.concatenate([np.zeros(0, np.int64), *x]), t))
                     for x, t in (([p for _, _, p, _ in got], as_code), ([t for _, _, _, t in got], pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts.T), pa.array([g for _, g, _, _ in got], pa.string()), *lists],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(
        align, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<{code}>, times array<long>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked, and whether no pair of the same A id is in more."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy(F.col("pair").cast("long").alias("pair")).agg(F.count("*").alias("n")), "align-counts")
    a = F.floor(F.col("pair") / F.lit(width)).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    out = counts.select("pair", "n", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return written(out, "align-pairs")


def with_link_counts(rows: DataFrame, width: int, hot: int = HOT) -> DataFrame:
    """``rows`` (of ``aligned``, written out) without pairs and times, but with n_best and count_sum.

    n_best: links whose pair is in as many rows as any pair of its A id; count_sum: the pairs' counts, summed over links.
    """
    spark = rows.sparkSession
    key, best_name, sum_name = free_name(rows, "row"), free_name(rows, "n_best"), free_name(rows, "count_sum")
    rows = written(rows.withColumn(key, F.monotonically_increasing_id()), "align-rows")  # ids stay once written
    counts = pair_counts(rows, width)
    # the least power of two that at most ``hot`` pairs reach
    by_size = sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect(), reverse=True)
    least, reached = None, 0
    for e, n in by_size:
        if (reached := reached + n) > hot:
            break
        least = e
    often = counts.where(F.col("n") >= F.lit(2 ** least)) if least is not None else counts.limit(0)
    table = often.orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(np.append(table.column(k).to_numpy(), end) for k, end in ((0, 1 << 62), (1, 0), (2, False))))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            own, lists, times = batch.columns
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(own.to_numpy(), size)
            lists, times = lists.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()
            at = np.searchsorted(pair, lists)
            hit = pair[at] == lists
            place = np.repeat(np.arange(len(size)), size)
            sums = np.zeros((2, len(size)), np.int64)
            for k, v in enumerate((best[at], n[at])):
                np.add.at(sums[k], place[hit], (v * times)[hit])
            cold = ~hit
            none, blank = pa.nulls(len(size), pa.int64()), pa.nulls(int(cold.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([own, none, none, *map(pa.array, sums)], names=["row", "pair", "times", "best", "sum"])
            yield pa.RecordBatch.from_arrays([pa.array(owner[cold]), pa.array(lists[cold]), pa.array(times[cold]), blank, blank],
                                             names=["row", "pair", "times", "best", "sum"])

    parts = written(rows.select(key, "pairs", "times").mapInArrow(look_up, "row long, pair long, times long, best long, sum long"),
                    "align-parts")
    cold = parts.where("pair is not null").select("row", "pair", "times").join(counts, "pair").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("best"), (F.col("n") * F.col("times")).alias("sum"))
    sums = parts.where("pair is null").select("row", "best", "sum").unionByName(cold).groupBy(F.col("row").alias(key)).agg(
        F.sum("best").alias(best_name), F.sum("sum").alias(sum_name))
    return rows.drop("pairs", "times").join(sums, key).drop(key)
