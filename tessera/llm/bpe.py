"""BPE encoding and decoding with a tokenizer file; long texts are encoded in halves and joined as a tree.

A text over ``LONG`` characters is cut blindly into leaves, which Spark encodes in parallel.  Joins then go up the tree:
around each cut a window of the text is encoded anew and grows until it agrees with both sides, which means that on
either side of the cut, a little away from it, a word of the window ends where a word of that side ends.  Words are
scanned from left to right, so from such a common end on, both encodings of the same text are the same: the left side
up to its common end, the window's tokens and the right side from its common end on are the encoding of the whole.  If
the window has grown over both sides, its encoding is taken as it is.
"""

from __future__ import annotations

import os
import struct
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, free_name, schema_with, texts_of

LONG = 1 << 15  # characters; longer texts are split
LEAF = 1 << 14
REMEMBERED = 600_000
STATE = "_tessera_worker_state"
MARGIN = 32  # characters next to a cut where no common end is sought (marks compose and special tokens match across it)
WINDOW = 128  # characters on either side of a cut, at first


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """A tokenizer file, loaded where it is first used; a job carries its path only.

    ``drops_space``: the tokenizer drops white space, so no token or rule reaches over a space, and the words between
    spaces can be encoded by themselves: each once, as long as it is remembered (``REMEMBERED`` words at most).
    """

    def __init__(self, path: str, drops_space: bool):
        self.path, self.drops_space, self._loaded, self._words = path, drops_space, None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None, "_words": {}}

    def _load(self) -> None:
        """The tokenizer and the words a Python worker keeps between its tasks."""
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__
        if (self.path, self.drops_space) not in kept:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
            found = Tokenizer.from_file(self.path)
            found.no_truncation()
            found.no_padding()
            kept[self.path, self.drops_space] = (found, {})
        self._loaded, self._words = kept[self.path, self.drops_space]

    @property
    def tokenizer(self):
        if self._loaded is None:
            self._load()
        return self._loaded

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if not self.drops_space:
            return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        tokenizer, known = self.tokenizer, self._words
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = list({w for p in parts for w in p if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for p in parts for w in p})
        for s in range(0, len(new), 4096):
            some = new[s:s + 4096]
            known.update(zip(some, (_packed(e.ids) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decoded(self, ids: list[bytes]) -> list[str]:
        return [self.tokenizer.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in ids]


def word_ends(encoding) -> np.ndarray:
    """For each token, the place in the text where its word ends if the token ends the word, else -1."""
    words = [*encoding.word_ids, object()]
    return np.array([e if words[k + 1] != words[k] else -1 for k, (_, e) in enumerate(encoding.offsets)], np.int64)


@dataclass
class Piece:
    """A stretch of text: its ids, and the places (in the whole text) where the words of its first and last tokens
    end: -1 for a token inside a word.  ``head`` and ``tail`` may cover a few tokens only or all of them."""

    start: int
    stop: int
    ids: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    @classmethod
    def whole(cls, codec: Codec, text: str, start: int) -> Piece:
        """With the word ends of all tokens."""
        got = codec.tokenizer.encode(text, add_special_tokens=False)
        ends = word_ends(got)
        ends[ends >= 0] += start
        return cls(start, start + len(text), np.array(got.ids, np.uint32), ends, ends)

    @classmethod
    def leaf(cls, codec: Codec, text: str, start: int) -> Piece:
        """With the word ends near its edges, from encodings of the edges alone.

        Those count as far as they hold the same ids as the leaf: equal tokens from the same edge on cover the same text.
        """
        ids = np.frombuffer(codec.encoded([text])[0], "<u4")
        head = cls.whole(codec, text[:2 * WINDOW], start)
        at = max(0, len(text) - 2 * WINDOW)
        tail = cls.whole(codec, text[at:], start + at)
        n, m = min(len(ids), len(head.ids)), min(len(ids), len(tail.ids))
        same = int(np.argmin(np.append(ids[:n] == head.ids[:n], False)))
        last = int(np.argmin(np.append((ids[len(ids) - m:] == tail.ids[len(tail.ids) - m:])[::-1], False)))
        return cls(start, start + len(text), ids, head.head[:same], tail.tail[len(tail.ids) - last:])

    @property
    def complete(self) -> bool:
        return len(self.head) == len(self.ids) == len(self.tail)

    def kept_until(self, end: int) -> int:
        """Number of tokens up to a word end near the right edge."""
        return len(self.ids) - len(self.tail) + int(np.flatnonzero(self.tail == end)[-1]) + 1

    def skipped_until(self, end: int) -> int:
        """Number of tokens up to a word end near the left edge."""
        return int(np.flatnonzero(self.head == end)[-1]) + 1


def joined(codec: Codec, text: str, left: Piece, right: Piece) -> Piece:
    """The encoding of two neighbouring stretches as one; ``text`` is the whole text."""
    cut, reach = left.stop, WINDOW
    while cut - reach > left.start or cut + reach < right.stop:
        if reach > WINDOW:  # the edges were not enough
            left, right = (p if p.complete else Piece.whole(codec, text[p.start:p.stop], p.start) for p in (left, right))
        lo, hi = max(left.start, cut - reach), min(right.stop, cut + reach)
        window = Piece.whole(codec, text[lo:hi], lo)
        # the window's own edges are cuts too: its ends near them don't count, unless they are the stretch's edges
        low = lo if lo == left.start else lo + MARGIN
        high = hi + 1 if hi == right.stop else hi - MARGIN
        common = [np.intersect1d(e[(e > f) & (e < t)], window.head)
                  for e, f, t in ((left.tail, low, cut - MARGIN), (right.head, cut + MARGIN, high))]
        if len(common[0]) and len(common[1]):
            a, b = common[0].max(), common[1].min()
            n, skip = left.kept_until(a), right.skipped_until(b)
            f, t = window.skipped_until(a), window.skipped_until(b)
            head = left.head[:n] if len(left.head) < n else np.concatenate([left.head[:n], window.head[f:t], right.head[skip:]])
            rest = len(right.ids) - skip
            tail = right.tail[-rest:] if len(right.tail) < rest else np.concatenate(
                [left.tail[:len(left.tail) - (len(left.ids) - n)], window.head[f:t], right.tail[len(right.tail) - rest:]])
            return Piece(left.start, right.stop, np.concatenate([left.ids[:n], window.ids[f:t], right.ids[skip:]]), head, tail)
        reach *= 2
    return Piece.whole(codec, text[left.start:right.stop], left.start)


def tree_joined(codec: Codec, text: str, pieces: list[Piece]) -> np.ndarray:
    """Ids of the whole text from its leaves, joined two by two, level by level."""
    while len(pieces) > 1:
        pieces = [joined(codec, text, *pieces[k:k + 2]) if k + 1 < len(pieces) else pieces[k]
                  for k in range(0, len(pieces), 2)]
    return pieces[0].ids if pieces else np.zeros(0, np.uint32)


def _long_ids(long: DataFrame, codec: Codec) -> DataFrame:
    """(key, ids) of the distinct long texts; key is their sha256.  Leaves are dealt by text and place."""
    n = F.ceil(F.char_length("text") / F.lit(LEAF)).cast("int")
    leaves = long.select(F.sha2(F.col("text"), 256).alias("key"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    leaves = leaves.select("key", "at", F.substring("text", F.col("at") * LEAF + 1, F.lit(LEAF)).alias("leaf"))
    leaves = leaves.groupBy("key", "at").agg(F.first("leaf").alias("leaf"))  # repeated texts are encoded once

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Piece.leaf(codec, t, k * LEAF) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([getattr(p, f).tobytes() for p in got], pa.binary()) for f in ("ids", "head", "tail")]],
                names=["key", "at", "leaf", "ids", "head", "tail"])

    encoded = leaves.mapInArrow(encode, "key string, at int, leaf string, ids binary, head binary, tail binary")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        pieces = [Piece(r["at"] * LEAF, r["at"] * LEAF + len(r["leaf"]), np.frombuffer(r["ids"], np.uint32),
                        np.frombuffer(r["head"], np.int64), np.frombuffer(r["tail"], np.int64)) for r in rows]
        ids = tree_joined(codec, "".join(r["leaf"] for r in rows), pieces)
        return pa.table({"key": [rows[0]["key"]], "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    return encoded.groupBy("key").applyInArrow(join, "key string, ids binary")


def bpe_encoded(docs: DataFrame, path: str, drops_space: bool = True, ids_name: str = "ids",
                text_name: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each whole text (little-endian unsigned 32-bit integers) and their decoded text.

    As the tokenizer file says, no special tokens added, no truncation, no padding; special tokens in a text are
    found and decoded like any other.  Null and empty texts have no ids and decode to the empty text.  Repeated
    rows, null ids and extra columns are kept as they are.
    """
    bounded_batches(docs.sparkSession, rows=64, size="2m")
    codec = Codec(path, drops_space)
    ids_name = free_name(docs, ids_name)
    text_name = free_name(docs, text_name)
    at = docs.columns.index("text")
    is_long = F.coalesce(F.char_length("text") > LONG, F.lit(False))
    schema = schema_with(docs, ids_name, "binary").add(text_name, "string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = codec.encoded(texts_of(batch, at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), pa.array(codec.decoded(ids), pa.string())],
                names=[*batch.schema.names, ids_name, text_name])

    short = docs.where(~is_long).mapInArrow(encode, schema)
    key = free_name(docs, "text_sha256")
    long = docs.where(is_long)
    found = _long_ids(long, codec).withColumnsRenamed({"key": key, "ids": ids_name})
    found = long.withColumn(key, F.sha2(F.col("text"), 256)).join(found, key).select(*docs.columns, ids_name)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.decoded(ids), pa.string())],
                                             names=[*batch.schema.names, text_name])

    return short.unionByName(found.mapInArrow(decode, schema))
