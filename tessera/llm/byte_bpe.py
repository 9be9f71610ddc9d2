"""Byte-level BPE encoding and decoding by ranks, in time linear in the text.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token that
occurs in a match of the split pattern, in one pass.  Encoding starts with the longest token at each place and steps
back to shorter ones: a row of tokens is what merging by ranks gives if and only if each two neighbours are what
merging gives for their own bytes, and whether two tokens are is remembered.  A place from which no row goes on is
never entered again, so each place is left at most once.

Two neighbours are compatible if no merge crosses their seam.  That is found by taking back the merges of both sides,
the later one first: what stands at the seam at each time must not be a pair that would have been merged then.
"""

from __future__ import annotations

import base64
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Remembered, bounded_batches, free_name, schema_with, texts_of, words_of

REMEMBERED = 250_000  # words, and matches, that a worker keeps of late and as many from before
REMEMBERED_PAIRS = 1_000_000  # pairs of tokens a worker keeps
MEMO_BITS = 20  # of the number of places for pairs in the arrays' memory
SIDE_BY_SIDE = 64  # bytes; longer matches are encoded one by one
SEAM = "\u0100"  # stands for no byte
STATE = "_tessera_worker_state"


class Ranks:
    """A vocabulary of ranked tokens: how each is made, what it begins with, and which may stand side by side."""

    def __init__(self, lines: list[bytes]):
        import ahocorasick

        self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all 256 bytes")
        self.halves = {rank: self._halves(token) for rank, token in self.tokens.items()}
        self.made = {pair: rank for rank, pair in self.halves.items() if pair}
        self.top = 1 + max(self.tokens)
        self.lengths = [len(self.tokens.get(rank, b"")) for rank in range(self.top)]
        self.shorter = [self._shorter(self.tokens.get(rank, b"")) for rank in range(self.top)]
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        # the same as arrays
        self._length, self._shorter_id = np.array(self.lengths), np.array([-1 if s is None else s for s in self.shorter])
        split = [self.halves.get(rank) or (-1, -1) for rank in range(self.top)]
        self._left, self._right = (np.array(half, np.int64) for half in zip(*split))
        made = sorted((a * self.top + b, rank) for (a, b), rank in self.made.items())
        self._made, self._made_rank = (np.array([*v, t], np.int64) for v, t in zip(zip(*made), (1 << 62, self.top)))
        self._memo, self._memo_fits = np.full(1 << MEMO_BITS, -1, np.int64), np.zeros(1 << MEMO_BITS, bool)

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that the last merge inside ``token`` joins; None for a byte."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            ranked = [(self.ids.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(ranked)
            if rank == 1 << 60:
                raise ValueError(f"merges don't lead to the token {token!r}")
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None

    def _shorter(self, token: bytes) -> int | None:
        """The longest token that ``token`` begins with, itself aside."""
        return next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), None)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        found = self._fits.get(left * self.top + right)
        if found is None:
            if len(self._fits) >= REMEMBERED_PAIRS:
                self._fits.clear()
            found = self._fits[left * self.top + right] = self._seam_holds(left, right)
        return found

    def _seam_holds(self, left: int, right: int) -> bool:
        until = self.top  # merges from this rank on come too late for what stands at the seam
        while True:
            joined = self.made.get((left, right))
            if joined is not None and joined < until:
                return False
            before, after = self.halves[left], self.halves[right]
            if before is None and after is None:
                return True
            if after is None or (before is not None and left > right):
                until, left = left, before[1]
            else:  # of equal ranks the one on the left goes first, so a merge across the seam comes before the right's
                until, right = right + 1, after[0]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), len(piece)
        lengths, shorter, top, known = self.lengths, self.shorter, self.top, self._fits
        greedy = [rank for _, rank in self.automaton.iter_long(text)]  # the longest token at each place in turn
        out, at = [], 0
        for token in greedy:  # as far as neighbours fit
            if out and not self.fits(out[-1], token):
                break
            out.append(token)
            at += lengths[token]
        if at == size:
            return out
        longest = [0] * size
        for end, rank in self.automaton.iter(text):
            longest[end - lengths[rank] + 1] = rank  # a later end is a longer token
        closed = bytearray(size + 1)
        while True:
            # the longest token that leads to an open place and fits its neighbour
            last = out[-1] if out else None
            while token is not None:
                if not closed[at + lengths[token]]:
                    if last is None:
                        break
                    fit = known.get(last * top + token)
                    if self.fits(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token is None:  # nothing goes on from here: take the last token back and try what it begins with
                closed[at] = 1
                token = out.pop()
                at -= lengths[token]
            else:
                out.append(token)
                at += lengths[token]
                if at == size:
                    return out
                token = longest[at]


    def fits_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs; each pair has one place in the memory, the last one met there stays."""
        key = left * self.top + right
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        new = np.flatnonzero(self._memo[place] != key)
        out = self._memo_fits[place]
        if len(new):
            out[new] = self._seams_hold(left[new], right[new])
            self._memo[place[new]], self._memo_fits[place[new]] = key[new], out[new]
        return out

    def _seams_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_seam_holds`` of many pairs, step by step."""
        out, rows = np.zeros(len(left), bool), np.arange(len(left))
        until = np.full(len(left), self.top)
        while len(rows):
            key = left * self.top + right
            at = np.searchsorted(self._made, key)
            on = ~((self._made[at] == key) & (self._made_rank[at] < until))
            before, after = self._right[left], self._left[right]
            out[rows[on & (before < 0) & (after < 0)]] = True
            on &= (before >= 0) | (after >= 0)
            undo = (after < 0) | ((before >= 0) & (left > right))
            until = np.where(undo, left, right + 1)[on]
            left, right = np.where(undo, before, left)[on], np.where(undo, right, after)[on]
            rows = rows[on]
        return out

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        """``encode`` of many matches, as unsigned 32-bit integers: all of them step side by side, long ones by themselves."""
        out: list[bytes] = [b""] * len(pieces)
        lanes, texts = [], []
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            whole = self.ids.get(raw)
            if whole is not None or len(raw) > SIDE_BY_SIDE:
                out[k] = array("I", [whole] if whole is not None else self.encode(raw)).tobytes()
            else:
                lanes.append(k)
                texts.append(raw.decode("latin-1"))
        if not lanes:
            return out
        text = SEAM.join(texts) + SEAM  # every piece has one place more than bytes: its end
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.append(0, stops[:-1] + 1)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        longest = np.full(len(text), -1, np.int64)
        longest[found[:, 0] - self._length[found[:, 1]] + 1] = found[:, 1]  # a later end is a longer token, and stays
        chosen, came = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
        closed = np.zeros(len(text), bool)
        at, stop, last, token = starts, stops, np.full(len(starts), -1), longest[starts]
        while len(at):
            none = token < 0
            if none.any():  # nothing goes on from there: take the last token back and try what it begins with
                rows = np.flatnonzero(none)
                closed[at[rows]] = True
                at[rows] = came[at[rows]]
                token[rows] = self._shorter_id[chosen[at[rows]]]
                chosen[at[rows]] = -1
                last[rows] = np.where(came[at[rows]] >= 0, chosen[came[at[rows]]], -1)
                continue
            end = at + self._length[token]
            good = ~closed[end]
            pair = np.flatnonzero(good & (last >= 0))
            good[pair] = self.fits_all(last[pair], token[pair])
            chosen[at[good]], came[end[good]] = token[good], at[good]
            at, last = np.where(good, end, at), np.where(good, token, last)
            token = np.where(good, longest[at], self._shorter_id[token])
            on = at < stop
            at, stop, last, token = at[on], stop[on], last[on], token[on]
        ids = chosen[chosen >= 0].astype(np.uint32).tobytes()
        before = np.append(0, np.cumsum(chosen >= 0))
        for k, s, e in zip(lanes, (4 * before[starts]).tolist(), (4 * before[stops]).tolist()):
            out[k] = ids[s:e]
        return out


class ByteCodec:
    """A file of ranks and a split pattern, loaded where they are first used; a job carries path and pattern only.

    In a text whose white space is single spaces and line ends between words, a match ends before each of these, so words
    are encoded once each, with the space or line end before them, as long as they are remembered.  Any other text is
    split by the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._loaded = path, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _load(self) -> tuple:
        import regex

        kept = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__
        if (self.path, self.pattern) not in kept:
            with open(self.path, "rb") as file:
                ranks = Ranks(file.read().splitlines())
            kept[self.path, self.pattern] = (ranks, regex.compile(self.pattern), Remembered(REMEMBERED), Remembered(REMEMBERED))
        self._loaded = kept[self.path, self.pattern]
        return self._loaded

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as unsigned 32-bit integers."""
        ranks, pattern, pieces, words = self._loaded or self._load()
        split = [words_of(t) for t in texts]
        own = [pattern.findall(t if first is None else first) for t, (first, _) in zip(texts, split)]
        new = words.unknown(set().union(*(rest for _, rest in split)))
        # all new words in one pass: each begins with a space or line end, and holds no other white space
        matches = pattern.findall("".join([w if w[0] == "\n" else f" {w}" for w in new]))
        missing = pieces.unknown(set(matches).union(*own))
        pieces.add(list(zip(missing, ranks.encode_all(missing))))
        ids = [pieces.now[m] for m in matches]
        starts = [k for k, m in enumerate(matches) if m[0] in " \n"] + [len(matches)]
        words.add([(w, b"".join(ids[s:e])) for w, s, e in zip(new, starts, starts[1:])])
        out = [b"".join([*map(pieces.now.__getitem__, ms), *map(words.now.__getitem__, rest)]) for ms, (_, rest) in zip(own, split)]
        pieces.turn()
        words.turn()
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        tokens = (self._loaded or self._load())[0].tokens
        return b"".join(map(tokens.__getitem__, ids.tolist()))


def byte_bpe_encoded(docs: DataFrame, path: str, pattern: str, ids_name: str = "ids",
                     bytes_name: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each whole text (array of int) and the bytes that the ids decode to.

    ``path`` is a file of base64 tokens and ranks, ``pattern`` the regular expression whose matches are encoded one by
    one; special tokens in a text are ordinary text.  Null and empty texts have no ids and decode to no bytes.
    Repeated rows, null ids and extra columns are kept as they are (columns named ``ids`` or ``decoded`` keep their names,
    the new ones get a longer one).  Texts are never cut; no row meets another, so no key is hot.
    """
    bounded_batches(docs.sparkSession, rows=64, size="2m")
    codec = ByteCodec(path, pattern)
    ids_name, bytes_name = free_name(docs, ids_name), free_name(docs, bytes_name)
    at = docs.columns.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(i, np.uint32) for i in codec.encoded(texts_of(batch, at))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                 pa.array([codec.decoded(i) for i in ids], pa.binary())],
                names=[*batch.schema.names, ids_name, bytes_name])

    return docs.mapInArrow(encode, schema_with(docs, ids_name, "array<int>").add(bytes_name, "binary"))
