"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are the query set, taken in blocks of about ``BLOCK`` items; each block goes against all documents.
Features are the block's words, weighted by their inverse document frequency over the whole corpus.  A randomised SVD of
TF-IDF passages (items, and all passages of ``PASSAGE`` words of all documents) is fitted in two distributed
passes: sums of A'(A R) give the range, sums of (A Q)'(A Q) the rotation.  Passages are windows as long as one and a half
times an item of their size class and half a class apart, so each item that occurs lies whole in some window.  The longest
common subsequence of words decides on copies, whatever else the window holds; a paraphrase needs the item's answer and a
latent cosine of ``COSINE`` too, over term counts damped by their logarithm.  Only windows are looked up that hold as many of an item's rarer words as the shortest subsequence that
counts must share (leave out as many words as may differ, and that many of the rest must be there): this loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, dropped, texts_of, written

BLOCK = 256  # items per pass over the corpus
RANK = 256  # latent dimensions at most
PASSAGE = 64  # words of a passage in the fit
ENTRIES = 1 << 14  # words of passages at a time
DENSE = 64  # passages of a full matrix over the words they hold
COSINE = 0.3  # of a paraphrase at least
COPY = 0.8  # share of an item's words in common order: a copy
PARAPHRASE = 0.6  # a paraphrase, if the answer is there too
ANSWER = 0.8  # share of the answer's words in common order
CERTAIN = 0.2  # share of an item's words that must be found among its rarest
SHORT = 8  # items of fewer words must occur word for word
#: ASCII other than letters and digits parts words.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(PLAIN).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence that has a word: where the item holds no answer of its own."""
    parts = [w for p in re.split(r"[.!?\n]+", text) if (w := item_words(p))]
    return parts[-1] if parts else []


def word_ids(vocabulary: dict[bytes, int], text: str) -> np.ndarray:
    """Id of each word, the vocabulary's size for words outside it."""
    words = item_words(text)
    return np.fromiter(map(vocabulary.get, words, repeat(len(vocabulary))), np.int32, len(words))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one machine word per 64 elements of ``a`` (bit-parallel)."""
    spots: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        spots[x] = spots.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := spots.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray

    @property
    def size(self) -> int:
        """The item's size class: a window is one and a half times as long."""
        return max(SHORT, 1 << (len(self.words) - 1).bit_length())


@dataclass
class Latent:
    """A block of items in the latent space."""

    vocabulary: dict[bytes, int]
    items: list[Item]
    weights: np.ndarray | None = None  # words + 1: inverse document frequency, 0 for words outside
    rows: np.ndarray | None = None  # words + 1, rank: weighted rows of the right singular vectors
    vectors: np.ndarray | None = None  # items, rank: of length 1
    first: np.ndarray | None = None  # of each word (and those outside) its first place in `owners`
    owners: np.ndarray | None = None  # items that have the word among their rarest
    needed: np.ndarray | None = None  # of each item how many of its rarest words a window must hold

    def index(self) -> None:
        """For each item, the rarest words of which any subsequence that counts holds at least ``needed``."""
        pairs, needed = [], []
        for k, item in enumerate(self.items):
            n = len(item.words)
            spared = n - int(np.ceil(PARAPHRASE * n)) if n >= SHORT else 0
            need = max(1, round(CERTAIN * n)) if n >= SHORT else n
            order = item.words[np.argsort(-self.weights[item.words], kind="stable")]
            pairs += [(w, k) for w in set(order[:spared + need].tolist())]
            needed.append(need)
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 2))
        self.owners, self.needed = pairs[:, 1].astype(np.int32), np.array(needed)

    def project(self, ids: list[np.ndarray]) -> np.ndarray:
        """Unit latent vectors of word sequences, a word that occurs n times weighing 1 + log n."""
        out = np.zeros((len(ids), self.rows.shape[1]), np.float32)
        for k, own in enumerate(ids):
            words, n = np.unique(own, return_counts=True)
            out[k] = (1 + np.log(n)).astype(np.float32) @ self.rows[words]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def windows(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, item, window start) that hold enough of the item's rarest words; all texts in one sweep."""
        sizes = np.array([i.size for i in self.items])
        gap = 2 * int(sizes.max())  # between texts, so that no window reaches over
        lengths = np.array([len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]])
        words = np.concatenate(texts)
        place = np.arange(len(words)) + np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        count = self.first[words + 1] - self.first[words]
        hit = np.flatnonzero(count)
        if not len(hit):
            return np.empty((0, 3), np.int64)
        count = count[hit]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owners[np.repeat(self.first[words[hit]], count) + offset]
        place = np.repeat(place[hit], count)
        order = np.argsort(item, kind="stable")  # places stay in order within an item
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.needed[item] - 1
        inside = last < len(item)
        last = np.minimum(last, len(item) - 1)
        size = sizes[item]
        inside &= (item[last] == item) & (place[last] - place < size + size // 2)
        item, low, high, size = item[inside], place[inside], place[last[inside]], size[inside]
        text = np.searchsorted(begin, low, "right") - 1
        step = size // 2
        out = []
        for back in range(3):  # the windows that hold both places
            start = (low - begin[text]) // step - back
            fits = (start >= 0) & (high - begin[text] < start * step + size + step)
            out.append(np.stack([text, item, start * step], 1)[fits])
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, texts: list[np.ndarray]) -> list[dict[int, tuple[float, float, bool]]]:
        """For each text, item number to (share of its words, cosine, whether its answer is there)."""
        found: list[dict[int, tuple[float, float, bool]]] = [{} for _ in texts]
        if not texts:
            return found
        for t, i, start in self.windows(texts).tolist():
            region = texts[t][start:start + self.items[i].size * 3 // 2]
            got = self.check(i, region)
            if got is not None and got[0] > found[t].get(i, (0,))[0]:
                cosine = float(self.project([region])[0] @ self.vectors[i])
                if got[0] >= COPY or cosine >= COSINE:
                    found[t][i] = (got[0], cosine, got[1])
        return found

    def check(self, number: int, region: np.ndarray) -> tuple[float, bool] | None:
        item = self.items[number]
        n = len(item.words)
        if n < SHORT:
            words, part = item.words.tolist(), region.tolist()
            return (1.0, True) if any(part[k:k + n] == words for k in range(len(part) - n + 1)) else None
        share = common_subsequence(item.words, region) / n
        if share < PARAPHRASE:
            return None
        answered = bool(len(item.answer)) and common_subsequence(item.answer, region) >= ANSWER * len(item.answer)
        return (share, answered) if share >= COPY or answered else None


def _vocabulary(rows: list) -> Latent:
    vocabulary: dict[bytes, int] = {}
    items = []
    for r in rows:
        words = item_words(r["text"])
        if words:
            ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in some], np.int32)
                   for some in (words, item_words(r["answer"]) if r["answer"] else answer_of(r["text"]))]
            items.append(Item(r["item_id"], *ids))
    return Latent(vocabulary, items)


def _numbered(docs: DataFrame, block: Latent) -> DataFrame:
    """The word ids of every text, as the bytes of 32-bit integers."""
    vocabulary = block.vocabulary

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [word_ids(vocabulary, t).tobytes() for t in texts_of(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return docs.select("text").mapInArrow(number, "ids binary")


def _ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(t, np.int32) for t in batch.column(0).to_pylist()]


def _weighted(numbered: DataFrame, block: Latent) -> Latent:
    """Inverse document frequencies of the block's words over all documents, given as word ids."""
    size = len(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for ids in _ids_of(batch):
                total += np.bincount(ids, minlength=size + 1) > 0
                n += 1
        total[size] = n  # in the place of other words: the documents
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["word", "n"])

    sums = numbered.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(size + 1)
    for r in sums:
        frequency[r["word"]] = r["n"]
    documents, frequency[size] = frequency[size], 0
    block.weights = np.log((documents + 1) / (frequency + 1)) + 0.05
    block.weights[size] = 0
    block.index()
    return block


def _passages(texts: list[np.ndarray], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The TF-IDF passages of the texts, some at a time: words, values, and where in them each passage begins.

    A passage is PASSAGE words of one text, of length 1; those without a word of the vocabulary are left out.
    """
    size = len(weights) - 1
    lengths = np.array([len(t) for t in texts], np.int64)
    words = np.concatenate([*texts, np.empty(0, np.int32)]).astype(np.int64)
    parts = -(-lengths // PASSAGE)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    number = np.repeat(np.cumsum(parts) - parts, lengths) + place // PASSAGE
    inside = words < size
    pair, n = np.unique(number[inside] * size + words[inside], return_counts=True)
    if not len(pair):
        return
    number, words = np.divmod(pair, size)
    head = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    values = (1 + np.log(n)) * weights[words]
    values /= np.repeat(np.sqrt(np.add.reduceat(values ** 2, head)), np.diff(np.append(head, len(pair))))
    step = max(1, ENTRIES // PASSAGE)
    for s in range(0, len(head), step):
        low, high = head[s], head[s + step] if s + step < len(head) else len(pair)
        yield words[low:high], values[low:high].astype(np.float32), head[s:s + step] - low


def _dense(words: np.ndarray, values: np.ndarray, head: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The passages as full matrices of ``DENSE`` rows, with the words of their columns."""
    edge = np.append(head, len(words))
    for s in range(0, len(head), DENSE):
        own = edge[s:s + DENSE + 1]
        columns, at = np.unique(words[own[0]:own[-1]], return_inverse=True)
        out = np.zeros((len(own) - 1, len(columns)), np.float32)
        out[np.repeat(np.arange(len(own) - 1), np.diff(own)), at] = values[own[0]:own[-1]]
        yield columns, out


def _spread(total: np.ndarray, words: np.ndarray, values: np.ndarray, head: np.ndarray, r: np.ndarray) -> None:
    """Add A'(A r) of the passages A to ``total``."""
    for columns, a in _dense(words, values, head):
        total[columns] += a.T @ (a @ r[columns])


def _rotated(total: np.ndarray, words: np.ndarray, values: np.ndarray, head: np.ndarray, q: np.ndarray) -> None:
    """Add (A q)'(A q) of the passages A to ``total``."""
    for columns, a in _dense(words, values, head):
        p = a @ q[columns]
        total += p.T @ p


def _summed(docs: DataFrame, block: Latent, step, r: np.ndarray, height: int, numbered: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """Sum of ``step`` over all passages of all documents, and their number: partial sums of a task, added up by strips.

    ``numbered`` are the documents' word ids, where they are at hand."""
    weights, wide, strip = block.weights, r.shape[1], 64
    rows = _numbered(docs, block) if numbered is None else numbered

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((height, wide)), 0
        for batch in batches:
            for words, values, head in _passages(_ids_of(batch), weights):
                step(total, words, values, head, r)
                n += len(head)
        if n:
            strips = range(0, height, strip)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(strips), pa.int32()), pa.array([total[s:s + strip].tobytes() for s in strips], pa.binary()),
                 pa.array([n if s == 0 else 0 for s in strips], pa.int64())], names=["strip", "total", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for s, total, n in zip(*[c.to_pylist() for c in batch.columns]):
                sums[s] = sums.get(s, 0) + np.frombuffer(total)
                count[s] = count.get(s, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([t.tobytes() for t in sums.values()], pa.binary()),
             pa.array(list(count.values()), pa.int64())], names=["strip", "total", "n"])

    kind = "strip int, total binary, n long"
    out, n = np.zeros((height, wide)), 0
    for row in rows.mapInArrow(part, kind).repartition("strip").mapInArrow(added, kind).collect():  # a row a strip
        out[row["strip"]:row["strip"] + strip] += np.frombuffer(row["total"]).reshape(-1, wide)
        n += row["n"]
    return out, n


def _fitted(docs: DataFrame, block: Latent, seed: int = 5) -> Latent:
    """Weights, and the randomised SVD of the TF-IDF passages of all documents and of the items (weighted to as much as the
    documents).  The documents' words are looked up once, and their ids written out for the three passes."""
    numbered = written(_numbered(docs, block), "latent-ids")
    _weighted(numbered, block)
    size, rng = len(block.vocabulary), np.random.default_rng(seed)
    rank = min(RANK, size)
    wide = min(size, rank + 8)
    own = list(_passages([i.words for i in block.items], block.weights))
    first = rng.normal(size=(size, wide)).astype(np.float32)
    y, n = _summed(docs, block, _spread, first, size, numbered)
    more = max(1.0, n / max(1, sum(len(head) for _, _, head in own)))
    items = np.zeros((size, wide))
    for words, values, head in own:
        _spread(items, words, values, head, first)
    q = np.linalg.qr(y + more * items)[0].astype(np.float32)
    c, _ = _summed(docs, block, _rotated, q, wide, numbered)
    dropped(numbered)
    items = np.zeros((wide, wide))
    for words, values, head in own:
        _rotated(items, words, values, head, q)
    vectors = q @ np.linalg.eigh(c + more * items)[1][:, ::-1][:, :rank]
    block.rows = np.concatenate([vectors * block.weights[:size, None], np.zeros((1, rank))]).astype(np.float32)
    block.vectors = block.project([i.words for i in block.items])
    return block


def blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Latent]:
    """The benchmark in fitted blocks; items without a word match nothing, repeated items count once."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text is not null").select("item_id", "text", answer.alias("answer")).distinct()
    parts = -(-items.count() // BLOCK)
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        block = _vocabulary(rows)
        if block.items:
            yield _fitted(docs, block)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, cosine, answered) for every document and item that is in it, copied or paraphrased.

    ``share`` is the part of the item's words found in order in one window.  Null and empty texts hold nothing; an
    empty benchmark or table gives an empty result; repeated rows give one pair; a null doc_id is kept as such;
    extra columns are not read (``answer`` of the benchmark is, if it is there).
    """
    bounded_batches(docs.sparkSession, rows=256)
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, number int, share double, cosine double, answered boolean"
    out = None
    for block in blocks(docs, benchmark):

        def search(batches: Iterator[pa.RecordBatch], block: Latent = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [word_ids(block.vocabulary, t) for t in texts_of(batch, 1)]
                rows = [(k, i, *m) for k, found in enumerate(block.matches(words)) for i, m in found.items()]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), *[pa.array([r[c] for r in rows], t) for c, t in
                     ((1, pa.int32()), (2, pa.float64()), (3, pa.float64()), (4, pa.bool_()))]],
                    names=["doc_id", "number", "share", "cosine", "answered"])

        names = docs.sparkSession.createDataFrame(
            [(k, i.item_id) for k, i in enumerate(block.items)], f"number int, item_id {kinds[1]}")  # a block's items
        found = docs.select("doc_id", "text").mapInArrow(search, schema).join(F.broadcast(names), "number").drop("number")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kinds[0]}, item_id {kinds[1]}, share double, cosine double, answered boolean")
    best = F.max(F.struct("share", "cosine", "answered")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.share", "b.cosine", "b.answered")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    bounded_batches(docs.sparkSession, rows=256)
    at, base = docs.columns.index("text"), docs
    for block in blocks(base, benchmark):

        def keep(batches: Iterator[pa.RecordBatch], block: Latent = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = block.matches([word_ids(block.vocabulary, t) for t in texts_of(batch, at)])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
