"""Token alignment and link counts against brute force over all links."""

from __future__ import annotations

import bisect
import collections
import random

import pytest
from fixtures import frame, odd_rows

from tessera.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a", "b ", "\n", " ", "  ", "\t", "é", "▁", "☃", "word", "<|endoftext|>", "<s>", "\x00", "\x1c", "　", "😀", "don't", "1234"]


class Brute:
    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        byte_of = alignment._byte_of()
        self.bytes_a = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, text):
        """Cut where tokens of both sides end."""
        if not text:
            return []
        ids = [self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)]
        raw = [[self.bytes_a[i] for i in ids[0]], [self.bytes_b(i) for i in ids[1]]]
        if not b"".join(raw[0]) == b"".join(raw[1]) == f" {text}".encode():
            return []
        ends = []
        for tokens in raw:
            at = 0
            ends.append([at := at + len(t) for t in tokens])
        cuts = sorted({*ends[0]} & {*ends[1]})
        at = [[bisect.bisect_right(e, c) for c in [0, *cuts]] for e in ends]  # tokens up to each cut
        return [tuple(ids[s][at[s][k]:at[s][k + 1]] for s in (0, 1)) for k in range(len(cuts))]

    def links(self, groups):
        out = collections.Counter()
        for a, b in groups:
            for (x, n), (y, m) in ((p, q) for p in collections.Counter(a).items() for q in collections.Counter(b).items()):
                out[x, y] += n * m
        return out

    @staticmethod
    def written(groups):
        return ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)


@pytest.fixture(scope="module")
def brute():
    return Brute()


def test_odd_texts(brute):
    """Words remembered or not, texts as a whole, groups of many tokens: the same as one text at a time."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["x" * 20_001, "\n", "\nab", " ", "ab " * 900, "one two\nthree four"]
    two = alignment.TwoTokenizers(A, B)
    for s in range(0, len(texts), 100):
        for text, (counts, groups, pairs, times) in zip(texts[s:s + 100], two.documents(texts[s:s + 100])):
            want = brute.groups(text)
            links = brute.links(want)
            assert counts.tolist() == [sum(len(g[0]) for g in want), sum(len(g[1]) for g in want), len(want), sum(links.values())]
            assert groups == brute.written(want)
            assert {divmod(p, two.width): n for p, n in zip(pairs.tolist(), times.tolist())} == links
            assert pairs.tolist() == sorted(pairs.tolist())


def test_crowded_groups_are_counted_first(brute, monkeypatch):
    monkeypatch.setattr(alignment, "CROWDED", 3)
    two = alignment.TwoTokenizers(A, B)
    two.loaded.words.now.clear()
    two.loaded.words.older = {}
    text = "internationalization of zzzzyyyxxxx tokenizers zzzzyyyxxxx"
    _, _, pairs, times = next(two.documents([text]))
    assert {divmod(p, two.width): n for p, n in zip(pairs.tolist(), times.tolist())} == brute.links(brute.groups(text))
    two.loaded.words.now.clear()


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_link_counts(spark, brute, hot):
    """All pairs broadcast, some, or none: the same counts."""
    rows = odd_rows() + [(900, "cards and ▁", "en")]
    two = alignment.TwoTokenizers(A, B)
    out = alignment.with_link_counts(alignment.aligned(frame(spark, rows), two), two.width, hot)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in out.collect()),
                 key=repr)
    groups = [brute.groups(t) for _, t, _ in rows]
    links = [brute.links(g) for g in groups]
    count = collections.Counter(pair for found in links for pair in found)
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    want = [(k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
             sum(n for p, n in found.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in found.items()), Brute.written(g))
            for (k, _, _), g, found in zip(rows, groups, links)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    two = alignment.TwoTokenizers(A, B)
    assert alignment.with_link_counts(alignment.aligned(frame(spark, []), two), two.width).count() == 0


def test_texts_that_only_together_give_back_theirs(monkeypatch):
    """All bytes in a row may be right while a text's own are not: each text is judged by itself, good ones stay."""
    two = alignment.TwoTokenizers(A, B)
    assert two.encoded(["one", "two", "\nx"], True)[2] == [True] * 3
    ids = two.encoded(["one two", "three"], False)
    moved = [ids[0][0] + ids[0][1][:1], ids[0][1][1:]]

    class Moved:
        def encode_batch_fast(self, texts, add_special_tokens):
            return [type("E", (), {"ids": x}) for x in moved]

    at = two.loaded
    monkeypatch.setattr(at, "a", Moved())
    assert two.encoded(["one two", "three"], False)[2] == [False, False]
    moved[:] = [ids[0][0], ids[0][1] + ids[0][1]]
    assert two.encoded(["one two", "three"], False)[2] == [True, False]
