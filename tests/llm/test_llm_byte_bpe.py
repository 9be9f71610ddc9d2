"""Byte-level BPE by backtracking against the library, on words, odd texts and made-up vocabularies."""

from __future__ import annotations

import base64
import collections
import random

import numpy as np
import pytest
from fixtures import frame, odd_rows

from tessera.llm.byte_bpe import ByteCodec, Ranks, byte_bpe_encoded

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [*"ab \n\t'sé☃1<|>x中", "\x1c", "\x85", "\xa0", "　", "​", "😀", "aaa", "the", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(codec, texts):
    return [np.frombuffer(i, np.uint32).tolist() for i in codec.encoded(texts)]


def test_odd_texts_are_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 200))) for _ in range(2000)]
    texts += ["x" * 70_000, "ab" * 40_000, " " * 5000, " \n" * 900, "a\x1c " * 40, "-=" * 3000, "", "\n", "don't 'tis"]
    codec = ByteCodec(PATH, P.PATTERN)
    for s in range(0, len(texts), 500):
        for text, ids in zip(texts[s:s + 500], _ids(codec, texts[s:s + 500])):
            assert ids == library.encode_ordinary(text), text[:60]
            assert codec.decoded(np.array(ids, np.uint32)) == text.encode()


def _trained(rng, merges):
    """A vocabulary of bytes and the most frequent pairs of a random text, one after the other."""
    words = [[bytes([c]) for c in rng.choices(b"abc", [5, 3, 2], k=rng.randint(2, 40))] for _ in range(300)]
    lines = [bytes([b]) for b in range(256)]
    for _ in range(merges):
        pairs = collections.Counter(p for w in words for p in zip(w, w[1:]) if p[0] + p[1] not in lines)
        (a, b), _ = max(pairs.items(), key=lambda x: (x[1], x[0]))
        lines.append(a + b)
        for w in words:
            k = 0
            while k + 1 < len(w):
                if (w[k], w[k + 1]) == (a, b):
                    w[k:k + 2] = [a + b]
                k += 1
    return lines


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_made_up_ranks_are_merges(seed):
    """Ranks of a vocabulary of three letters: stepping side by side, alone, and plain merging give the same."""
    rng = random.Random(seed)
    lines = _trained(rng, 120)
    ranks = Ranks([base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate(lines)])
    order = {t: k for k, t in enumerate(lines)}

    def merged(raw):
        parts = [bytes([b]) for b in raw]
        while len(parts) > 1:
            best = min((order.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [order[p] for p in parts]

    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    many = [np.frombuffer(i, np.uint32).tolist() for i in ranks.encode_all(texts)]
    for text, ids in zip(texts, many):
        assert ids == ranks.encode(text.encode()) == merged(text.encode()), text


def test_a_vocabulary_without_merges_is_refused():
    lines = [base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)]
    with pytest.raises(ValueError, match="merges"):
        Ranks([*lines, base64.b64encode(b"abc") + b" 256"])
    with pytest.raises(ValueError, match="256 bytes"):
        Ranks(lines[1:])


def test_operator_on_odd_rows(spark, library):
    rows = odd_rows()
    out = byte_bpe_encoded(frame(spark, rows), PATH, P.PATTERN)
    got = sorted(((r["doc_id"], r["_ids"], bytes(r["_decoded"])) for r in out.collect()), key=repr)
    want = sorted(((k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in rows), key=repr)
    assert got == want
    assert byte_bpe_encoded(frame(spark, []), PATH, P.PATTERN).count() == 0
