"""The prefix trie against a trie built in memory."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "conv_id long, turn long, role string, text string, part string, m long, next string"


def _brute(rows):
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((t is not None, t or 0, digest[:15], digest[16:31]), role, text))
    own = {c: [(role, text) for _, role, text in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + -c % 20
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in cs if tuple(built[c]) == p)
        out[cs[0], len(p)] = (
            members[p[:-1]][0] if p else None, len(cs), kids[p], sum(not kids[q] for q in below),
            sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 75), *rng.sample(range(100, 400), 25), -7, -20, -21, 1005]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a b", "a  b c", "", None, "yes"]), "x", 1, "y"))
    rows += [(60, None, "user", "first", "x", 1, "y"), (60, 0, "user", "tie", "x", 1, "y"), (60, 0, "user", "tie", "x", 1, "y")]
    rows += [(8, t, "user", "go on", "x", 1, "y") for t in range(20, 140)]  # a long conversation
    return rows + [(None, 1, "user", "nowhere", "x", 1, "y")]


@pytest.mark.parametrize(("seed", "block"), [(1, prefix_trie.BLOCK), (2, 7), (3, 1)])
def test_trie_is_brute_force(spark, seed, block):
    """In one block, in small ones (runs are ranked over many rounds), and with every node by itself."""
    rows = _rows(seed) if block > 1 else _rows(seed)[:60]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND), block).collect()
    assert len({(r["conv_id"], r["depth"]) for r in got}) == len(got)
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {(r["conv_id"], r["depth"]): tuple(r[n] for n in names) for r in got} == _brute(rows)


def test_long_rows_of_ends(spark, monkeypatch):
    """Thousands of equal conversations end at one node; their ids are written in pieces and hashed as one text."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    rows = [(20 * c, 0, "user", "same", "x", 1, "y") for c in range(1500)]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND)).collect()}
    assert got[0, 1]["n_convs"] == 1500
    ids = ",".join(str(20 * c) for c in range(1500))
    assert got[0, 1]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert got[0, 0]["ends_sha256"] == hashlib.sha256(b"").hexdigest()


def test_without_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], KIND)).collect() == []
    got = prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "a", "x", 1, "y")], KIND)).collect()
    assert got == []


def test_conversations_without_turns(spark):
    """Of conversation 41 the first turns are replaced by those of one that doesn't exist."""
    c = next(k for k in range(41, 60) if zlib.crc32(str(k).encode()) % 4 >= 1)
    got = prefix_trie.conversation_trie(spark.createDataFrame([(c, 0, "user", "only", "x", 1, "y")], KIND)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
