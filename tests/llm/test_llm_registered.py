"""The registered queries themselves: the contract's columns on whole tables against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from fixtures import prose
from test_llm_alignment import Brute
from test_llm_dedup import _brute_simhash
from test_llm_text import _strict

from tessera.llm import pii, queries

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of texts with personal data, repeated passages, nulls and odd characters, in the driver's layout."""
    rng = random.Random(21)
    kinds = ["mail a.b@c-d.org or x@y.co.uk", "at 10.0.0.255 and 256.1.1.1", "card 4111 1111 1111 1111 ok", "call +1 (234) 567-8901 now",
             "two +49 30 1234567 and 1.2.3.4 and 5.6.7.8"]
    passage = " ".join(prose(rng, 90).split())
    rows = []
    for k in range(60):
        text = prose(rng, rng.randint(0, 80))
        if k % 3 == 0:
            text += " " + rng.choice(kinds) + " " + rng.choice(kinds)
        if k % 7 == 0:
            text = f"{text} {passage} {k}"
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, rows[7][1]), (104, "Ünï ☃ 😀 \x00 ▁ <|endoftext|>"), (105, "x" * 3000)]
    path = str(tmp_path_factory.mktemp("registered"))
    docs = [(k, t, "en", f"src{k % 4}", None if t is None else len(t)) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def _got(query, spark, path):
    rows = query(spark, path).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, folder):
    path, rows = folder
    got = _got(queries.op1_suffix_dedup, spark, path)
    seen = collections.Counter()
    raw = {k: (t or "").encode() for k, t in rows}
    for b in raw.values():
        seen.update(b[i:i + 400] for i in range(len(b) - 399))
    removed = 0
    for k, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i + 1:i + 401] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        spans = int((gone[1:] & ~gone[:-1]).sum())
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, _sha(kept)), k
        removed += r["n_removed"]
    assert removed > 4000


def test_op4(spark, folder):
    path, rows = folder
    got = _got(queries.op4_bootstrapped_pii, spark, path)
    seen = set()
    for k, t in rows:
        base = _strict(t)
        r = got[k]
        for kind in pii.KINDS:
            n = sum(s.startswith(f"{kind}:") for s in base.split(","))
            assert r[f"n_{kind}"] == n, (k, kind)
            seen.update([kind] * bool(n))
        assert r["base_sha256"] == _sha(base.encode())
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert seen == set(pii.KINDS)


def test_op5_sizes_and_slots(spark, folder):
    path, rows = folder
    got = _got(queries.op5_hilbert_sharding, spark, path)
    slots = collections.defaultdict(list)
    for k, t in rows:
        raw = (t or "").encode()
        assert (got[k]["size"], got[k]["text_crc32"], got[k]["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
        slots[got[k]["shard"]].append(got[k]["slot"])
    assert set(slots) <= set(range(16)) and max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(16)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_fingerprints(spark, folder):
    path, rows = folder
    got = _got(queries.op6_simhash_near_dedup, spark, path)
    assert all(got[k]["fingerprint"] == f"{_brute_simhash(t):016x}" for k, t in rows)
    assert got[103]["component_id"] == got[7]["component_id"] <= 7 and got[102]["component_id"] <= 100


def test_op7(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = _got(queries.op7_bpe_round_trip, spark, path)
    for k, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (
            len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(text.encode())), k


def test_op12(spark, folder):
    path, rows = folder
    got = _got(queries.op12_token_alignment, spark, path)
    brute = Brute()
    groups = {k: brute.groups(t) for k, t in rows}
    links = {k: brute.links(g) for k, g in groups.items()}
    count = collections.Counter(p for found in links.values() for p in found)
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for k, g in groups.items():
        r, found = got[k], links[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()))
        assert r["n_best"] == sum(n for p, n in found.items() if count[p] == top[p[0]])
        assert r["count_sum"] == sum(n * count[p] for p, n in found.items())
        assert r["groups_sha256"] == (_sha(Brute.written(g).encode()) if g else "")


def test_op13(spark, folder):
    import tiktoken

    path, rows = folder
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = _got(queries.op13_byte_bpe, spark, path)
    for k, t in rows:
        ids = library.encode_ordinary(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (
            len(ids), _sha(" ".join(map(str, ids)).encode()), _sha((t or "").encode())), k


def test_op11_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()["op11_conversation_trie"])
    got = queries.op11_conversation_trie(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "1.1.1." + "0" * 5000, "1.1.1." + "0" * 500_000, "a@" * 200_000,
                                  "1." * 200_000, "+1" + "(" * 500_000, "555-1234 x " * 40_000])
def test_long_runs_of_characters(text):
    """Each takes time in proportion to the text (a few seconds at most), and no number is too long."""
    began = time.process_time()
    pii.found_in(text)
    assert time.process_time() - began < 10
