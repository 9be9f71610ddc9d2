"""Suffix dedup, SimHash and decontamination against brute force."""

from __future__ import annotations

import collections
import os
import random
import re

import numpy as np
import pytest
import xxhash
from fixtures import frame, prose

from tessera.llm import common, decontamination, simhash, suffix_dedup


def _brute_kept(rows, length):
    seen = collections.Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = {}
    for k, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        out[k] = bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("group", [2000, 6])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, group):
    """With a small group bound, crowded anchors are split level by level and the result stays the same."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    base = [prose(rng, rng.randint(5, 300)) for _ in range(25)]
    passage = prose(rng, 75)
    rows = [(k, t, "en") for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 25][:rng.randint(0, 900)] + passage + base[(k + 3) % 25], "en") for k in range(30)]
    rows += [(200, "a" * 1500, "en"), (201, "ab" * 500 + "x", "en"), (202, "é☃" * 300, "fr"), (203, None, "en"), (204, "", "en")]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got == _brute_kept(rows, 400)


def test_interval_expansion_is_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        length, letters = rng.choice([9, 14, 40]), rng.choice([b"ab", b"abcd", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(200))
        texts = [base[a:a + rng.randint(length, 120)] for a in (rng.randrange(150) for _ in range(8))]
        texts = [t for t in texts if len(t) >= length]
        starts = np.array([len(t) - length + 1 for t in texts])
        seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        for t, ranges in zip(texts, suffix_dedup.compared(texts, starts, length)):
            for i in range(len(t) - length + 1):
                assert (seen[t[i:i + length]] > 1) == any(s <= i < e for s, e in ranges)


def _brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 2, 3, 40, 150])) for _ in range(40)]
    rows = [(k, t, "en") for k, t in enumerate(base)] + [(500, None, "en"), (501, "", "en"), (502, "Ünder ÄÖ", "de")]
    for k in range(80):  # near copies, in chains
        words = rows[rng.randrange(len(base))][1].split()
        words[rng.randrange(len(words))] = rng.choice("alpha beta gamma".split())
        rows.append((100 + k, " ".join(words), "en"))
    fps = [_brute_simhash(t) for _, t, _ in rows]
    ids = [k for k, _, _ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    least = {lab: min(i for i, x in zip(ids, label) if x == lab) for lab in set(label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(frame(spark, rows)).collect()}
    assert got == {k: (f"{f:016x}", least[lab]) for k, f, lab in zip(ids, fps, label)}


def test_links_of_exactly_the_radius(spark):
    """Pairs of 0 to 4 differing bits in all blocks: linked up to 3, not at 4."""
    rng = np.random.default_rng(1)
    fps, pairs = [], []
    for n in range(5):
        for _ in range(30):
            x = int(rng.integers(0, 1 << 63)) * 2
            y = x
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps += [x, y]
            pairs.append((n, x, y))
    rows = spark.createDataFrame([(simhash._signed(f),) for f in sorted(set(fps))], "fp long")
    links = {frozenset((r["u"], r["v"])) for r in simhash.near_links(rows, 3).collect()}
    for n, x, y in pairs:
        if n:
            assert (frozenset((simhash._signed(x), simhash._signed(y))) in links) == (n <= 3), n


def test_large_variant_group_keeps_its_forest():
    """A group whose neighbours in order don't all link is searched; its links connect what lies within the radius."""
    center = 0x0F0F0F0F0F0F0F0F
    fps = np.array(sorted({center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}), np.uint64)
    links = simhash._links_of(np.zeros(len(fps), np.int64), fps, 3, set())
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links.tolist():
        assert (u ^ v).bit_count() <= 3
        parent[root(u)] = root(v)
    assert len({root(int(f)) for f in fps}) == 1
    assert len(links) < 4 * len(fps)


def test_decontamination_recall(spark):
    """Copies and lightly changed copies are found, wherever they stand; other texts are not."""
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "kilo mar ten vol sub pre".split() for b in "an er in or us el".split() for c in "ta mo ri do sk".split()]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, f"{text(rng.randint(10, 30))}. {text(rng.randint(6, 12))}.") for k in range(40)]
    items += [(90, "only four words here"), (91, None), (92, "!!!")]
    rows, truth = [], set()
    for k in range(120):
        body = text(rng.randint(0, 400)).split()
        if k % 2:
            number, item = items[rng.randrange(40)]
            words = item.split()
            for _ in range(int(len(words) * rng.choice([0, 0.08, 0.15]))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            at = rng.randint(0, len(body))
            body[at:at] = words
            truth.add((k, number))
        rows.append((k, " ".join(body), "en"))
    rows.append((500, "well, ONLY four words: here", "en"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated_pairs(frame(spark, rows), benchmark).collect()}
    assert (500, 90) in got
    got.discard((500, 90))
    assert len(got & truth) >= 0.95 * len(truth)
    assert not {k for k, _ in got} - {k for k, _ in truth}  # clean texts are left alone
    kept = {r["doc_id"] for r in decontamination.decontaminated(frame(spark, rows), benchmark).collect()}
    assert kept == {k for k, _, _ in rows} - {k for k, _ in got} - {500}


def test_items_inside_repeated_words(spark):
    """Exact and short items amid one repeated word of theirs are found, whatever the window's cosine."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "kilo mar ten vol sub pre".split() for b in "anta ermo inri ordo ussk elta".split()]
    items = [(k, " ".join(f"{rng.choice(vocabulary)}{rng.randrange(40)}" for _ in range(33))) for k in range(20)]
    items += [(90, "kiloanta sober marker ten")]
    rows = []
    for k, item in items:
        rows += [(100 * k + j, f"{(w + ' ') * 70}{item} {(w + ' ') * 70}", "en") for j, w in enumerate(item.split()[:4])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.contaminated_pairs(docs, benchmark).collect()}
    assert got == {(d, d // 100): 1.0 for d, _, _ in rows}
    assert decontamination.decontaminated(docs, benchmark).count() == 0


def test_latent_space_is_of_all_documents(spark):
    """Long texts and every copy are in the sums of the fit; sums are those of the whole matrix."""
    rng = np.random.default_rng(4)
    names = [f"word{k}" for k in range(30)]
    texts = [" ".join(rng.choice([*names, "other"], n)) for n in (5000, 70, 64, 1, 0, 200)] * 2
    decontamination.bounded_batches(spark)
    docs = frame(spark, [(k, t, "en") for k, t in enumerate([*texts, None])])
    block = next(decontamination.blocks(docs, spark.createDataFrame([(1, " ".join(names))], "item_id long, text string")))
    rows = []
    for t in texts:
        ids = decontamination.word_ids(block.vocabulary, t)
        for s in range(0, len(ids), 64):
            x = np.bincount(ids[s:s + 64], minlength=31)[:30]
            x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * block.weights[:30]
            if x.any():
                rows.append(x / np.linalg.norm(x))
    a, r = np.array(rows), rng.normal(size=(30, 12)).astype(np.float32)
    total, n = decontamination._summed(docs, block, decontamination._spread, r, 30)
    assert n == len(a) and np.allclose(total, a.T @ (a @ r), rtol=1e-3, atol=1e-3)
    total, n = decontamination._summed(docs, block, decontamination._rotated, r, 12)
    assert n == len(a) and np.allclose(total, (a @ r).T @ (a @ r), rtol=1e-3, atol=1e-3)


def test_common_subsequence():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontamination.common_subsequence(a, b) == brute(a.tolist(), b.tolist())


def test_words_are_looked_up_once_for_a_fit(spark, monkeypatch):
    """The three passes of a fit read written word ids, which are gone afterwards; weights are those of the texts."""
    kept = []
    monkeypatch.setattr(decontamination, "written", lambda df, name: kept.append(common.written(df, name)) or kept[-1])
    docs = frame(spark, [(1, "alpha beta, beta other", "en"), (2, "ALPHA", "en"), (3, None, "en"), (4, "", "en")])
    (block,) = decontamination.blocks(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    n = {w: block.weights[k] for w, k in block.vocabulary.items()}
    assert n == pytest.approx({b"alpha": np.log(5 / 3) + 0.05, b"beta": np.log(5 / 2) + 0.05, b"gamma": np.log(5) + 0.05})
    assert len(kept) == 1 and not any(os.path.exists(f.removeprefix("file://")) for f in kept[0].inputFiles())
