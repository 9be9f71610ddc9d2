"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at ``r`` differing bits or fewer meet in a common variant when each emits all variants within half
the radius.  For an odd radius the halves would fall one short; so the bits are dealt into three blocks and the
variants are formed with one block blanked, once per block: if exactly ``r`` bits differ, one of them lies in some
block, and with that block blanked ``r - 1`` are left.  Only distinct fingerprints emit.  Members of a variant are read
in key order; their verified links leave the task as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, free_name, schema_with, written
from tessera.operators.components import connected_components

BITS = 64
BLOCKS = ((0, 21), (21, 42), (42, 64))
SEED = 42
HASH_BLOCK = 1 << 16  # shingles whose bits are counted at once
PAIR_BLOCK = 1 << 20  # distances held at once inside one variant


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a text, signed; a bit is 1 if set in over half of the shingles' hashes. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, separators of WHITE
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
        n = len(words) - shingle + 1
    counts, done = np.zeros(BITS, np.int64), 0
    while done < n:
        take = min(HASH_BLOCK, n - done)
        h = np.fromiter((digest(g, SEED) for g, _ in zip(grams, range(take))), np.uint64, take)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        done += take
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each row's text as column ``name``."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([simhash(t.as_py(), shingle) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, schema_with(docs, name, "long"))


def variants(radius: int) -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of every variant a fingerprint emits."""
    half = radius // 2
    blanks = [(1 << hi) - (1 << lo) for lo, hi in BLOCKS] if radius % 2 else [0]
    out = []
    for blank in blanks:
        free = [b for b in range(BITS) if not blank >> b & 1]
        keep = ((1 << BITS) - 1) ^ blank
        out += [(keep, sum(1 << b for b in some)) for k in range(half + 1) for some in combinations(free, k)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the members that lie within ``radius`` of each other."""
    left, links = np.arange(1, len(fps)), []
    front = np.array([0])
    while True:
        reached, block = [], max(1, PAIR_BLOCK // max(1, len(left)))
        for k in range(0, len(front), block):
            if not len(left):
                break
            part = front[k:k + block]
            near = np.bitwise_count(fps[part][:, None] ^ fps[left][None, :]) <= radius
            hit = near.any(0)
            links.append(np.stack([fps[part[near[:, hit].argmax(0)]], fps[left[hit]]], 1))
            reached.append(left[hit])
            left = left[~hit]
        front = np.concatenate(reached) if reached else front[:0]
        if not len(left):
            break
        if not len(front):
            front, left = left[:1], left[1:]
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


def _links_of(keys: np.ndarray, fps: np.ndarray, radius: int, seen: set[bytes]) -> np.ndarray:
    """Verified links inside each run of equal keys (rows come sorted by key, then fingerprint)."""
    same = keys[1:] == keys[:-1]
    near = same & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= radius)
    at = np.flatnonzero(near)
    out = [np.stack([fps[at], fps[at + 1]], 1)]
    # runs whose neighbours in order do not all link need a search
    if (same & ~near).any():
        start = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(keys)]])
        run = np.searchsorted(start, np.flatnonzero(same & ~near), "right") - 1
        for k in np.unique(run):
            members = fps[start[k]:start[k + 1]]
            if len(members) > 2 and (mark := members.tobytes()) not in seen:
                if len(seen) >= 20_000:
                    seen.clear()
                if len(mark) <= 4096:
                    seen.add(mark)
                out.append(_forest(members, radius))
    pairs = np.concatenate(out)
    return np.unique(np.sort(pairs, 1), axis=0) if len(pairs) else pairs


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) whose components are those of all pairs within ``radius``."""
    todo = F.array(*[F.struct(F.lit(_signed(k)).alias("k"), F.lit(_signed(f)).alias("f")) for k, f in variants(radius)])
    keyed = distinct.select("fp", F.explode(F.transform(
        todo, lambda v: F.col("fp").bitwiseAND(v["k"]).bitwiseXOR(v["f"]))).alias("key"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            pairs = _links_of(k, f, radius, seen).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], names=["u", "v"])

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.concatenate([held_k, batch.column(1).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held_f, fps])
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on in the next batch
            if cut:
                yield out(keys[:cut], fps[:cut])
            held_k, held_f = keys[cut:], fps[cut:]
        if len(held_k):
            yield out(held_k, held_f)

    spark = distinct.sparkSession
    bounded_batches(spark, rows=1 << 16)
    ordered = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(link, "u long, v long").distinct()


def grouped(marked: DataFrame, fp: str, radius: int, name: str) -> DataFrame:
    """(fp, root, ``name``) of every distinct fingerprint: its component's smallest fingerprint and smallest doc_id
    (null if all are null)."""
    own = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("own_least")), "simhash-distinct")
    keep = lambda df: written(df, "simhash-links")
    parts = connected_components(near_links(own, radius), keep)
    rooted = own.join(parts, own["fp"] == parts["node"], "left").select(
        "fp", "own_least", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("own_least").alias("all_least"))
    return rooted.join(smallest, "root").select("fp", "root", F.col("all_least").alias(name))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint (16 hex digits) and component of every row; the component is the smallest doc_id reachable.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows each get a row; a null
    doc_id has its component's id, null if the component holds no other.  Extra columns are not read.
    """
    marked = written(fingerprints(docs.select("doc_id", "text"), shingle, "fp").select("doc_id", "fp"), "simhash")
    parts = grouped(marked, "fp", radius, "component_id").drop("root")
    return marked.join(parts, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, with all input columns: that of the smallest doc_id (of equal ids, the text that
    sorts first by hash; of equal rows, one; rows without an id stay only if their component has no id at all)."""
    columns = docs.columns
    name, least = free_name(docs, "fp"), free_name(docs, "least_id")
    marked = written(fingerprints(docs, shingle, name), "simhash")
    parts = grouped(marked.select("doc_id", name), name, radius, least)
    # the row to keep is found on keys alone; the texts move once, to meet it
    order = F.xxhash64("text")
    keys = marked.select(F.col(name).alias("fp"), "doc_id", order.alias("order")).join(
        parts.withColumnRenamed(least, "lead_id"), "fp")
    lead = keys.where(F.col("doc_id").eqNullSafe(F.col("lead_id"))).groupBy("root").agg(
        F.min(F.struct("order", "fp")).alias("lead"), F.first("lead_id").alias(least))
    lead = lead.select(F.col("lead.fp").alias(f"{least}_fp"), F.col("lead.order").alias(f"{least}_order"), least)
    hit = marked.join(lead, (F.col(name) == F.col(f"{least}_fp")) & (order == F.col(f"{least}_order"))
                      & F.col("doc_id").eqNullSafe(F.col(least)))
    # rows that repeat with the same id and text: one of them, by the hash of all columns
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = hit.groupBy(f"{least}_fp", f"{least}_order").agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.xxhash64(*plain)).alias("row"))
    return one.select("row.*")
