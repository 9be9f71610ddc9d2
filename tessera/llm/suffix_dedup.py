"""Removal of repeated byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``length`` bytes that starts anywhere else too.  Equal strings must meet, so
every string is filed under its anchor: the leftmost of its ``GRAM``-byte substrings with the least hash.  Strings that
follow one another and share an anchor form a unit with one context (the bytes they cover).  Contexts that occur more
than once are repeated as a whole, and one copy stands for all.  Different contexts of one anchor are compared byte by
byte: a task takes the contexts of some anchors, builds their Burrows-Wheeler transform and expands intervals breadth
first by backward extension, which yields the common prefixes of neighbouring suffixes in increasing order; it stops at
``length``, and what has no value by then is repeated.

Anchors with very many different contexts are split before: their strings are filed anew by what all strings of a
narrower range of offsets share, ever narrower, down to the string itself.  So no task holds an unbounded group, and
nothing is left out.  Only hashes and places are shuffled, the contexts that need comparing, and each text to meet its
places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, dropped, written

LENGTH = 400
GRAM = 64
SEGMENT = 1 << 21  # starts looked at at once; longer texts go on in the next segment
GROUP = 2000  # different contexts of one anchor that are compared in one task
BUCKET = 1 << 21  # bytes of contexts per transform, on average
CELLS = (64, 8, 1)  # widths of the ranges of offsets that split crowded anchors
PACK = 7  # symbols of 9 bits in one sort key

ROWS = "doc_id {id}, text_hash long, first long, starts long, anchor long, context long, copies long, back long"
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place on, by doubling."""
    h, m = _TABLE[data], 1
    while m < size:
        h = h[:-m] * np.uint64(0x9E3779B97F4A7C15) + h[m:]
        h ^= h >> np.uint64(29)
        m *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    m = 1
    while 2 * m <= width:
        keys = np.minimum(keys[:-m], keys[m:])
        m *= 2
    return np.minimum(keys[:len(keys) - (width - m)], keys[width - m:]) if width > m else keys


def units(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, place of the anchor, hash of the anchor) of each unit of valid starts."""
    none = np.empty(0, np.int64)
    if len(data) < length or not valid.any():
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, gram)
    bits = np.uint64(SEGMENT.bit_length() + 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_least(h >> bits << bits | place, length - gram + 1)[:len(valid)]
    at = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    valid = valid[:len(at)]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return first, ends - first + 1, at[first], h[at[first]]


def _batch_units(texts: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """Units of a batch: text number, first, starts, anchor, context, copies, back (the anchor's offset from the first
    start); and ranges repeated within the batch (copies 0, no anchor).  Of units alike in the batch one is kept, with
    their number."""
    import xxhash

    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(sizes)
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    contexts: list[int] = []
    view = memoryview(data)
    for s in range(0, len(data), SEGMENT):
        begin = np.arange(s, min(s + SEGMENT, len(data)))
        valid = begin + length <= stop[np.searchsorted(stop, begin, "right")]
        first, n, at, anchor = units(data[s:s + SEGMENT + length - 1], valid, length, gram)
        new = np.searchsorted(stop, first + s, "right")
        for column, value in zip(out, (new, first + s, n, anchor, at - first)):
            column.append(value)
        contexts += [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((first + s).tolist(), (first + s + n - 1 + length).tolist())]
    text, first, n, anchor, back = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
    if not len(text):
        return [np.empty(0, np.int64)] * 7
    context = np.array(contexts, np.uint64)
    anchor = anchor.astype(np.uint64)
    first = first - (stop - sizes)[text]
    _, one, same, copies = np.unique(anchor * np.uint64(31) ^ context, return_index=True, return_inverse=True, return_counts=True)
    many = np.flatnonzero(copies[same] > 1)
    # neighbouring ranges that are repeated within the batch, as one
    order = many[np.lexsort((first[many], text[many]))]
    t, f, e = text[order], first[order], first[order] + n[order]
    head = np.append(True, (t[1:] != t[:-1]) | (f[1:] != e[:-1])) if len(order) else np.empty(0, bool)
    begin, last = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(order)) - 1 if len(order) else np.empty(0, np.int64)
    none = np.zeros(len(begin), np.int64)
    return [np.concatenate(p) for p in (
        (text[one], t[begin]), (first[one], f[begin]), (n[one], e[last] - f[begin] if len(order) else none),
        (anchor[one].view(np.int64), none), (context[one].view(np.int64), none), (copies, none), (back[one], none))]


def located_units(docs: DataFrame, length: int, gram: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_units(batch.column(1).to_pylist(), length, gram)
            at = pa.array(found[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), *map(pa.array, found[1:])],
                names=["doc_id", "text_hash", "first", "starts", "anchor", "context", "copies", "back"])

    return rows.mapInArrow(find, ROWS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling on what is still tied)."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACK, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(PACK):
        key = key << 9 | padded[k:k + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    m = PACK
    while m < depth:
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        own = order[tied]
        key = rank[own] * (n + 1) + rank[np.minimum(own + m, n)] + 1
        turn = np.argsort(key, kind="stable")
        own, key = own[turn], key[turn]
        order[tied] = own
        head = np.append(True, key[1:] != key[:-1])
        new[tied] |= head
        rank[own] = tied[np.flatnonzero(head)[np.cumsum(head) - 1]]
        m *= 2
    return order


def repeated_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place, whether the ``length`` symbols from it on (none of them 0) also start elsewhere.

    Symbol 0 parts the strings.  Intervals of the transform for strings of PACK symbols are read off the sorted suffixes;
    from there on, every interval is extended backward by each symbol that precedes it, and the first interval to end at
    a boundary sets the common prefix there.  Only intervals that set one are extended further.
    """
    n = len(symbols)
    order = suffix_order(symbols, length)
    before = symbols[order - 1]
    to = np.empty(n, np.int64)  # place of the suffix one symbol longer
    to[np.argsort(before, kind="stable")] = np.arange(n)
    padded = np.concatenate([symbols, np.zeros(PACK, symbols.dtype)])
    common = np.full(n + 1, -1, np.int16)  # of suffixes at k - 1 and k; -1: not yet known
    common[0] = common[n] = 0
    open_ = np.ones(n - 1, bool)
    for k in range(PACK):
        differ = open_ & (padded[order[1:] + k] != padded[order[:-1] + k])
        common[1:n][differ] = k
        open_ &= ~differ
    edge = np.flatnonzero(common >= 0)  # bounds of the intervals of PACK symbols
    last = common[edge[1:]] == PACK - 1
    low, high = edge[:-1][last], edge[1:][last]
    run = np.append(True, before[1:] != before[:-1])
    run_of, run_at = np.cumsum(run) - 1, np.append(np.flatnonzero(run), n)
    for size in range(PACK, length):
        if not len(low):
            break
        r0, r1 = run_of[low], run_of[high - 1]
        plain = r0 == r1  # preceded by one symbol only
        new_low, new_high = [to[low[plain]]], [to[high[plain] - 1] + 1]
        part = before[low[plain]] != 0
        new_low, new_high = [new_low[0][part]], [new_high[0][part]]
        mixed = np.flatnonzero(~plain)
        if len(mixed):
            count = r1[mixed] - r0[mixed] + 1
            which = np.repeat(np.arange(len(mixed)), count)
            runs = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + r0[mixed][which]
            start = np.maximum(run_at[runs], low[mixed][which])
            stop = np.minimum(run_at[runs + 1], high[mixed][which])
            key = which * 512 + before[start]
            turn = np.argsort(key, kind="stable")
            key = key[turn]
            head = np.append(True, key[1:] != key[:-1])
            tail = np.append(head[1:], True)
            begin, end = start[turn[head]], stop[turn[tail]] - 1
            part = before[begin] != 0
            new_low.append(to[begin[part]])
            new_high.append(to[end[part]] + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = common[high] < 0
        low, high = low[fresh], high[fresh]
        common[high] = size
    same = common < 0
    out = np.zeros(n, bool)
    out[order] = same[:-1] | same[1:]
    return out


def compared(contexts: list[bytes], starts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of its starts whose strings occur elsewhere in these contexts."""
    sizes = np.array([len(c) for c in contexts])
    symbols = np.zeros(sizes.sum() + len(sizes) + 1, np.int16)
    at = np.cumsum(sizes + 1) - sizes  # a 0 before each context and one at the end
    data = np.frombuffer(b"".join(contexts), np.uint8)
    spot = np.arange(len(data)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
    symbols[spot] = data.astype(np.int16) + 1
    hit = repeated_suffixes(symbols, length)
    out = []
    for a, n in zip(at.tolist(), starts.tolist()):
        own = np.concatenate([[0], hit[a:a + n].astype(np.int8), [0]])
        step = np.diff(own)
        out.append(list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())))
    return out


RANGES = "anchor long, context long, first long, stop long"
PART = "key long, hash long, anchor long, context long, low long, starts long, back long, copies long, bytes binary"


def _split(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Strings of crowded anchors, filed by the bytes that all strings of a range of ``width`` offsets share."""
    import xxhash

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                far, near = r["back"], r["back"] - r["starts"] + 1  # offsets of the anchor from the first and last start
                for cell in range(near // width, far // width + 1):
                    a, b = min(far, cell * width + width - 1), max(near, cell * width)
                    low = far - a  # of the first string of this cell, in the context
                    core = r["bytes"][far - cell * width:far - (cell * width + width - 1) + length]
                    data = r["bytes"][low:far - b + length]
                    out.append(r | {
                        "key": _signed(xxhash.xxh3_64_intdigest(core, seed=cell * 100 + width)), "hash": _signed(xxhash.xxh3_64_intdigest(data)),
                        "low": r["low"] + low, "starts": a - b + 1, "back": a, "bytes": data})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return parts.mapInArrow(split, PART)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def repeated_ranges(parts: DataFrame, length: int, name: str = "suffix-parts") -> DataFrame:
    """(anchor, context, first, stop): ranges of starts, within a context, whose strings are repeated.

    ``parts`` are the different contexts of anchors that have several (PART).  Crowded keys are split, level by level;
    the others are compared in buckets of about BUCKET bytes.
    """
    found, level = [], 0
    while True:
        groups = parts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("size"))
        crowded = written(groups.where(F.col("n") > GROUP).select("key"), f"{name}-crowded")
        hot = crowded.count() > 0
        calm = parts.join(crowded, "key", "left_anti") if hot else parts
        size = calm.agg(F.sum(F.length("bytes"))).first()[0] or 0
        if size:
            buckets = -(-size // BUCKET)
            calm = calm.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
            found.append(calm.groupBy("bucket").applyInArrow(lambda t: _compared_rows(t, length), RANGES))
        if not hot:
            break
        parts = _split(parts.join(crowded, "key", "left_semi").select(*[c.split()[0] for c in PART.split(", ")]), CELLS[level], length)
        parts = written(parts, f"{name}-{level}")
        # equal parts are repeated as a whole; one of them goes on to be compared with the others of its key
        alike = parts.groupBy("key", "hash").agg(F.sum("copies").alias("all"))
        whole = parts.join(alike.where(F.col("all") > 1), ["key", "hash"], "left_semi")
        found.append(whole.select("anchor", "context", F.col("low").alias("first"), (F.col("low") + F.col("starts")).alias("stop")))
        keys = alike.groupBy("key").agg(F.count("*").alias("different")).where(F.col("different") > 1).select("key")
        one = F.min_by(F.struct("anchor", "context", "low", "starts", "back", "bytes"), F.struct("anchor", "context", "low"))
        parts = parts.join(keys, "key", "left_semi").groupBy("key", "hash").agg(one.alias("p"), F.sum("copies").alias("copies"))
        parts = written(parts.select("key", "hash", "p.anchor", "p.context", "p.low", "p.starts", "p.back", "copies", "p.bytes"),
                        f"{name}-next-{level}")
        level += 1
    spark = parts.sparkSession
    out = spark.createDataFrame([], RANGES)
    for f in found:
        out = out.unionByName(f)
    return out


def _compared_rows(table: pa.Table, length: int) -> pa.Table:
    """Ranges of one bucket.  A range that only one of several equal parts stands for holds for its own context; the
    equal ones have theirs as a whole already."""
    starts = table.column("starts").to_numpy()
    ranges = compared(table.column("bytes").to_pylist(), starts, length)
    at = np.repeat(np.arange(len(ranges)), [len(r) for r in ranges])
    low = table.column("low").to_numpy()[at]
    pairs = np.array([p for r in ranges for p in r], np.int64).reshape(-1, 2)
    take = pa.array(at, pa.int64())
    return pa.table({"anchor": table.column("anchor").take(take), "context": table.column("context").take(take),
                     "first": low + pairs[:, 0], "stop": low + pairs[:, 1]})


def _slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted units: (doc_id, text_hash, first, starts, anchor, context, copies, back) to PART rows."""
    per_text = wanted.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(
        F.collect_list(F.struct("first", "starts", "anchor", "context", "copies", "back")).alias("units"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(per_text, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for u in found:
                    data = text[u["first"]:u["first"] + u["starts"] - 1 + length]
                    out.append({"key": u["anchor"], "hash": u["context"], "anchor": u["anchor"], "context": u["context"], "low": 0,
                                "starts": u["starts"], "back": u["back"], "copies": u["copies"], "bytes": data})
                yield pa.RecordBatch.from_pylist(out, schema=_PART_SCHEMA)

    return rows.select("text", "units").mapInArrow(cut, PART)


_PART_SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PART.split(", ")])


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, ranges): for each text with repeated strings the ranges [s, e) of their starts."""
    bounded_batches(docs.sparkSession, rows=500, size="4m")
    found = written(located_units(docs, length, GRAM), "suffix-units")
    rows = found.where("copies > 0")
    anchors = rows.groupBy("anchor").agg(
        F.sum("copies").alias("all"), F.min("context").alias("least"), F.max("context").alias("most")).where(F.col("all") > 1)
    shared = written(rows.join(anchors, "anchor").select(*rows.columns, (F.col("least") != F.col("most")).alias("differ")), "suffix-shared")
    # anchors with different contexts: one copy of each context is fetched and compared
    contexts = shared.where("differ").groupBy("anchor", "context").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "text_hash", "first", "starts", "back")).alias("u"))
    contexts = written(contexts.select("u.*", "anchor", "context", "copies"), "suffix-contexts")
    parts = written(_slices(docs, contexts, length), "suffix-parts")
    ranges = written(repeated_ranges(parts, length), "suffix-ranges")
    dropped(parts)
    place = [F.col("doc_id"), F.col("text_hash")]
    stop = F.col("first") + F.col("starts")
    several = contexts.where("copies > 1").select("anchor", "context")
    whole = found.where("copies = 0").select(*place, "first", stop.alias("stop")).unionByName(
        shared.where("not differ").select(*place, "first", stop.alias("stop"))).unionByName(
        shared.where("differ").join(several, ["anchor", "context"], "left_semi").select(*place, "first", stop.alias("stop")))
    own = shared.where("differ").select(*place, "anchor", "context", F.col("first").alias("base")).join(
        ranges, ["anchor", "context"]).select(*place, (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("stop")).alias("stop"))
    return whole.unionByName(own).distinct().groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("first", "stop")).alias("ranges"))


def merged(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes from the ranges of starts."""
    out: list[list[int]] = []
    for s, e in sorted((r["first"], r["stop"] - 1 + length) for r in ranges or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (array of byte ranges [s, e)), kept (the bytes that remain) of every row.

    Texts are UTF-8 bytes, null counts as empty; strings never reach from one text into the next.  Texts shorter than
    ``length`` lose nothing.  Repeated rows repeat each other's strings, so each loses all but its short ends; null ids
    are told apart by their texts; extra columns are not read; an empty table gives an empty result.
    """
    ranges = repeated_starts(docs, length).select(
        F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "ranges")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).join(
        ranges, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans, at, rest = merged(found, length), 0, []
                for s, e in spans:
                    rest.append(text[at:s])
                    at = e
                kept.append(b"".join([*rest, text[at:]]))
                removed.append([{"s": s, "e": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "ranges").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, removed array<struct<s:long,e:long>>, kept binary")
