"""Prefix trie of conversations by the Euler-tour technique.

A turn is the digest of its role and text; a prefix is the exclusive or of its turns' digests mixed with their places, so a
running sum gives all prefixes of a conversation, and a node of the trie is a depth and a prefix.  A node is named by its
smallest member and its depth.  Every node has an arc in and an arc out; children follow one another by their smallest
member, and the tour's next arc is the first child's way in, the next sibling's way in, or the way out.

The tour is ranked in two steps.  Arcs of neighbouring nodes are laid together (in order of smallest member and depth, in
blocks of a fixed number of nodes), and each block contracts what follows one another inside it to runs.  Runs are
ranked by pointer jumping, a join a round, until no run has a next one.  Sums over a subtree are differences of the sums
up to the way out and the way in.

Conversations of any length are cut over several tasks: rows are dealt in ranges of (conversation, place), each range sums
its own rows, and a conversation's sums over the ranges before are added.  A node's children are put in order the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written

BLOCK = 1 << 18  # nodes whose arcs a task contracts at a time
CHUNK = 1 << 13  # ids written out in one piece of text
CROWDS = 50_000  # at most so many parents are looked up in a broadcast table, those with most children
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order``; ``part`` numbers the ranges."""
    return written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def turns_of(conversations: DataFrame) -> DataFrame:
    """c, t, two lanes of a turn's digest and its number of words; rows without a conversation are no turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    lane = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(n) for at, n in ((1, "l1"), (17, "l2"))]
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).select("c", "t", *lane, "words")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with ``part`` and their place ``pos`` in the conversation (from 1), and (c, part, size, before).

    In order of t, null first; turns with the same t come in order of their digests.
    """
    rows = in_order(turns, ["c", "t", "l1", "l2"], "trie-turns")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part", "c").orderBy("t", "l1", "l2")).cast("long"))
    groups = rows.groupBy("c", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = written(groups.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))), "trie-groups")
    return rows.join(groups.select("c", "part", "before"), ["c", "part"]).select(
        "c", "part", (F.col("nth") + F.col("before")).alias("pos"), "l1", "l2", "words"), groups


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(c, idx, l1, l2, words) and (c, length) of conversations whose first turns are another's.

    Conversation c takes the first h turns of c - c % block (all if fewer, none if absent) and then its own after its
    first h, where h = crc32(c) % heads.  A conversation may end up without turns.
    """
    rows, groups = numbered(turns)
    first = rows.where(F.col("c") % block == 0).where(F.col("pos") < heads)
    first = first.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "l1", "l2", "words"))).alias("first"))
    own = groups.groupBy("c").agg(F.sum("size").alias("n")).withColumn("base", F.col("c") - F.col("c") % block)
    own = own.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % heads)
    lead = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h").cast("int"))).otherwise(
        F.array().cast("array<struct<pos:bigint,l1:bigint,l2:bigint,words:bigint>>"))
    info = own.join(first, "base", "left").select("c", "n", "h", lead.alias("lead"))
    info = written(info.withColumn("shift", F.size("lead") - F.col("h")), "trie-heads")
    # a long conversation's rows meet its numbers range by range, never all in one task
    per_part = groups.select("c", "part").join(info.select("c", "h", "shift"), "c")
    tail = rows.join(per_part, ["c", "part"]).where("pos > h").select("c", (F.col("pos") + F.col("shift")).alias("idx"), "l1", "l2", "words")
    head = info.select("c", F.explode("lead").alias("t")).select("c", F.col("t.pos").alias("idx"), "t.l1", "t.l2", "t.words")
    lengths = info.select("c", (F.size("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return head.unionByName(tail), lengths


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, p1, p2, e1, e2, words): the prefix that ends with each turn, and what the turn itself adds to it."""
    mixed = [F.xxhash64(*cols).alias(n) for n, cols in (("e1", ("idx", "l1", "l2")), ("e2", (F.lit("second"), "l2", "l1", "idx")))]
    rows = in_order(rows.select("c", "idx", "words", *mixed), ["c", "idx"], "trie-rows")
    so_far = Window.partitionBy("part", "c").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("c", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    parts = parts.select("c", "part", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")])
    rows = rows.withColumns({f"p{k}": F.bit_xor(f"e{k}").over(so_far) for k in (1, 2)}).join(parts, ["c", "part"])
    return rows.select("c", F.col("idx").alias("d"), *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)],
                       "e1", "e2", "words")


def nodes_of(prefix: DataFrame, lengths: DataFrame) -> DataFrame:
    """(m, d, p1, p2, pm, n, n_children, words) of all nodes, root included (pm null); none without conversations."""
    own = prefix.groupBy("d", "p1", "p2").agg(F.min("c").alias("m"), F.count("*").alias("n"), F.min("words").alias("words"),
                                              F.min("e1").alias("e1"), F.min("e2").alias("e2"))
    top = lengths.agg(F.min("c").alias("m"), F.count("*").alias("n")).where("n > 0").select(
        F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "m", "n",
        F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("e1"), F.lit(0).cast("long").alias("e2"))
    own = written(own.unionByName(top).withColumns({f"q{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"e{k}")) for k in (1, 2)}), "trie-nodes")
    below = own.where("d > 0")
    kids = written(below.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("n_children")), "trie-kids")
    named = written(own.join(kids, ["d", "p1", "p2"], "left").select(
        *own.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "trie-named")
    # parents of crowds are broadcast (their number is bounded), the others' children are few
    crowd = named.count() // CROWDS
    parents = named.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                                                   F.col("m").alias("pm"), (F.col("n_children") > crowd).alias("crowd"))
    below = named.where("d > 0")
    often = below.join(F.broadcast(parents.where("crowd")), ["d", "q1", "q2"], "left")
    rest = often.where("pm is null").drop("pm", "crowd").join(parents.where("not crowd"), ["d", "q1", "q2"])
    columns = ["m", "d", "p1", "p2", "pm", "n", "n_children", "words"]
    root = named.where("d = 0").withColumn("pm", F.lit(None).cast("long"))
    return written(often.where("pm is not null").select(columns).unionByName(rest.select(columns)).unionByName(
        root.select(columns)), "trie-parents")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """The nodes with ``next`` (the next sibling's smallest member) and ``child`` (the first child's), null if none."""
    rows = in_order(nodes.where("d > 0").select("pm", "d", "m"), ["pm", "d", "m"], "trie-siblings")
    after = F.lead("m").over(Window.partitionBy("part", "pm", "d").orderBy("m"))
    firsts = rows.groupBy("pm", "d", "part").agg(F.min("m").alias("first"))
    firsts = written(firsts.withColumn("follows", F.lead("first").over(Window.partitionBy("pm", "d").orderBy("part"))), "trie-firsts")
    order = rows.withColumn("after", after).join(firsts.select("pm", "d", "part", "follows"), ["pm", "d", "part"]).select(
        "m", "d", F.coalesce("after", "follows").alias("next"))
    child = firsts.groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.min("first").alias("child"))
    return written(nodes.join(order, ["m", "d"], "left").join(child, ["m", "d"], "left"), "trie-tour")


def _runs(m: np.ndarray, d: np.ndarray, pm: np.ndarray, after: np.ndarray, child: np.ndarray, leaf: np.ndarray,
          saved: np.ndarray, none: int) -> tuple[tuple, tuple]:
    """Contract the arcs of a block of nodes (sorted by m, d; ``none`` stands for no node).

    An arc is named (m, 2 d) on the way in and (m, 2 d + 1) on the way out.  Gives, for the arcs in and then those out, the
    name of their run and the sums up to and with them, and for the runs their names, the next arc and their sums.
    """
    n = len(m)
    own_m, own_k = np.tile(m, 2), np.concatenate([2 * d, 2 * d + 1])
    # the next arc's name
    to_m = np.concatenate([np.where(child != none, child, m), np.where(after != none, after, pm)])
    to_k = np.concatenate([np.where(child != none, 2 * d + 2, 2 * d + 1), np.where(after != none, 2 * d, 2 * d - 1)])
    # its place here, if any: nodes of one smallest member are a stretch of depths
    first = np.minimum(np.searchsorted(m, to_m), n - 1)
    place = first + to_k // 2 - d[first]
    here = (place >= first) & (place < n) & (to_m != none)
    place = np.where(here, place, 0)
    here &= (m[place] == to_m) & (d[place] == to_k // 2)
    place += np.where(to_k % 2 == 1, n, 0)
    before = np.full(2 * n + 1, 2 * n)
    before[place[here]] = np.flatnonzero(here)
    head = np.where(before == 2 * n, np.arange(2 * n + 1), before)
    sums = np.zeros((2, 2 * n + 1), np.int64)
    sums[0, :n], sums[1, :n] = leaf, saved
    while (before < 2 * n).any():
        sums, before, head = sums + sums[:, before], before[before], head[head]
    head = head[:2 * n]
    last = np.flatnonzero(~here)
    return ((own_m[head], own_k[head], sums[0, :2 * n], sums[1, :2 * n]),
            (own_m[head[last]], own_k[head[last]], to_m[last], to_k[last], sums[0, last], sums[1, last]))


def contracted(tour: DataFrame, block: int = BLOCK) -> DataFrame:
    """Node rows (is_run false: run and sums of the way in and of the way out) and run rows (name, next arc, sums)."""
    names = ["is_run", "m", "d", "run_m", "run_k", "leaves", "saved", "out_m", "out_k", "out_leaves", "out_saved"]
    none = -(1 << 63)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            for s in range(0, len(table), block):
                m, d, pm, after, child, n, kids, words = (
                    np.concatenate([x.fill_null(none).to_numpy(zero_copy_only=False) for x in c.chunks]) for c in table.slice(s, block).columns)
                arcs, runs = _runs(m, d, pm, after, child, kids == 0, (n - 1) * words, none)
                half = len(m)
                cols = [m, d, *[a[:half] for a in arcs], *[a[half:] for a in arcs]]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(half, bool)), *map(pa.array, cols)], names=names)
                name_m, name_k, to_m, to_k, leaves, saved = runs
                end = to_m == none
                cols = [pa.array(name_m), pa.array(name_k), pa.array(to_m, mask=end), pa.array(to_k, mask=end), pa.array(leaves), pa.array(saved)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(end), bool)), *cols, *[pa.nulls(len(end), pa.int64())] * 4], names=names)

        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows >= block:
                yield from out()
                waiting, rows = [], 0
        if rows:
            yield from out()

    arcs = tour.select("m", "d", "pm", "next", "child", "n", "n_children", "words")
    return written(arcs.repartitionByRange("m", "d").sortWithinPartitions("m", "d").mapInArrow(
        contract, "is_run boolean, " + ", ".join(f"{n} long" for n in names[1:])), "trie-arcs")


def ranked(runs: DataFrame) -> DataFrame:
    """(run_m, run_k, leaves, saved): sums over each run and all that follow it on the tour, by pointer jumping."""
    now = runs.select(F.col("m").alias("run_m"), F.col("d").alias("run_k"), F.col("run_m").alias("to_m"), F.col("run_k").alias("to_k"),
                      "leaves", "saved")
    now = written(now, "trie-runs")
    while now.where("to_m is not null").limit(1).count():
        ahead = now.select(F.col("run_m").alias("to_m"), F.col("run_k").alias("to_k"), F.col("to_m").alias("far_m"), F.col("to_k").alias("far_k"),
                           F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        moved = now.where("to_m is not null").join(ahead, ["to_m", "to_k"]).select(
            "run_m", "run_k", F.col("far_m").alias("to_m"), F.col("far_k").alias("to_k"),
            (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"))
        then, now = now, written(moved.unionByName(now.where("to_m is null")), "trie-runs")
        dropped(then)
    return now.drop("to_m", "to_k")


def ends_of(prefix: DataFrame, lengths: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256): conversations that end at a node, as one text of their ids.

    Ids are joined to pieces of text where they lie, and the pieces of one node hashed as a stream: no task holds more
    than a batch of them.
    """
    last = prefix.groupBy("c").agg(F.max_by(F.struct("d", "p1", "p2"), "d").alias("e")).select("c", "e.*")
    none = F.lit(0).cast("long")
    last = last.unionByName(lengths.where("length = 0").select("c", none.alias("d"), none.alias("p1"), none.alias("p2")))
    key = ["d", "p1", "p2"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        """Stretches of rows of one node inside a batch, in order."""
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            at = 0
            for k in range(1, len(rows) + 1):
                if k == len(rows) or rows[k][:3] != rows[at][:3]:
                    yield rows[at][:3], [r[3:] for r in rows[at:k]]
                    at = k

    def table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string() if isinstance(v, str) else pa.int64() for v in rows[0][3:]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node, ids in groups(batches):
            out += [(*node, ids[s][0], ",".join(str(c) for c, in ids[s:s + CHUNK])) for s in range(0, len(ids), CHUNK)]
            if len(out) >= 1000:
                yield table(out, [*key, "first", "ids"])
                out = []
        if out:
            yield table(out, [*key, "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, hashlib.sha256(), []
        for node, found in groups(batches):
            if node != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(ids for _, ids in found).encode())
            if len(out) >= 1000:
                yield table(out, [*key, "ends_sha256"])
                out = []
        if now is not None:
            yield table([*out, (*now, digest.hexdigest())], [*key, "ends_sha256"])

    text = last.select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key, "c").mapInArrow(
        pieces, "d long, p1 long, p2 long, first long, ids string")
    return text.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(
        hashes, "d long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of sequences: ``rows`` (c, idx from 1 without gaps, l1, l2, words), ``lengths`` (c, length).

    Per node: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes
    of its subtree, itself included), saved_tokens (over its subtree: members but one, times words of the node's turn)
    and ends_sha256 (ids of members that end here, ascending, joined by commas).  Sequences without turns belong to the
    root alone.  Without sequences there is no node.
    """
    prefix, lengths = written(prefixes(rows), "trie-prefixes"), written(lengths, "trie-lengths")
    nodes = nodes_of(prefix, lengths)
    arcs = contracted(with_siblings(nodes), block)
    sums = ranked(arcs.where("is_run"))
    way = arcs.where("not is_run").select("m", "d", "run_m", "run_k", "leaves", "saved", "out_m", "out_k", "out_leaves", "out_saved")
    into = sums.withColumnsRenamed({"leaves": "in_rest", "saved": "in_rest_saved"})
    outof = sums.withColumnsRenamed({"run_m": "out_m", "run_k": "out_k", "leaves": "out_rest", "saved": "out_rest_saved"})
    way = way.join(into, ["run_m", "run_k"]).join(outof, ["out_m", "out_k"])
    leaf, own = (F.col("n_children") == 0).cast("long"), (F.col("n") - 1) * F.col("words")

    def between(total: str, rest: str, at_entry: Column) -> Column:
        """Sum up to the way out, less the sum up to and with the way in, and the entry's own share."""
        return (F.col(f"out_{total}") - F.col(f"out_{rest}")) - (F.col(total) - F.col(f"in_{rest}")) + at_entry

    out = nodes.join(way, ["m", "d"]).join(ends_of(prefix, lengths), ["d", "p1", "p2"], "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", between("leaves", "rest", leaf).alias("n_leaves"), between("saved", "rest_saved", own).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations (see ``rebuilt``) of a table with conv_id, turn, role and text.

    Null roles and texts are empty; a null turn comes first, equal turns in order of their digests, and repeated rows are
    turns each; rows without a conv_id are left out; extra columns are not read; an empty table gives no rows.
    """
    return prefix_trie(*rebuilt(turns_of(conversations)), block=block)
