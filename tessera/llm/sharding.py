"""Hilbert-curve sharding: rows sorted along a space-filling curve over several metadata dimensions, cut in equal runs.

Only DataFrame functions.  Each dimension is quantised to ``2**bits`` cells: numbers at approximate quantiles, text at
quantiles of a bounded hash sample of its distinct values (order kept, so the min/max statistics of the files prune).
The cell's place on the curve comes from the cell table, whose size is fixed by ``bits`` and the number of dimensions,
never by the rows.  Ranks are counts of cells, then counts of hash slices inside a cell, then a window inside one slice:
no task sees a whole cell, however many rows it holds, and equal rows are counted before they are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import written

SLICES = 256  # hash slices of a cell: each is one window group
VALUE_SAMPLE = 4096  # distinct values of a text dimension that set its boundaries


def boundaries(df: DataFrame, column: str, bits: int) -> list:
    """At most ``2**bits - 1`` ascending cut points of a column."""
    cells = 1 << bits
    if isinstance(df.schema[column].dataType, T.StringType):
        values = df.where(F.col(column).isNotNull()).groupBy(column).count()
        sample = values.orderBy(F.xxhash64(column), column).limit(VALUE_SAMPLE).select(column)
        found = sorted((r[0] for r in sample.collect()), key=lambda v: v.encode())
        if len(found) <= cells:
            return found[1:]
        return list(dict.fromkeys(found[len(found) * k // cells] for k in range(1, cells)))
    at = [k / cells for k in range(1, cells)]
    cuts = df.agg(F.percentile_approx(column, at, 10_000).alias("cuts")).first()["cuts"] or []
    return sorted(set(cuts))


def cell_of(column: str, cuts: list) -> Column:
    """Number of cut points at or below the value; null is cell 0."""
    if not cuts:
        return F.lit(0)
    passed = reduce(lambda a, b: a + b, [F.when(F.col(column) >= F.lit(c), 1).otherwise(0) for c in cuts])
    return F.coalesce(passed, F.lit(0))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve (axes to transposed index, then its bits interleaved), with array functions."""
    n = len(axes)

    def put(xs: Column, changes: dict[int, Column]) -> Column:
        return F.array(*[changes.get(k, xs[k]) for k in range(n)])

    xs = F.array(*[a.cast("int") for a in axes])
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    if steps:
        todo = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])

        def undo(state: Column, step: Column) -> Column:
            q, low = step["q"], step["q"] - 1
            x = F.element_at(state, step["i"] + 1)
            swap = state[0].bitwiseXOR(x).bitwiseAND(low)
            return F.when(x.bitwiseAND(q) != 0, put(state, {0: state[0].bitwiseXOR(low)})).otherwise(
                F.transform(state, lambda v, k: F.when((k == 0) & (step["i"] == 0), v)
                            .when((k == 0) | (k == step["i"]), v.bitwiseXOR(swap)).otherwise(v)))

        xs = F.aggregate(todo, xs, undo)
    gray = F.aggregate(
        xs, F.array().cast("array<int>"),
        lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)).bitwiseXOR(x))))
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def finish(g: Column) -> Column:
        flip = F.aggregate(masks, F.lit(0), lambda t, q: F.when(
            F.element_at(g, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(g, lambda v: v.bitwiseXOR(flip))

    def interleave(g: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda out, b: F.aggregate(
            g, out, lambda o, v: o * 2 + F.call_function("getbit", v, b)))

    # each stage is bound once as the only element of an array, so no expression is repeated in the tree
    return F.transform(F.transform(F.array(gray), finish), interleave)[0]


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 5,
                   dimensions: tuple[str, ...] = ("size", "lang", "source")) -> DataFrame:
    """Assign every row to one of ``shards`` runs of the curve; row counts differ by one at most (law ``rows``).

    Columns: doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null text: that of the empty
    one), law, shard, slot (gapless from 0 within the shard), grown_shard (null: this law re-cuts all shards), curve.
    A dimension the input lacks counts as null; null ids and repeated rows are dealt like any other row; an empty
    table gives an empty result; columns beside the dimensions are not read.
    """
    have = set(docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = [d for d in dimensions if d != "size"]
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.col(d) if d in have else F.lit(None).cast("string")).alias(d) for d in meta])
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rows = written(rows, "shard-rows")
    cells = [cell_of(d, boundaries(rows, d, bits)) for d in dimensions]
    code = reduce(lambda a, b: a * (1 << bits) + b, cells).cast("int")
    rows = rows.withColumn("cell", code).withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLICES)).cast("int"))

    # place of every hash slice: slices of a cell in order, cells in curve order; both tables are bounded by bits
    slices = rows.groupBy("cell", "slice").agg(F.sum("copies").alias("n"))
    width = len(dimensions)
    axes = [F.shiftright(F.col("cell"), bits * (width - 1 - k)).bitwiseAND((1 << bits) - 1) for k in range(width)]
    per_cell = slices.groupBy("cell").agg(F.sum("n").alias("cell_n")).withColumn("curve", hilbert_index(axes, bits))
    before_cell = F.sum("cell_n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1))
    per_cell = per_cell.select("cell", "curve", F.coalesce(before_cell, F.lit(0)).alias("cell_at"))
    in_cell = Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    places = slices.select("cell", "slice", F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("slice_at"))
    places = written(places.join(F.broadcast(per_cell), "cell"), "shard-places")
    total = int(rows.agg(F.sum("copies")).first()[0] or 0)

    own = Window.partitionBy("cell", "slice").orderBy("doc_id", "text_crc32", "size", *meta)
    before = F.coalesce(F.sum("copies").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("before", before).join(places, ["cell", "slice"])
    first = F.col("cell_at") + F.col("slice_at") + F.col("before")
    ranked = ranked.withColumn("rank", F.explode(F.sequence(first, first + F.col("copies") - 1)))

    base, more = divmod(total, shards)
    edge = more * (base + 1)  # the first `more` shards have one row more
    rank = F.col("rank")
    late = F.floor((rank - edge) / max(base, 1))
    shard = F.when(rank < edge, F.floor(rank / (base + 1))).otherwise(more + late)
    slot = F.when(rank < edge, rank % (base + 1)).otherwise((rank - edge) % max(base, 1))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
