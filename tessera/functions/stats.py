"""Statistical building blocks shared by the operators.

Exact, pandas-compatible (linear interpolation) quantiles per group without gathering a group's rows into one task.
An approximate quantile sketch (partial aggregate, bounded size, rank error at most 1 / SKETCH) gives for each target a
bracket of values that holds it; a second pass counts the rows below the bracket (a bit per bracket, no row is
multiplied) and the distinct values inside it, both on the map side; only the bracket's values, about 2 * MARGIN of a group, are ranked.  Far outliers and heavy ties
don't matter, as brackets follow ranks, not values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


SKETCH = 2000  # accuracy of the sketch: ranks are off by at most a SKETCH-th of the rows; its size is what tasks send and merge
MARGIN = 0.002  # ranks a bracket reaches to either side of its target, four times that error
LEAST = 2000  # groups with fewer rows are bracketed as a whole: a margin of theirs is too few rows
MAX_GROUPS = 100_000  # groups whose sketches are broadcast; beyond, they are joined
STEPS = 64  # steps of a histogram for each doubling of a value
PARTS = 4096  # parts into which a crowded step is cut
CROWDED = 0.05  # share of a group's rows beyond which a bracket is cut again


def quantile_sketch(values: dict[str, Column], probs: dict[str, float]) -> list[Column]:
    """Aggregates that ``quantiles_from_sketch`` needs, one struct per value."""
    ranks = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs.values() for d in (-MARGIN, MARGIN)])
    return [F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                     F.percentile_approx(v, ranks, SKETCH).alias("cuts")).alias(f"_s_{name}")
            for name, v in values.items()]


def quantiles_from_sketch(df: DataFrame, keys: Sequence[str], sketch: DataFrame, values: dict[str, Column],
                          probs: dict[str, float]) -> DataFrame:
    """Exact quantiles from a materialized sketch of the same rows: ``keys`` and ``<value>_<prob>`` columns.

    Groups without a value of any kind are absent (without keys: one row of nulls)."""
    keys, names = list(keys), [f"_s_{v}" for v in values]
    if keys:
        small = sketch.select(*keys, *names)
        if small.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS:
            small = F.broadcast(small)
        rows = df.join(small, keys)
    else:
        row = sketch.select(*names).first()
        rows = df

        def literal(name, part):
            v = row[name][part]
            return F.lit(v).cast("double" if part != "n" else "long")

    def part(name, field):
        return F.col(name)[field] if keys else literal(name, field)

    def cut(name, k):
        if keys:
            return F.get(F.col(name)["cuts"], F.lit(k))
        return F.lit((row[name]["cuts"] or [None] * (k + 1))[k]).cast("double")

    below, inside, targets, held = F.lit(0).cast("long"), [], [], None
    for name, v in values.items():
        s = f"_s_{name}"
        whole = part(s, "n") < LEAST
        for k, (prob, p) in enumerate(probs.items()):
            lo = F.when(whole, part(s, "lo")).otherwise(cut(s, 2 * k))
            hi = F.when(whole, part(s, "hi")).otherwise(cut(s, 2 * k + 1))
            below = below + F.when(v < lo, F.lit(1 << len(targets)).cast("long")).otherwise(F.lit(0).cast("long"))
            hit = F.coalesce((v >= lo) & (v <= hi), F.lit(False))
            held = hit if held is None else held | hit
            inside.append(F.when(hit, F.struct(F.lit(len(targets)).alias("q"), v.alias("x"))))
            targets.append((f"{name}_{prob}", p, part(s, "n")))
    # most rows lie in no bracket: they stay as they are, one bit for every bracket they lie below
    found = rows.select(*keys, below.alias("_below"), F.posexplode_outer(F.when(held, F.array(*inside))).alias("_pos", "_i"))
    found = found.where((F.coalesce("_pos", F.lit(0)) == 0) | F.col("_i").isNotNull()).groupBy(*keys, F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_below")).alias("_below"),
                          F.col("_i.q").alias("_q"), F.col("_i.x").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    if keys:
        found = found.join(small, keys)
    counts = F.array(*[n for _, _, n in targets])
    parts = [F.when(F.col("_q").isNotNull(), F.struct("_q", "_x"))] + [
        F.when(F.col("_below").bitwiseAND(F.lit(1 << q)) != 0, F.struct(F.lit(q).alias("_q"), F.lit(None).cast("double").alias("_x")))
        for q in range(len(targets))]
    # x is null for all that lies below the bracket
    found = found.select(*keys, "_c", counts.alias("_ns"), F.explode(F.array_compact(F.array(*parts))).alias("_p")).select(
        *keys, "_p._q", "_p._x", "_c", F.get("_ns", F.col("_p._q")).alias("_n"))
    order = Window.partitionBy(*keys, "_q").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(p)) for _, p, _ in targets]), F.col("_q"))
    ranked = found.withColumn("_cum", F.sum("_c").over(order)).withColumn("_h", at).where(F.col("_x").isNotNull())
    picked = ranked.groupBy(*keys, "_q").agg(
        F.min(F.when(F.col("_cum") > F.floor("_h"), F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil("_h"), F.col("_x"))).alias("_b"),
        F.first(F.col("_h") - F.floor("_h")).alias("_f"))
    value = F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == k, value)).alias(name)
                                       for k, (name, _, _) in enumerate(targets)])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys``; nulls ignored.

    Returns ``keys`` and one DOUBLE column per entry of ``probs`` (output name to probability), interpolated linearly
    between order statistics like pandas / ``percentile``.  Groups with only nulls are absent; without keys the
    result is one row."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    values = {"q": F.col("_v")}
    sketch = cut_lineage(rows.groupBy(*keys).agg(*quantile_sketch(values, probs)))
    out = quantiles_from_sketch(rows, keys, sketch, values, probs)
    return out.withColumnsRenamed({f"q_{name}": name for name in probs})


def _step(v: Column) -> Column:
    """A whole number that follows the order of the doubles ``v``: ``STEPS`` for each doubling, on either side of zero."""
    def size(x: Column) -> Column:
        return F.floor(F.least(F.log(x), F.lit(800.0)) * (STEPS / math.log(2))) + F.lit(1 << 20)

    return F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0).cast("long"))


def _histogram(values: DataFrame, by: Sequence[str], step: Column) -> DataFrame:
    return values.withColumn("_k", step).groupBy(*by, "_k").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))


def _ranked(counts: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``counts`` (with ``_c``, ``_n`` and ``_under``, the values below all of them) with running counts and the target's rank."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_cum", F.col("_under") + F.sum("_c").over(w))


def _brackets(hist: DataFrame, by: Sequence[str], p: float) -> DataFrame:
    """Per group the least and largest value of the steps that hold the target, and how many values lie below and inside."""
    h = (F.col("_n") - 1) * F.lit(float(p))
    first, last = F.col("_cum") > F.floor(h), F.col("_cum") > F.ceil(h)
    out = _ranked(hist, by, "_k").groupBy(*by, "_n", "_was").agg(
        F.min(F.when(first, F.col("_lo"))).alias("_lo"), F.min(F.when(last, F.col("_hi"))).alias("_hi"),
        F.min(F.when(first, F.col("_cum") - F.col("_c"))).alias("_under"), F.min(F.when(last, F.col("_cum"))).alias("_to"))
    return cut_lineage(out.withColumn("_in", F.col("_to") - F.col("_under")).drop("_to"))


def grouped_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column], p: float = 0.5) -> DataFrame:
    """Exact medians (or another quantile ``p``) of several values of few groups: ``keys`` and a DOUBLE column per value.

    A histogram of logarithmic steps, counted on the map side, says which step holds the target and how many values lie
    below it; a second pass counts the distinct values of that step only.  A step that holds a large share of its group is cut
    into equal parts before that, again while this helps, so neither outliers nor a narrow range gather a group's
    rows; ties are counted, not gathered.  Nulls are ignored; a value that a group lacks is null, a group without any is absent.
    """
    keys = list(keys)
    names = {f"_v{i}": name for i, name in enumerate(values)}
    by = [*keys, "_m"]
    wide = df.select(*keys, *[v.cast("double").alias(c) for c, v in zip(names, values.values())])

    def inside(brackets: DataFrame) -> DataFrame:
        """The values in their brackets, a row each; all other rows go before they are multiplied."""
        b = brackets.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == c, F.col(x))).alias(f"{x}{c}") for c in names for x in ("_lo", "_hi")])
        held = wide.join(F.broadcast(b), keys).select(*keys, *[
            F.when((F.col(c) >= F.col(f"_lo{c}")) & (F.col(c) <= F.col(f"_hi{c}")), F.col(c)).alias(c) for c in names])
        return held.where(F.coalesce(*names).isNotNull()).unpivot(keys, list(names), "_m", "_x").where(F.col("_x").isNotNull())

    long = wide.unpivot(keys, list(names), "_m", "_x").where(F.col("_x").isNotNull())
    hist = cut_lineage(_histogram(long, by, _step(F.col("_x"))))
    n = F.sum("_c").over(Window.partitionBy(*by))
    brackets = _brackets(hist.select("*", n.alias("_n"), F.lit(0).cast("long").alias("_under"), (n * 4).alias("_was")), by, p)
    while True:
        full = ((F.col("_in") > F.greatest(F.lit(float(LEAST)), F.col("_n") * CROWDED)) & (F.col("_in") * 2 <= F.col("_was"))
                & (F.col("_lo") < F.col("_hi")) & (F.abs("_lo") < math.inf) & (F.abs("_hi") < math.inf))
        crowded = brackets.where(full)
        if crowded.isEmpty():
            break
        lo, hi = F.col("_from") / 2, F.col("_till") / 2  # halves: their difference is a double
        ends = F.broadcast(crowded.select(*by, "_n", "_under", F.col("_in").alias("_was"), F.col("_lo").alias("_from"), F.col("_hi").alias("_till")))
        parts = _histogram(inside(crowded).join(ends, by), [*by, "_n", "_under", "_was"], F.floor((F.col("_x") / 2 - lo) / (hi - lo) * PARTS))
        finer = _brackets(parts, by, p)
        brackets = cut_lineage(brackets.where(~full).unionByName(finer))
    found = inside(brackets).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    found = _ranked(found.join(F.broadcast(brackets.select(*by, "_n", "_under")), by), by, "_x")
    h = (F.col("_n") - 1) * F.lit(float(p))
    picked = found.groupBy(*by, "_n").agg(F.min(F.when(F.col("_cum") > F.floor(h), F.col("_x"))).alias("_a"),
                                          F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_x"))).alias("_b"))
    value = F.col("_a") + (h - F.floor(h)) * (F.col("_b") - F.col("_a"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == c, value)).alias(name) for c, name in names.items()])


def corr_from_sums(x, y) -> Column:
    """Pearson correlation as an aggregate; NULL (not an error) when a side
    is constant.  Spark's ``corr`` raises under ANSI on zero variance."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    n = F.sum(F.when(both, 1.0))
    sx, sy = F.sum(F.when(both, x)), F.sum(F.when(both, y))
    sxx, syy = F.sum(F.when(both, x * x)), F.sum(F.when(both, y * y))
    sxy = F.sum(F.when(both, x * y))
    cov = sxy - sx * sy / n
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    return F.try_divide(cov, F.sqrt(vx * vy))


def skew_adjusted(x) -> Column:
    """Bias-corrected sample skewness (pandas ``skew``) as an aggregate."""
    n = F.count(col(x)).cast("double")
    g1 = F.skewness(col(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def r6(x) -> Column:
    """Round a DOUBLE to 6 decimals (value-oracle comparisons)."""
    return F.round(col(x).cast("double"), 6)


def ratio(num, den) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))
