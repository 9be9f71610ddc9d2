"""Quality rules: text statistics in native expressions and a decision list learned by sequential covering.

The learner works on labelled statistics only (numbers, no text).  Every step that looks at rows is a Spark aggregate:
the counts of both labels per statistic and bin among the rows that are still open.  The driver holds those bounded
tables (statistics x bins) and picks the condition; the list it emits is one ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAM = 5
BINS = 64  # bins of a statistic; their edges are the thresholds the learner may use
FEATURES = ("n_words", "mean_word_chars", "symbol_ratio", "capital_ratio", "bang_ratio", "digit_ratio",
            "dup_line_ratio", "repeat_word_ratio")


def without(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts over each whole text, in the row itself: no shuffle, no explode.

    A null text has no words, symbols or lines (all counts 0).  Repeated 5-word windows are found by their 64-bit
    hashes; windows are sorted only in texts that have a repeat.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.char_length(F.translate(s, WHITE, "")) > 0)
    step = docs.select(
        *keep, (F.char_length(text) - without(text, WHITE)).alias("word_chars"),
        without(text, SYMBOLS).alias("n_symbols"), without(text, CAPITALS).alias("n_capitals"),
        without(text, "!").alias("n_bangs"), without(text, "0123456789").alias("n_digits"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"), lines.alias("lines"))
    # each array is used more than once in the next step, so the optimizer keeps the steps apart
    step = step.select(
        *keep, "word_chars", "n_symbols", "n_capitals", "n_bangs", "n_digits",
        F.size("hashes").alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("hashes") < GRAM, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(F.col("hashes"), 1, F.greatest(F.size("hashes") - (GRAM - 1), F.lit(0))),
                        lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, GRAM)]))).alias("grams"))
    pairs = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    sort_needed = F.size(F.array_distinct("grams")) < F.size("grams")
    step = step.select(
        *[c for c in step.columns if c != "grams"], F.when(sort_needed, pairs).alias("pairs"))
    first, last = F.get("pairs", F.size("pairs") - 1), F.size("pairs")
    found = F.filter(
        F.transform("pairs", lambda p, k: F.when(
            ((k > 0) & (F.get("pairs", k - 1)["g"] == p["g"]))
            | ((k + 1 < last) & (F.get("pairs", k + 1)["g"] == p["g"])), p["i"]).otherwise(-1)), lambda i: i >= 0)
    step = step.select(
        *[c for c in step.columns if c != "pairs"],
        F.when(F.col("pairs").isNotNull() & first.isNotNull(), F.sort_array(found)).alias("at"))
    # a repeated window covers its five words, or as many as lie before the next repeated window
    covered = F.aggregate(
        F.transform("at", lambda i, k: F.least(F.lit(GRAM), F.coalesce(F.get("at", k + 1) - i, F.lit(GRAM)))),
        F.lit(0), lambda a, b: a + b)
    counts = [c for c in step.columns if c not in (*keep, "at")]
    return step.select(
        *keep, *[F.col(c).cast("long").alias(c) for c in counts],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """The learner's statistics: shares of words, characters and lines (0 where there are none)."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return stats.withColumns({
        "mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "n_words"),
        "capital_ratio": share("n_capitals", "word_chars"), "bang_ratio": share("n_bangs", "n_words"),
        "digit_ratio": share("n_digits", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_word_ratio": share("n_repeat_words", "n_words")})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds decides for class ``target``, none: the other class."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_index(self) -> Column:
        """0-based index of the first rule that holds, null if none does."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules))):
            out = F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}: {' and '.join(map(str, r))}" for k, r in enumerate(self.rules)) or "(no rule)"


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    at = [k / BINS for k in range(1, BINS)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(got[f] or [])) for f in FEATURES}


def _binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Bin of a value: how many thresholds lie below it, so bin > k means value > cuts[k]."""
    def bin_of(f: str) -> Column:
        edges = F.array(*[F.lit(float(c)) for c in cuts[f]]) if cuts[f] else F.array().cast("array<double>")
        return F.size(F.filter(edges, lambda e: F.col(f).cast("double") > e))

    return rows.select("positive", "grow", *[bin_of(f).alias(f) for f in FEATURES])


def _holds(rule: list[tuple[str, bool, int]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f) > k if above else F.col(f) <= k for f, above, k in rule], F.lit(True))


def _counts(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    """Per statistic and bin, how many positive and negative rows: one bounded aggregate."""
    long = rows.select("positive", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x"))
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
    for r in long.groupBy("x.f", "x.b").agg(
            F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).collect():
        out[r["f"]][r["b"]] = (r["p"], r["n"])
    return out


def _best(counts: dict, cuts: dict[str, list[float]]) -> tuple[float, tuple[str, bool, int] | None, int, int]:
    """The condition of the highest FOIL gain, with the rows it keeps; ties go to the earlier statistic and bin."""
    best: tuple[float, tuple[str, bool, int] | None, int, int] = (0.0, None, 0, 0)
    for f in FEATURES:
        p_all = sum(p for p, _ in counts[f].values())
        n_all = sum(n for _, n in counts[f].values())
        if not p_all:
            continue
        base = math.log2(p_all / (p_all + n_all))
        p_low = n_low = 0
        for k in range(len(cuts[f])):
            p, n = counts[f].get(k, (0, 0))
            p_low, n_low = p_low + p, n_low + n
            for above, p, n in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, above, k), p, n)
    return best


def learn_rules(labelled: DataFrame, max_rules: int = 16, max_conditions: int = 4,
                min_precision: float = 0.9, min_support: int = 5) -> DecisionList:
    """Sequential covering on rows with ``positive`` (boolean), ``key`` and the statistics of FEATURES.

    Two thirds of the rows grow a rule by FOIL gain, one third prunes it: trailing conditions go while the worth
    (p - n) / (p + n) does not fall.  A rule is kept if it holds at least ``min_support`` positives and
    ``min_precision`` of what it covers is positive on either part; what it covers leaves both parts.
    No labels, no positives or no rule of that precision: an empty list, which keeps everything.
    """
    base = labelled.where(F.col("positive").isNotNull()).select(
        "positive", (F.pmod(F.xxhash64("key"), F.lit(3)) != 0).alias("grow"), *FEATURES)
    cuts = _thresholds(base)
    rows = written(_binned(base, cuts).coalesce(64), "rule-statistics")
    learned = DecisionList()
    open_rows = F.lit(True)
    for _ in range(max_rules):
        left = rows.where(open_rows)
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            gain, condition, p, n = _best(_counts(left.where(F.col("grow") & _holds(rule))), cuts)
            if condition is None or p < min_support:
                break
            rule.append(condition)
            if not n:
                break
        if not rule:
            break
        tested = left.agg(*[F.count_if(_holds(rule[:k]) & (F.col("positive") == want) & (F.col("grow") == grow))
                            .alias(f"c{k}_{int(want)}_{int(grow)}")
                            for k in range(1, len(rule) + 1) for want in (True, False) for grow in (True, False)]).first()

        def worth(k: int, t=tested) -> float:
            p, n = t[f"c{k}_1_0"], t[f"c{k}_0_0"]
            return (p - n) / (p + n) if p + n else -1.0

        rule = rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        k = len(rule)
        right = [(tested[f"c{k}_1_{g}"], tested[f"c{k}_0_{g}"]) for g in (0, 1)]
        if right[1][0] < min_support or any(p < min_precision * (p + n) for p, n in right):
            break
        learned.rules.append([Condition(f, above, float(cuts[f][b])) for f, above, b in rule])
        open_rows = open_rows & ~_holds(rule)
    return learned


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict of every document, and the list learned from ``labels`` (doc_id, quality 0 or 1).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (index of
    the deciding rule, null if none).  Null and empty texts fail the base rules.  Rows without an id or a label are
    judged but not learned from; a label that contradicts another of the same id removes both; extra columns are
    not read; an empty table gives an empty result.
    """
    stats = written(with_features(text_statistics(docs, "doc_id")), "text-statistics")
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    seen = stats.join(truth, "doc_id").select(
        (F.col("low") == 0).alias("positive"), F.col("doc_id").alias("key"), *FEATURES)
    rules = learn_rules(seen, **options)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("rule", rules.rule_index()).withColumn("base_failed", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule"), rules
