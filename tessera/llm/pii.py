"""PII by bootstrapped contextual extraction.

Strict patterns find emails, IP addresses, card and phone numbers; these are the seeds.  The words around them induce
lexical patterns: the word before, the word after, or a key written on to the value (``key=value``), each with the
coarse shape of the value.  Spark scores the graph of patterns and instances in rounds: a pattern's confidence is the
share of its context's occurrences in the whole corpus that hold a known identifier of a kind, an instance's is one
minus the product of its patterns' doubts.  Instances over the bound become known and vote for further patterns, until
a round adds none.  Whatever failed a strict check (Luhn, number ranges) is evidence against, and never added.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, free_name, texts_of, written

KINDS = ("email", "ip", "card", "phone")

# The strict patterns of the kinds, so written that a failed run of characters is left at once: an address is
# sought from its @, a dotted number from the start of a run of digits.
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}
MARK = re.compile(r"[0-9@]")  # no identifier is without one
CANDIDATE = re.compile(r"\(?\+?[0-9][0-9()./-]*(?: \(?[0-9][0-9()./-]*)+|[^ \t\n\x0b\x0c\r]+")
SPACE = " \t\n\x0b\x0c\r"
EDGES = ".,;:!?\"'()[]{}<>"
LEAST_SEEDS = 3  # distinct known instances a pattern needs
LEAST_SHARE = 0.5  # of its context's occurrences that hold a known instance
LEAST_BELIEF = 0.7  # confidence at which an instance becomes known
NEAR = 64  # characters on either side of a span that a context word lies in
KEPT_WORDS = 200_000  # words counted before a task hands its counts on


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of local part, @ and dotted domain, leftmost first; each character is looked at once for each part."""
    at, mark = 0, text.find("@")
    while mark >= 0:
        local = text[at:mark]
        start = at + len(local.rstrip(LOCAL))
        found = DOMAIN.match(text, mark + 1) if start < mark else None
        if found:
            yield start, found.end()
        at = found.end() if found else mark + 1
        mark = text.find("@", at)


def strict_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind number, start, end) of what passes, by kind and start; (start, end) of what matched a kind and failed.

    A run of digits too short for any card is not held against: it says nothing of the kind.  Linear in the text.
    """
    good, bad = [], []
    for k, kind in enumerate(KINDS):
        if kind == "phone" and "+" not in text:
            continue
        spans = addresses(text) if kind == "email" else (m.span() for m in PATTERNS[kind].finditer(text))
        for s, e in spans:
            found = text[s:e]
            if passes(kind, found):
                good.append((k, s, e))
            elif kind != "card" or sum(map(str.isdigit, found)) >= 12:
                bad.append((s, e))
    return good, bad


def shape(value: str) -> str:
    """Coarse form of a value: address, dotted number, digits, digits in groups, or letters with digits."""
    if "@" in value:
        return "address"
    if value.isdigit():
        return "digits"
    if re.fullmatch(r"[0-9]+(\.[0-9]+)+", value):
        return "dotted"
    return "groups" if re.fullmatch(r"[-+0-9 ().]+", value) else "mixed"


def _nearest(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a span that begin and end within ``NEAR`` characters of it; longer words are no context."""
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]
    left, right = before.split(), after.split()
    if len(left) == 1 and start > NEAR and not before[0].isspace():
        left = []
    if len(right) == 1 and end + NEAR < len(text) and not after[-1].isspace():
        right = []
    return left[-1] if left else "", right[0] if right else ""


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of a span: ``before word``, ``after word`` or ``key key=``."""
    left, right = _nearest(text, start, end)
    if left and start and text[start - 1] in "=:":
        return [f"key {left.lower()}"]
    return ([f"before {left.lower()}"] if left else []) + ([f"after {right.lower()}"] if right else [])


def found_in(text: str) -> tuple[list, list]:
    """Strict spans, and every identifier-like value: (start, end, kind number or -1 or -2 failed, shape, value, contexts)."""
    if not MARK.search(text):
        return [], []
    good, bad = strict_spans(text)
    values = [(s, e, k, shape(text[s:e]), text[s:e].lower(), contexts(text, s, e)) for k, s, e in good]
    taken: list[list[int]] = []  # what the strict patterns matched, joined where it overlaps
    for s, e in sorted([(s, e) for _, s, e in good] + bad):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    values += [(s, e, -2, shape(text[s:e]), text[s:e].lower(), contexts(text, s, e)) for s, e in bad]
    for s, e in _candidates(text):
        k = bisect_right(ends, s)
        if k == len(taken) or taken[k][0] >= e:
            values.append((s, e, -1, shape(text[s:e]), text[s:e].lower(), contexts(text, s, e)))
    return good, values


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Values with three digits or an ``@``: words, or groups of digits with single spaces between."""
    at = 0
    while m := MARK.search(text, at):
        s = m.start()
        while s > at and text[s - 1] not in SPACE:
            s -= 1
        m = CANDIDATE.match(text, s)
        e = at = m.end()
        key = max(text.rfind("=", s, e - 1), text.rfind(":", s, e - 1))
        s = max(s, key + 1) if "//" not in text[s:e] else s
        while s < e and text[s] in EDGES:
            s += 1
        while e > s and text[e - 1] in EDGES:
            e -= 1
        if e - s >= 5 and ("@" in text[s:e] or sum(map(str.isdigit, text[s:e])) >= 3):
            yield s, e


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans and values of every row: what the later steps need of the texts."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    span = "array<struct<k:int,s:int,e:int>>"
    value = "array<struct<s:int,e:int,k:int,shape:string,value:string,contexts:array<string>>>"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([(n, pa.int32()) for n in "kse"]))
        values = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32()), ("shape", pa.string()),
                                     ("value", pa.string()), ("contexts", pa.list_(pa.string()))]))
        for batch in batches:
            got = [found_in(t) for t in texts_of(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([[dict(zip("kse", s)) for s in g] for g, _ in got], spans),
                 pa.array([[dict(zip(("s", "e", "k", "shape", "value", "contexts"), v)) for v in vs] for _, vs in got], values)],
                names=["doc_id", "text_hash", "spans", "found"])

    return rows.mapInArrow(find, f"doc_id {kind}, text_hash long, spans {span}, found {value}")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often lower-cased words occur in all texts, in parts to be summed by word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for t in texts_of(batch, 0):
                seen.update(t.lower().split())
                if len(seen) >= KEPT_WORDS:
                    yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "word string, n long")


def bootstrapped(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(shape, value, k) of the instances the rounds add to the seeds."""
    found = places.select(F.explode("found").alias("f")).select("f.*")
    # the graph: how often each value occurs with each pattern (context and shape)
    graph = written(found.select("k", "shape", "value", F.explode(F.array_distinct("contexts")).alias("context"))
                    .groupBy("context", "shape", "value", "k").agg(F.count("*").alias("n")), "pii-graph")
    seeds = graph.where("k >= 0").select("shape", "value", "k").distinct()
    hopeful = graph.groupBy("context", "shape").agg(
        F.count_if(F.col("k") >= 0).alias("seeds"), F.count_if(F.col("k") == -1).alias("open"))
    # only contexts that can matter are looked up in the corpus counts: enough seeds, or next to an open value
    wanted = hopeful.where(f"seeds >= {LEAST_SEEDS} or open > 0").select("context").distinct()
    word = F.substring_index("context", " ", -1)
    words = written(wanted.where("context not like 'key %'").select("context", word.alias("word")), "pii-words")
    by_word = word_counts(docs).join(words, "word").groupBy("context").agg(F.sum("n").alias("n"))
    by_key = graph.where("context like 'key %'").groupBy("context").agg(F.sum("n").alias("n"))
    totals = written(by_word.unionByName(by_key), "pii-contexts")
    graph = written(graph.join(totals.withColumnRenamed("n", "total"), "context"), "pii-edges")
    known, added, count = seeds.withColumn("belief", F.lit(1.0)), None, -1
    failed = graph.where("k = -2").select("shape", "value").distinct()
    while True:
        votes = graph.join(known.withColumnRenamed("k", "kind"), ["shape", "value"])
        patterns = votes.groupBy("context", "shape", "kind").agg(
            F.count_distinct("value").alias("distinct"), F.sum(F.col("n") * F.col("belief")).alias("hits"),
            F.first("total").alias("total"))
        share = F.least(F.col("hits") / F.greatest(F.col("total"), F.lit(1)), F.lit(0.999))
        patterns = patterns.withColumn("share", share).where(f"distinct >= {LEAST_SEEDS} and share >= {LEAST_SHARE}")
        drawn = graph.where("k = -1").select("context", "shape", "value").distinct().join(
            patterns.select("context", "shape", "kind", "share"), ["context", "shape"])
        belief = (1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("belief")
        scored = drawn.groupBy("shape", "value", F.col("kind").alias("k")).agg(belief)
        best = scored.groupBy("shape", "value").agg(F.max_by(F.struct("k", "belief"), F.struct("belief", -F.col("k"))).alias("b"))
        best = best.select("shape", "value", "b.k", "b.belief").where(f"belief >= {LEAST_BELIEF}")
        best = best.join(failed, ["shape", "value"], "left_anti").join(seeds, ["shape", "value"], "left_anti")
        now = best if added is None else best.join(added, ["shape", "value"], "left_anti").unionByName(added)
        now = written(now, "pii-known")
        n = now.count()
        if n == count or not n:
            return now.select("shape", "value", "k")
        added, count, known = now, n, seeds.withColumn("belief", F.lit(1.0)).unionByName(now)


def added_spans(places: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, text_hash, added) for the rows that hold added instances outside their strict spans."""
    rows = places.where(F.exists("found", lambda v: v["k"] == -1)).select(
        "doc_id", "text_hash", F.explode("found").alias("f")).where("f.k = -1")
    hits = rows.select("doc_id", "text_hash", "f.s", "f.e", "f.shape", "f.value").join(new, ["shape", "value"])
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("k", "s", "e")).alias("added"))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (strict) and added (by bootstrapping) of every row, as arrays of (k, s, e).

    Places are code points, ends exclusive; k counts KINDS from 0.  Null and empty texts hold nothing; repeated rows
    each get a row; null ids are kept apart by their text; extra columns are not read; an empty table: no rows.
    """
    places = written(located(docs), "pii-places")
    new = bootstrapped(docs, places)
    added = written(added_spans(places, new), "pii-added").select(
        F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "added")
    out = places.select("doc_id", "text_hash", "spans").join(
        added, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return out.select("doc_id", "text_hash", "spans", F.coalesce("added", none).alias("added"))


def of_kind(k: int) -> Callable[[Column], Column]:
    """Whether a span is of the kind of that number (a filter of one parameter; a second one would be the place)."""
    return lambda span: span["k"] == F.lit(k)


def listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def scrubbed(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, each found span replaced by its kind in brackets; n_chars follows the text."""
    places = written(located(docs), "pii-places")
    added = written(added_spans(places, bootstrapped(docs, places)), "pii-added")
    own_id, own_hash, extra = (free_name(docs, n) for n in ("own_id", "own_hash", "added"))
    added = added.withColumnsRenamed({"doc_id": own_id, "text_hash": own_hash, "added": extra})
    both = docs.join(added, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left")
    both = both.select(*docs.columns, extra)
    names = docs.columns
    at, last = names.index("text"), len(names)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else covered(t, more or []) for t, more in
                     zip(batch.column(at).to_pylist(), batch.column(last).to_pylist())]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:last])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = both.mapInArrow(cover, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def covered(text: str, more: list[dict]) -> str:
    """The text with strict and further spans replaced; of spans that overlap, what they cover goes as one."""
    if not MARK.search(text):
        return text
    spans = sorted([(s, e, k) for k, s, e in strict_spans(text)[0]] + [(m["s"], m["e"], m["k"]) for m in more])
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
