"""Hand-made tables for the operators of the training-data pipeline."""

from __future__ import annotations

import random

#: Names that operators use inside; as extra columns of the input they must not clash.
EXTRA = ("fp", "least_id", "ids", "decoded", "text_sha256", "score", "toxicity", "added", "own_id", "own_hash", "n_words",
         "text_hash", "spans", "shard", "slot", "cell", "word", "class", "key", "root", "rank", "copies", "ranges", "turn")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

WORDS = "river stone paper cloud winter garden window market bridge silver copper forest engine letter summer candle " \
        "planet ocean harbor meadow valley tunnel ladder basket mirror pencil pillow rocket saddle ticket".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing", "ly"]) + str(rng.choice(["", ".", ","])) for _ in range(n))


def frame(spark, rows):
    """(doc_id, text, lang) rows with all extra columns."""
    full = [(k, t, lang, None if k is None else f"src{k % 3}", None if t is None else len(t), *["x"] * len(EXTRA))
            for k, t, lang in rows]
    return spark.createDataFrame(full, COLUMNS)


def odd_rows():
    """Null ids and texts, empty, blank and very long texts, ties and repeated rows, unusual characters."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (None, "no id here", "en"), (None, None, None),
            (4, long, "en"), (5, long, "fr"), (6, "same words", "en"), (6, "same words", "en"), (7, "same words", None),
            (8, "x" * 70_000, "de"), (9, "Ünïcödé ☃ 😀 \x00 ﷺ", "fr"), (10, "12345 67890 !!!", "en"), (11, "a", "en"),
            (12, "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (234) 567-8901", "en"), (12, "other text of the same id", "en")]
    return rows + [(20 + k, prose(rng, 60), rng.choice(["en", "fr", "de"])) for k in range(20)]
