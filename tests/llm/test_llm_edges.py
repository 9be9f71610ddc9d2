"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns, and on an empty table."""

from __future__ import annotations

import pytest
from fixtures import frame, odd_rows

from tessera.llm import bpe, brown_lm, decontamination, langid, pii, quality_rules, sharding, simhash, suffix_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _labels(spark, some=True):
    rows = [(k, k % 2, k % 2) for k in range(20, 40)] + [(20, 1, 1), (None, 0, 1), (21, None, None)]
    return spark.createDataFrame(rows if some else [], "doc_id long, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, "same words"), (2, None), (3, ""), (1, "same words")], "item_id long, text string")


OPERATORS = {
    "suffix": lambda s, d: suffix_dedup.without_repeats(d),
    "quality": lambda s, d: quality_rules.quality_verdicts(d, _labels(s))[0],
    "quality_no_labels": lambda s, d: quality_rules.quality_verdicts(d, _labels(s, False))[0],
    "lm": lambda s, d: brown_lm.lm_scores(d),
    "pii": lambda s, d: pii.detected(d),
    "scrub": lambda s, d: pii.scrubbed(d),
    "shard": lambda s, d: sharding.hilbert_shards(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "bpe": lambda s, d: bpe.bpe_encoded(d, PATH),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, _labels(s)),
    "toxicity_no_labels": lambda s, d: toxicity.toxicity_scores(d, _labels(s, False)),
    "language": lambda s, d: langid.language_predictions(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_each_get_a_row(spark, name):
    rows = odd_rows()
    got = OPERATORS[name](spark, frame(spark, rows)).collect()
    order = lambda ids: sorted(ids, key=lambda k: (k is None, k or 0))
    assert order(r["doc_id"] for r in got) == order(k for k, _, _ in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


def test_filters_on_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    kept = one.collect()
    # one row for each component: no words (1, 2, 3 and a null id), the long text, the short ones
    assert sum(not (r["text"] or "").strip() for r in kept) == 1
    assert [r["doc_id"] for r in kept if r["text"] == "same words"] == [6]
    assert [r["doc_id"] for r in kept if (r["text"] or "") == rows[5][1]] == [4]
    clean = decontamination.decontaminated(docs, _benchmark(spark))
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - 3
    pairs = decontamination.contaminated_pairs(docs, _benchmark(spark)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in pairs) == [(6, 1), (7, 1)]
    assert toxicity.without_toxic(docs, _labels(spark, False)).count() == len(rows)
    assert decontamination.decontaminated(frame(spark, []), _benchmark(spark)).count() == 0
    assert decontamination.contaminated_pairs(docs, _benchmark(spark).limit(0)).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_defined_values_of_empty_texts(spark):
    docs = frame(spark, [(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (4, "some words in a text", "en")])
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    q = by(quality_rules.quality_verdicts(docs, _labels(spark, False))[0])
    assert q[1]["n_words"] == q[2]["n_words"] == 0 and q[1]["base_failed"] and not q[1]["kept"]
    assert by(simhash.simhash_components(docs))[1]["fingerprint"] == "0" * 16
    lm = by(brown_lm.lm_scores(docs))
    assert lm[1]["n_tokens"] == lm[2]["n_tokens"] == 1
    lang = by(langid.language_predictions(docs))
    assert [lang[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and lang[1]["score"] == 0
    size = by(sharding.hilbert_shards(docs))
    assert size[1]["size"] == size[2]["size"] == 1 and size[1]["text_crc32"] == 0
    text = by(bpe.bpe_encoded(docs, PATH))
    assert bytes(text[1]["_ids"]) == b"" and text[1]["_decoded"] == ""
    assert by(suffix_dedup.without_repeats(docs))[1]["n_bytes"] == 0
