"""The pipeline on planted rows, stage by stage."""

from __future__ import annotations

import random

import pytest
from fixtures import prose

import __spark_entry__ as ent

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    bad = "grubnak fizzlord snarvex".split()
    rows, labels = [], []
    for k in range(600):
        words = (prose(rng, rng.randint(40, 120)) + f" unique{k} mark{k * 7}").split()
        if k % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 5 == 0)))
    item = "benchmark passage " + prose(rng, 40)
    clean = [t for k, t in rows if k % 5]
    rows += [(1000, clean[0]), (1001, clean[0]), (1002, f"{clean[1][:200]} {item} tail words"),
             (1003, clean[2][:200] + " mail me at someone@example.org soon"), (1004, None), (1005, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(k, t, "en", f"src{k % 4}", None if t is None else len(t)) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, path), f"test-{name}")
        out[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns[:5] == columns and (name == "bpe" or docs.columns == columns)
    toxic = {k for k, _ in rows if k < 1000 and k % 5 == 0}
    left = {k for k, _ in rows} - set(out["toxicity"])
    assert len(left & toxic) >= 0.95 * len(toxic) and len(left - toxic) <= 5
    near = set(out["simhash_near_dedup"])
    assert not near & {1000, 1001} and 1 in near and near >= set(out["toxicity"]) - {1000, 1001, 1005} - {1003}
    assert set(out["decontamination"]) == near - {1002}
    assert set(out["pii"]) == set(out["decontamination"])
    assert "someone@example.org" not in "".join(r["text"] or "" for r in out["pii"].values())
    if 1003 in out["pii"]:
        assert "[EMAIL]" in out["pii"][1003]["text"]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in out["bpe"].values())


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "decontamination", "pii", "bpe"]
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 400 and "n_tokens" in got.columns


def test_registered():
    names = list(ent.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
