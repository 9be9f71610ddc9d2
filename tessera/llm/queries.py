"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import without_repeats

    out = without_repeats(read(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_verdicts

    return quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))[0]


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.brown_lm import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import KINDS, detected, listed, of_kind

    out = detected(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("spans", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import hilbert_shards

    return hilbert_shards(read(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"), shingle=3, radius=3)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import bpe_encoded

    out = bpe_encoded(read(spark, sf_dir, "documents").select("doc_id", "text"),
                      public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import language_predictions

    return language_predictions(read(spark, sf_dir, "documents"))


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import contaminated_pairs

    return contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import conversation_trie

    return conversation_trie(read(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.alignment import TwoTokenizers, aligned, with_link_counts

    two = TwoTokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = aligned(read(spark, sf_dir, "documents"), two)
    digest = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = with_link_counts(rows.withColumn("groups", digest), two.width)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.byte_bpe import byte_bpe_encoded

    out = byte_bpe_encoded(read(spark, sf_dir, "documents").select("doc_id", "text"),
                           public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query, in the order of the operators."""
    return {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_brown_lm,
                                  op4_bootstrapped_pii, op5_hilbert_sharding, op6_simhash_near_dedup, op7_bpe_round_trip,
                                  op8_toxicity, op9_language_id, op10_latent_decontamination, op11_conversation_trie, op12_token_alignment, op13_byte_bpe)}


#: crc32 of a conversation's decimal id, bit by bit; digests order equal turns as the operator does; a node's subtree is
#: reached over the paths of members instead of a tour.
CONVERSATION_TRIE = r"""
WITH turns AS (
  SELECT conv_id AS c, turn AS t, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL),
digests AS (
  SELECT *, sha256(length(role) || ':' || role || body) AS dig,
         len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM turns),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, dig[1:15], dig[17:31]) AS pos FROM digests),
convs AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
bytes AS (SELECT c, n, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM convs),
crc AS (
  SELECT c, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda state, byte:
    list_reduce([xor(state, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 4 AS h FROM bytes),
info AS (
  SELECT crc.c, crc.n, h, least(h, coalesce(b.n, 0)) AS k FROM crc LEFT JOIN convs b ON b.c = crc.c - crc.c % 20),
seq AS (
  SELECT i.c, p.pos AS idx, p.dig, p.words FROM info i JOIN placed p ON p.c = i.c - i.c % 20 AND p.pos <= i.k
  UNION ALL
  SELECT i.c, p.pos - i.h + i.k, p.dig, p.words FROM info i JOIN placed p ON p.c = i.c AND p.pos > i.h),
lengths AS (SELECT c, k + greatest(n - h, 0) AS length FROM info),
pre AS (
  SELECT c, idx AS d, sha256(string_agg(dig, '') OVER (PARTITION BY c ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS prefix, words FROM seq
  UNION ALL SELECT c, 0, 'root', 0 FROM info),
nodes AS (SELECT d, prefix, min(c) AS m, count(*) AS n, min(words) AS words FROM pre GROUP BY d, prefix),
path AS (SELECT pre.c, pre.d, nodes.m FROM pre JOIN nodes USING (d, prefix)),
parents AS (SELECT nodes.*, path.m AS pm FROM nodes LEFT JOIN path ON path.c = nodes.m AND path.d = nodes.d - 1),
kids AS (SELECT pm AS m, d - 1 AS d, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT parents.*, coalesce(n_children, 0) AS n_children FROM parents LEFT JOIN kids USING (m, d)),
sub AS (
  SELECT path.m, path.d, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n - 1) * v.words) AS saved_tokens
  FROM full_nodes v JOIN path ON path.c = v.m AND path.d <= v.d GROUP BY ALL),
ends AS (
  SELECT path.m, path.d, sha256(string_agg(CAST(path.c AS VARCHAR), ',' ORDER BY path.c)) AS ends
  FROM path JOIN lengths ON lengths.c = path.c AND lengths.length = path.d GROUP BY ALL)
SELECT m AS conv_id, d AS depth, pm AS parent_conv_id, n AS n_convs, n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM full_nodes JOIN sub USING (m, d) LEFT JOIN ends USING (m, d)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB twins; the other results rest on learned models, tokenizers or 64-bit hashes, so tests use brute force."""
    return {"op11_conversation_trie": CONVERSATION_TRIE}
