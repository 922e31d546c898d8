"""The ``opN_`` queries, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, decontam, fst_tokens, mixing, pfor, pii, quality_knn, rule_cascade, sharding, simhash_gph
from .storage import shared_dir
from .text import WORD


TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_path(spark: SparkSession, use: str) -> str:
    """Where the slot map of one use is kept from run to run."""
    return f"{shared_dir(spark)}/ledgerline/slot-maps/{hashlib.md5(use.encode()).hexdigest()}"


def op1_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 16, map_path=map_path(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_gph_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gph.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op7_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = fst_tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer())
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_pfor_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_id_files(table(spark, sf_dir, "documents"), tokenizer())


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_slot_sharding, op2_knn_quality, op3_gph_simhash, op4_bloom_lm, op5_rule_cascade, op6_systematic_mix, op7_fst_token_counts, op8_pfor_token_ids, op9_pii_spans, op10_minhash_containment)}


def op5_sql() -> str:
    rules = " AND ".join(f"NOT ({r.rejects})" for r in rule_cascade.RULES).replace(", '{g}')", ", '', 'g')")
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
win AS (SELECT r, i, ws[i : i + 4] AS v FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) t(k) GROUP BY r),
m AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {rules} AS kept FROM m"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10_SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, q, k, ws[j : j + k - 1] AS v FROM (SELECT *, least(5, len(ws)) AS k FROM b WHERE len(ws) > 0), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS j)),
n AS (SELECT item_id, q, count(*) AS n FROM i GROUP BY ALL),
s AS (SELECT DISTINCT doc_id, r, k, ws[j : j + k - 1] AS v FROM d, (SELECT DISTINCT k FROM i), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS j)),
h AS (SELECT doc_id, r, item_id, q, count(*) AS c FROM s JOIN i USING (k, v) GROUP BY ALL)
SELECT doc_id, item_id, c / n AS containment FROM h JOIN n USING (item_id, q) WHERE c / n >= 0.8"""


def oracle_sql() -> dict[str, str]:
    """For op5 and op10; the others hash with functions that SQL lacks or fit a model, and are tested by brute force."""
    return {"op5_rule_cascade": op5_sql(), "op10_minhash_containment": OP10_SQL}
