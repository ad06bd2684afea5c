"""One query opN_<name> per operator, over whole tables; SQL says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm.common import documents, id_hash, labels
from reachlake.llm.bpe import encode_decode
from reachlake.llm.exact_dedup import exact_dedup
from reachlake.llm.lm import lm_scores
from reachlake.llm.mixing import mixed_weights
from reachlake.llm.oracle import SQL
from reachlake.llm.packing import pack_sequences
from reachlake.llm.pii import find_personal_data
from reachlake.llm.prefix_trie import prefix_trie
from reachlake.llm.quality import quality_verdicts
from reachlake.llm.resampling import resample
from reachlake.llm.secrets import scan_secrets
from reachlake.llm.simhash import simhash_components
from reachlake.llm.suffix_dedup import remove_repeats
from reachlake.llm.toxicity import score_toxicity, train_on


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_on(docs, labels(spark, sf_dir), hold_out=True)
    held_out = F.pmod(id_hash(), F.lit(5)) == 0
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_weights(documents(spark, sf_dir))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to seven decimals: further ones show the order in which a text's logarithms were added."""
    found = lm_scores(documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 7) for c in ("base_score", "score")})


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_bpe": op6_bpe,
    "op7_personal_data": op7_personal_data,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_lm_scores": op10_lm_scores,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_prefix_trie": op13_prefix_trie,
}

__all__ = ["QUERIES", "SQL"]
