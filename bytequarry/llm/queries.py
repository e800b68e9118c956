"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, media, mixture, nbsvm, neardup, phrases, pii, resample, suffix, tiles, tokens, warc
from .common import table

END_ID = 2
LENGTH = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op2_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents"))
    taken = F.col("mix_size") * F.col("mix_copies")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), F.col("mix_copies").alias("copies"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, LENGTH)


def op4_media_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.concatenate_and_cut(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, LENGTH).drop("ids")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)
    return judged.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), 400).drop("kept", "removed")


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_revisits(spark, sf_dir)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10000, percent=10, least_words=20, seed=2024)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), most=5, least=100, top=2000)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_imatch, op2_pareto_mixture, op3_best_fit_packing, op4_media_index, op5_near_duplicates,
        op6_personal_data, op7_concatenate_and_cut, op8_quality, op9_suffix_arrays, op10_revisits,
        op11_importance_resampling, op12_collocations, op13_jaccard_join,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_pareto_mixture": mixture.MIX_SQL.format(docs="documents"),
    "op10_revisits": warc.REVISIT_SQL,
    "op11_importance_resampling": resample.RESAMPLE_SQL,
    "op12_collocations": phrases.PHRASE_SQL.format(most=5, least=100, top=2000),
    "op13_jaccard_join": tiles.JOIN_SQL.format(n=3, percent=90),
}
