"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import anchors, bpe, chat, clustering, decontamination, exact_dedup, importance, language_id, packing, pitman_yor, setsketch, suffix_dedup, warc
from caseloom.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"
PACKED_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, then read the committed archives; shards of 64 MB and files of 4 MB, so that small tables use several."""
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"), folder, file_bytes=4 << 20, shard_bytes=64 << 20)
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are template marks."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.examples(rows.unionByName(marks)))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_anchor_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.without_repeats(read_table(spark, sf_dir, "documents"))


def op8_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digests(read_table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(read_table(spark, sf_dir, "documents"), tokenizer_path(PACKED_TOKENIZER))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {q.__name__: q for q in (op1_language_id, op2_warc_round_trip, op3_setsketch_near_dedup, op4_benchmark_decontamination, op5_chat_format, op6_bpe_round_trip, op7_anchor_substring_dedup, op8_pitman_yor_scores, op9_exact_dedup, op10_suffix_array_dedup,
                                op11_importance_resampling, op12_centroid_clustering, op13_best_fit_packing)}
ORACLES = {
    "op2_warc_round_trip": warc.ORACLE,
    "op3_setsketch_near_dedup": setsketch.oracle(85),
    "op5_chat_format": chat.ORACLE,
    "op4_benchmark_decontamination": decontamination.ORACLE,
    "op7_anchor_substring_dedup": anchors.oracle(),
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_suffix_array_dedup": suffix_dedup.oracle(),
    "op11_importance_resampling": importance.oracle(),
    "op12_centroid_clustering": clustering.oracle(),
}
