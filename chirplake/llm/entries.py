"""The queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_dedup, decontam, html_main, late_sessions, licenses, near_dup, oracles, packing, pii, quality, ranked_search, token_files, toxicity
from .shared import Scratch, table


def op1_template_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"), Scratch(spark, "op1"))


def op2_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_shared(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_items", "hit_spans")


def op8_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), Scratch(spark, "op8")).drop("copies")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.cut_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10")).drop("removed")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, book = token_files.write(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), vocabulary("byte_bpe_50k.json"))
    return token_files.read(files, book)


def op6_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, PATTERN), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions.versions(late_sessions.turns_as_events(table(spark, sf_dir, "conversations")), Scratch(spark, "op12"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
