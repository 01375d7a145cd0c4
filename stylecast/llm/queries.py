"""The thin queries over the shared tables: one opN_<name> for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, collocations, decontaminate, divergence, jaccard, licences, lines, pii, quality, substrings, tokens, tree_weighting
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_tokenizer() -> str:
    return _tokenizer("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), op4_tokenizer())


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = licences.pages_and_documents(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    found = licences.scanned(texts, licences.template_table(spark), id_col="item")
    return found.select("doc_id.*", "licence", "score", "origin", "licence_dir")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("against")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_weighting.scored(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_substring_dedup, op3_decontamination, op4_bpe_round_trip, op5_chat_format, op6_licence_scan, op7_jaccard_join, op8_quality_rules, op9_pii, op10_line_dedup, op11_phrase_collocations, op12_tree_weighting, op13_source_divergence)
}
ORACLES: dict[str, str] = {"op5_chat_format": chat.CHAT_SQL, "op6_licence_scan": licences.licence_sql(), "op10_line_dedup": lines.LINES_SQL, "op11_phrase_collocations": collocations.COLLOCATIONS_SQL, "op13_source_divergence": divergence.DIVERGENCE_SQL}
