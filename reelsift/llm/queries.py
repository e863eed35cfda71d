"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelsift.llm.align import align_corpus
from reelsift.llm.bpe import encode_corpus
from reelsift.llm.chat import ROTATE_SQL, rotate_perspectives
from reelsift.llm.decontaminate import contaminated
from reelsift.llm.embedding_dedup import near_vectors
from reelsift.llm.fill_middle import FIM_SQL, fim_round_trip
from reelsift.llm.hmm import score_corpus
from reelsift.llm.line_dedup import drop_boilerplate, line_dedup_sql
from reelsift.llm.main_text import main_text
from reelsift.llm.simhash import simhash_components
from reelsift.llm.suffix_dedup import dedup_substrings
from reelsift.llm.token_files import tokens_round_trip
from reelsift.llm.toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_hidden_markov_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_rotation_code_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("chunk")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents"))


def op11_html_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_round_trip(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_hidden_markov_scoring, op3_perspective_rotation, op4_rotation_code_dedup, op5_simhash_dedup, op6_bpe_round_trip, op7_template_decontamination, op8_weak_supervision_toxicity, op9_token_files, op10_line_dedup, op11_html_minimum_cut, op12_fill_in_middle, op13_tokenizer_alignment)}
ORACLE_SQL = {"op3_perspective_rotation": ROTATE_SQL, "op10_line_dedup": line_dedup_sql(), "op12_fill_in_middle": FIM_SQL}
