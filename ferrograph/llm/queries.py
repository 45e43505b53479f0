"""The operators' queries over the supplied tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import compress, compress_sql
from .decontaminate import DECONTAMINATE_SQL, decontaminate
from .html_text import extract_text
from .lines import dedup_lines
from .minhash import near_duplicates
from .mixing import WEIGHTS, mix, mix_sql, source_domain
from .ngrams import ngram_groups, ngram_sql
from .pii import personal_data
from .quality import QUALITY_SQL, quality_rules
from .substrings import repeated_substrings
from .tokens import token_counts
from .toxicity import toxicity
from .trie import crc_mod, placed, rebuilt, trie, trie_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: F.crc32(F.col(c).cast("string")) % 3 == 1
    found = toxicity(docs, table(spark, sf_dir, "labels").where(~held("doc_id")))
    return found.withColumn("held_out", held("doc_id"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), WEIGHTS, source_domain())
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    return found.select("doc_id", "lang", "source", n_words, "mix_epoch", "mix_quota")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return trie(*rebuilt(*placed(table(spark, sf_dir, "conversations")), base=c - c % 5, heads=crc_mod(c, 9), longest=8))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_html_text, op3_repeated_substrings, op4_line_dedup, op5_quality_rules, op6_minhash, op7_decontaminate, op8_mix, op9_personal_data, op10_token_counts, op11_vector_codes, op12_prefix_trie, op13_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": QUALITY_SQL, "op7_decontaminate": DECONTAMINATE_SQL, "op8_mix": mix_sql(), "op11_vector_codes": compress_sql(), "op12_prefix_trie": trie_sql(), "op13_ngram_join": ngram_sql()}
