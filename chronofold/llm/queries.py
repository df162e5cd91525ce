"""Queries over the whole tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import flac, jaccard, langid, line_dedup, mixing, packing, pii, quality, ranked_search, secrets, spelling, suffix_dedup, token_files
from chronofold.llm.common import documents, labels, written

Query = Callable[[SparkSession, str], DataFrame]


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    # A second parameter of the function would be taken for the place in the array, so the kind is bound outside.
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.encode(pii.listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality.fit(docs, labels(spark, sf_dir).select("doc_id", (F.col("quality") == 1).alias("good")))
    failed = quality.base_failed()
    found = quality.statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & quality.verdict(rules))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(flac.stored(documents(spark, sf_dir).select("doc_id", "text")), "media")
    return flac.read_back(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    findings = written(secrets.candidates(docs), "findings")
    model = secrets.fit(findings.withColumn("secret", secrets.known_findings()), secrets.dictionary(docs))
    found = secrets.scored(findings, model)
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


#: Domains of the labelled table, and the share of tokens that each is to have.
DOMAINS = ["high", "low", "toxic"]
TARGET_WEIGHTS = {"high": 0.80, "low": 0.15, "toxic": 0.05}


def domain_labels(labelled: DataFrame) -> DataFrame:
    """(doc_id, domain); rows without labels have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labelled.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mix(documents(spark, sf_dir), domain_labels(labels(spark, sf_dir)), DOMAINS, weights=TARGET_WEIGHTS)
    odds = [F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rates.select("doc_id", "tokens", *odds, "rate", mixing.copies(F.col("rate"), "doc_id").alias("copies"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    kept = line_dedup.kept_text(F.col("text"), F.col("keep_runs"), F.col("n_dropped"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return files.rows().select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return ranked_search.rank(documents(spark, sf_dir), items)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {"op1_mixing": op1_mixing, "op2_packing": op2_packing, "op3_line_dedup": op3_line_dedup, "op4_suffix_dedup": op4_suffix_dedup, "op5_pii": op5_pii, "op6_quality": op6_quality, "op7_flac": op7_flac, "op8_secrets": op8_secrets, "op9_langid": op9_langid, "op10_jaccard": op10_jaccard, "op11_token_files": op11_token_files, "op12_ranked_search": op12_ranked_search, "op13_spelling": op13_spelling}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE, "op4_suffix_dedup": suffix_dedup.ORACLE, "op10_jaccard": jaccard.ORACLE, "op12_ranked_search": ranked_search.ORACLE, "op13_spelling": spelling.ORACLE}
