"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import decontaminate, licenses, line_dedup, manifest, near_copies, packing, preferences, quality_model, quality_rules, repeats, sql, token_store, toxicity, vector_codes, wordtokens
from varloom.llm.samples import held_out, labelled_sample
from varloom.llm.shared import table

#: Labelled rows from which the toxicity lexicon and the quality network are learned, at most.
TOXIC_SAMPLE, QUALITY_SAMPLE = 6000, 4000


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.find_repeats(docs, outputs=("n_bytes", "n_removed", "spans", "kept_sha256"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_phrases(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.words", F.lit(0).cast("long"), lambda n, w: n + w["last"] - w["first"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _scored(df: DataFrame, score: str, parts: int, part: int) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", parts, part).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.7).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, TOXIC_SAMPLE)
    return _scored(toxicity.score(docs, toxicity.learn(sample)), "toxicity", 3, 1)


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), wordtokens.default_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, QUALITY_SAMPLE)
    return _scored(quality_model.score(docs, quality_model.learn(sample)), "quality", 4, 2)


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with the next one's last answer: the two share all turns ahead of it."""
    found = preferences.preferences(*preferences.with_other_answers(table(spark, sf_dir, "conversations")))

    def shown(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(mask)

    return found.select("pair_id", "n_common", "prompt", "chosen", "rejected", shown("chosen_mask"), shown("rejected_mask"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.templates(spark)).select("doc_id", "license", F.round("containment", 6).alias("containment"), "n_pairs")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), wordtokens.default_path(), keep_ids=False)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least=10), outputs=("n_lines", "n_dropped", "kept_sha256"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "source", "doc_id", {"text": tampered})
    folded = found.select(
        F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        manifest.fold(F.coalesce("suspect", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeats": op1_repeats,
        "op2_decontaminate": op2_decontaminate,
        "op3_toxicity": op3_toxicity,
        "op4_near_copies": op4_near_copies,
        "op5_token_store": op5_token_store,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_model": op7_quality_model,
        "op8_preferences": op8_preferences,
        "op9_licenses": op9_licenses,
        "op10_packing": op10_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_line_dedup": op12_line_dedup,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_repeats": sql.REPEATS, "op2_decontaminate": sql.PHRASES, "op4_near_copies": sql.NEAR_COPIES, "op8_preferences": sql.PREFERENCES, "op9_licenses": sql.licenses(), "op11_vector_codes": sql.VECTOR_CODES, "op12_line_dedup": sql.LINES, "op13_manifest": sql.MANIFEST}
