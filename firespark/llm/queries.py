"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.llm import (
    decontaminate, embeddings, langid, mixing, multiset, quality, repeats, runs, secrets, simhash, spelling, tokens, warc,
)
from firespark.llm.common import crc_mod, table
from firespark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def secret_model(docs: DataFrame, pages: DataFrame) -> secrets.Model:
    """The forest of the secret scans: the dictionary is the documents', so are most labelled findings."""
    return secrets.train(secrets.labelled_findings(docs, pages), secrets.dictionary(docs))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secret_model(docs, table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("doc_id"), "start", "value", "score", "secret")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.convert_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = embeddings.vector_classes(table(spark, sf_dir, "embeddings"))
    return classes.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("id", "doc_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    languages = langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    marked = docs.select("doc_id", held_out.alias("held_out"), langid.prediction(docs, languages).alias("p"))
    return marked.select("doc_id", "held_out", "p.lang_pred", "p.score", langid.rejected(F.col("p")).alias("rejected"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "judged.n_words", "judged.n_hit", F.size("judged.items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("judged.items")).alias("items_sha256"), "judged.contaminated",
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents"))
    return mix.taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = runs.with_repeated_tail(table(spark, sf_dir, "documents"))
    found = planted.select("id", runs.periodic_runs(F.col("text")).alias("r"))
    listed = F.transform("r.runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    best = F.col("r.longest")
    return found.select(
        F.col("id").alias("doc_id"), F.size("r.runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * r.longest.length div r.longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("r.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edit_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        multiset.as_text(F.col("fp")).alias("fingerprint"), multiset.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_embeddings": op4_embeddings,
    "op5_tokens": op5_tokens,
    "op6_language": op6_language,
    "op7_contamination": op7_contamination,
    "op8_quality": op8_quality,
    "op9_repeats": op9_repeats,
    "op10_mix": op10_mix,
    "op11_spelling": op11_spelling,
    "op12_runs": op12_runs,
    "op13_fingerprints": op13_fingerprints,
}
