"""The corpus pipeline: five stages from raw documents to a shuffled training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept. ``run`` writes each stage as Parquet to the shared folder and reads it
again for the next.

All stages but the last return the columns of their input, which may have more than those
used here (doc_id, text, lang, source, n_chars), under any names. Null texts and texts
without letters have no language and go in the first stage; nulls elsewhere, repeated
rows, very long texts and empty tables go through as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.llm import decontaminate, langid, mixing, simhash
from firespark.llm.common import crc_mod, table
from firespark.llm.queries import secret_model
from firespark.llm.secrets import redacted
from firespark.session import shared_dir

def _unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some margin; their ``lang`` becomes the one found."""
    languages = langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = _unused(docs, "found")
    marked = docs.withColumn(found, langid.prediction(docs, languages))
    kept = marked.where(~langid.rejected(F.col(found)))
    return _like(kept.withColumn("lang", F.col(found)["lang_pred"]), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: SimHash fingerprints within two bits, found by
    covering masks, or five-word shingles of similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    found = _unused(docs, "judged")
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"), out_col=found)
    return _like(judged.where(~F.col(found)["contaminated"]), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and ``n_chars`` counted anew where one was."""
    model = secret_model(docs, table(spark, sf_dir, "pages"))
    name = _unused(docs, "clean")
    marked = docs.withColumn(name, redacted(F.col("text"), model, docs))
    changed = ~F.col(name).eqNullSafe(F.col("text"))
    counted = marked.withColumn("n_chars", F.when(changed, F.length(name).cast("long")).otherwise(F.col("n_chars")))
    return _like(counted.withColumn("text", F.col(name)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per copy taken, with its epoch, output shard and place in the shard."""
    return mixing.Mix(docs).documents()


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_copies),
    ("contamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]

#: Compression, fingerprints and forests are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
