"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark
passages go with their documents, personal values get pseudonyms, the rest is packed.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, ngram_join, packing, pii, toxicity
from quire.llm.queries import PII_KEY
from quire.plans.registry import table
from quire.session import ensure_checkpoint_dir

#: Near copies: five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7, by a model learnt from the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    # Columns of the operator's names, should the documents have some, are kept as they are.
    aside = {c: f"_kept_{c}" for c in ("score", "predicted") if c in docs.columns}
    scored = toxicity.score_documents(docs.withColumnsRenamed(aside), model).where(F.col("predicted") == 0)
    back = {name: c for c, name in aside.items()}
    return scored.drop("score", "predicted").withColumnsRenamed(back).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies, and all rows without an id.

    Of repeated rows of such an id one stays.
    """
    rows = ngram_join.similar_components(docs, size=SHINGLE, percent=PERCENT)
    kept = rows.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    once = docs.join(kept.where("n = 1"), "doc_id", "left_semi")
    several = docs.join(kept.where("n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where(F.col("doc_id").isNull())
    return once.unionByName(several).unionByName(nameless).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is similar to a whole benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal values in their texts replaced and n_chars counted anew."""
    held = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    new = pii.pseudonymize(held, PII_KEY)
    changed = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(changed.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", pseudonymize),
    ("best_fit_packing", pack),
]

#: SQL has no tokenizer, trained model or compressor; tests/llm/test_pipeline.py checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
