"""A cleaning pipeline over ``documents``; every stage works on all that the one before it kept.

toxicity -> one document of each near-duplicate group -> no repeated passages -> mix of sources
-> token ids. Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, of which a stage that changes texts brings ``n_chars`` up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.jaccard import jaccard_components
from siftlake.llm.mixing import mix
from siftlake.llm.sentencepieces import decode, encode
from siftlake.llm.substrings import without_repeats
from siftlake.llm.toxicity import toxicity
from siftlake.session import configure, shared_dir


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    NULL and empty texts are scored by what a text without known n-grams scores; rows that repeat an id are each scored
    by their own text.
    """
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = "toxicity" + "_" * max(len(name) for name in docs.columns)
    return toxicity(docs, labels, name=score).where(F.col(score) < 0.5).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates.

    Rows without an id stay; rows that repeat an id are one document and share its fate.
    """
    configure(spark)
    found = jaccard_components(docs)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat one in a document with a smaller id.

    Rows without an id, NULL and empty texts stay as they are; rows that repeat an id do not count as repeats of each other.
    """
    configure(spark)
    return _counted(without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many repetitions as the mix of sources takes.

    Rows without words are taken no times; rows that repeat an id or have none each follow their own plan.
    """
    configure(spark)
    return _counted(mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding them gives the text again; NULL and empty texts have none."""
    configure(spark)
    texts = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    tokens = encode(texts, ["doc_id", "source", "digest"])
    decoded = decode(tokens.withColumn("tokens", F.col("ids")))
    return decoded.select(
        "doc_id",
        "source",
        F.size("tokens").cast("long").alias("n_ids"),
        F.col("tokens").alias("ids"),
        (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

# The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder before the next stage."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        target = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
    return STAGES[-1][1](spark, docs, sf_dir)
