"""The training-data pipeline: STAGES in order, each over all that the stage before has kept.

1. Quality rules drop the documents that they reject. 2. Of each group of near-duplicates (5-word shingles, similarity 0.8 or
more) one document stays. 3. Secrets in the texts are masked. 4. Sources are mixed to their target weights: a document
appears as often as the mix takes it. 5. Texts are encoded.

All stages but the last return the columns of documents. Null texts fail the quality rules. Rows of one id and
text are one document to stage 2. Extra columns of the input do not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import jaccard_join, mixing, quality, secrets, sentencepiece
from lakeaudit.llm.lattice import Vocabulary
from lakeaudit.llm.queries import MODEL
from lakeaudit.llm.text import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. All columns go with the text, so no join is needed."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, model, id_columns=("doc_id", "lang", "source", "n_chars"), keep_text=True).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the one of smallest id (identical rows count once)."""
    # A struct is equal to one with the same nulls, and as the one key it deals the texts out once for the join and the duplicates.
    # No hash is null; said so, both keys are of one type.
    hash_ = F.coalesce("text_hash", F.lit(0).cast("long")).alias("hash")
    kept = jaccard_join.jaccard_join(docs).where("kept").select(F.struct("doc_id", hash_).alias("key")).distinct()
    rows = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"))
    # Rows of one id and text may differ in the other columns: the first by those stays, the same one in each run.
    first = F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")
    return rows.join(kept, "key").groupBy("key").agg(first).select("key.doc_id", "row.*").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    masked = secrets.redact(docs, secrets.train(docs))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; a document of no copies goes."""
    return mixing.mixed_rows(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, nbest_scores, nbest_tokens, decoded_equal), a row for each row of docs."""
    return sentencepiece.encode(docs, Vocabulary.load(MODEL), id_columns=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The trained models (line labels, character models) and the lattice search cannot be written in SQL; the tests hold every
#: stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage returns is written once, in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
