"""A corpus pipeline: from raw documents to token counts, in five stages over whole texts.

Each stage reads what its predecessor wrote, decides over all of it, and its decisions take effect: documents that the
quality classifier rejects go, one document of each group of near-duplicates stays, secrets are replaced by a mark,
sources are thinned or repeated to their target weights, and the rest is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.minhash import near_duplicates
from pointweave.llm.mixing import hash_threshold_mix
from pointweave.llm.pieces import encode_texts
from pointweave.llm.quality_model import score_documents, train
from pointweave.llm.queries import public_tokenizer
from pointweave.llm.secrets import redact, scan_secrets
from pointweave.llm.shared import read
from pointweave.operators.tables import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, trained on the rated ones, does not reject.

    Null and empty texts are judged by the features of an empty text, repeated rows each like the others, very long
    texts in whole. Without ratings nothing is rejected. Of columns only those of documents go on.
    """
    docs = docs.select(*COLUMNS)
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels"))).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates, and one row of each doc_id.

    Of repeated rows of a doc_id the least stays, in the order of text, lang, source, n_chars (nulls first), whether
    their texts agree or not. Rows without doc_id cannot be told apart by it and stay. Null and empty texts are near
    nothing and stay, once for each doc_id. Of columns only those of documents go on.
    """
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs)
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.head(1):
        return left
    # Repeated rows combine map-side, so a doc_id with many of them is no hot key.
    least = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").unionByName(least.select("doc_id", "row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars counted again.

    Null texts become empty ones. Repeated rows stay and are redacted alike. Of columns only those of documents go on.
    """
    found = scan_secrets(docs.select(*COLUMNS))
    clean = found.withColumn("text", redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated.

    Null and empty texts have no words; they are taken as often as others of their hash, and add nothing. Repeated rows
    of a doc_id go in or out together. A null source is a source. Of columns only those of documents go on.
    """
    mixed = hash_threshold_mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null and empty texts have no tokens, repeated rows repeat."""
    return encode_texts(docs, public_tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: Sketches, trained models and tokens are not SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of documents; every stage's result is a Parquet table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


QUERIES = {"pipeline": run}
