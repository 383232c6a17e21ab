"""A corpus pipeline in stages; each stage's output is written and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import jaccard, langid, linededup, packing, pii
from reviewlake.llm.common import BROADCAST_IDS, shared_folder, stored
from reviewlake.llm.queries import fold

#: Documents whose best language has a smaller share of the softmax are rejected.
LEAST_SCORE = 0.35
#: Documents in a sequence at most: a capacity of the packing beside its tokens.
SEQUENCE_DOCS = 32

#: Language identification, edit distance and tokens are beyond SQL; tests/llm/test_pipeline.py holds run()
#: against plain Python: all pairs of lines and of shingle sets, the patterns, and the tokens of the library.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    """n_chars anew, where a stage has changed texts."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the classifier learns from these documents' own labels.

    Each row is judged by its own text, whatever its id; texts that are null or hold no letter go.
    """
    model = langid.train(docs.filter(~fold(F.col("doc_id"), 4, 2)))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
    found = langid.identify(whole, model, keep=("document",))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near copies of a line go; so do documents that consisted of nothing else.

    Rows that share an id lose the same lines; rows with a null id stay as they are.
    """
    return counted(linededup.drop_lines(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Rows that share an id stay or go together; rows with a null id stay.
    """
    groups = jaccard.jaccard_components(docs)
    gone = stored(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets, in every row; null texts stay null."""
    return counted(pii.mask_pii(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place, in the columns of op6_packing.

    A sequence holds at most ``SEQUENCE_DOCS`` pieces.  Rows that share an id, or have none, are
    packed each for itself.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_docs=SEQUENCE_DOCS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("pii", mask_pii),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, in the folder that ``spark.checkpoint.dir`` names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
