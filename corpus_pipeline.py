"""A corpus pipeline of five stages, each of which works on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import byte_bpe, decontamination, line_dedup, shingle_join, toxicity
from lexarium.llm._shared import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the model is learned from labelled documents of ``docs``.

    Null, empty and wordless texts stay (no evidence), and so do all without labels of both kinds. Equal texts
    have equal scores, so they go or stay together. Very long texts are scored whole. An empty table stays
    empty. All columns are kept, whatever their names.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learning_rows(F.col("doc_id")))
    scored = toxicity.score(docs, model, column="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_aligned_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds too go; n_chars follows the text.

    Null and empty texts and rows without doc_id stay as they are; documents of which nothing is left go. Rows of
    one doc_id come in the order of a hash of their texts, repeated rows are one document. Very long texts are
    read whole. An empty table stays empty. All columns are kept, whatever their names.
    """
    return with_length(line_dedup.dedup(docs), docs)


def with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that near copies connect, the first by doc_id stays.

    Null, empty and wordless texts are nobody's copies, and rows without doc_id are not compared: they stay. Of
    repeated rows one stays. Very long texts are read whole. An empty table stays empty. All columns are kept.
    """
    return shingle_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and empty texts stay; without a benchmark all do. Equal texts go or stay together. Very long texts are
    scanned whole. An empty table stays empty. All columns are kept, whatever their names.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids and their digests of each row, null and empty texts with none; repeated rows alike, very long texts whole, an empty table as no rows."""
    import public_tokenizers

    return byte_bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True, keep_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_aligned_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the encoder; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
