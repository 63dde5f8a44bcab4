"""Corpus pipeline: language ID, near-duplicate removal, decontamination,
secret redaction and packing, each a Spark job over what the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result as Parquet into the shared checkpoint folder and rereads it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm import decontaminate, language_id, packing, secret_scan, simhash
from hydrospark.llm.common import drop_folder, held_out
from hydrospark.session import checkpoint_dir

# Unrelated random vectors of DIM elements have a cosine of about 1 / sqrt(DIM) = 0.022;
# the threshold is 3.6 times that. A text of fewer letters is too short to tell.
DIM, MIN_SCORE, MIN_LETTERS = 2048, 0.08, 24


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; columns as they were. The language
    column is only read to learn, outside the held-out third.

    Null and empty texts and those without letters go, and texts of at least
    ``MIN_LETTERS`` letters that are like no learned language. Repeated rows are
    judged alike; an empty table, or one without a learned language, keeps
    nothing."""
    model = language_id.fit(docs, where=~held_out(F.col("doc_id")), dim=DIM)
    # Names of its own, as the table may have columns called like the operator's.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    kept = language_id.identify(named, model).where(
        (F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("score") >= MIN_SCORE) | (letters < MIN_LETTERS)))
    return kept.select("row.*")


def _with_address(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, text, doc_id, address): rows with their place in the files they are
    read from. A table that is not read from files is written first."""
    def named(df):
        return df.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"),
                         F.col("doc_id").alias("doc_id"),
                         F.struct("_metadata.file_path", "_metadata.row_index").alias("address"))
    try:
        return named(docs)
    except AnalysisException:
        path = f"{checkpoint_dir(spark).rstrip('/')}/addressed-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        return named(spark.read.parquet(path))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group: the one with the smallest id
    (a null id only in a group without others), of repeated rows of that id the
    one that stands first in the files.

    Null and empty texts are one group. An empty table stays empty. The chosen
    rows' addresses are joined to the table once, so whole texts move once."""
    rows = _with_address(spark, docs)
    groups = simhash.simhash_groups(rows, shingle=3, max_bits=3, extra=[F.col("address")])
    kept = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
            .agg(F.min("address").alias("address")).select("address"))
    return rows.join(kept, "address", "left_semi").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that benchmark windows do not contaminate: texts without
    words stay, repeated rows are judged alike, an empty table stays empty."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; live-looking credentials are masked in the text and
    ``n_chars`` follows. Null and empty texts stay as they are, repeated rows are
    masked alike, an empty table stays empty."""
    return secret_scan.redact(docs, thorough=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into bins: null and empty texts take no room, repeated
    rows (near copies of each other) stand in different bins, an empty table
    gives no bins."""
    return packing.pack_texts(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secret_scan", secret_stage),
    ("pack", packing_stage),
]

# Language ID, SimHash and best fit have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is deleted once the next
    one is written; the last one is the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
