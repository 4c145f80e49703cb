"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns they got.  ``run`` writes each stage's rows to the shared folder and reads them for
the next.  Exact dedup and near dedup keep one document of a group, mixing draws a document
at most once, packing returns the pieces of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _kit
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.quality_classifier import fit, resampled


ROW = "_row"
#: The mixture: each dimension's shares of tokens to this power.  As a document is drawn at most once,
#: a value of a share s limits the volume to about s ** (1 - POWER) of all tokens; values under
#: LEAST_SHARE count as one.
POWER, LEAST_SHARE = 0.9, 0.01


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, the same at every reading.

    A Parquet table's rows are numbered by file and place within it, and only the names of its files
    are written, with their ranks: a row for each file, however many it has.  How they are joined is Spark's choice.
    Rows of another source are written with a number first.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return _kit.written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    files = placed.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long"))
    return placed.join(_kit.written(files, "files"), "_file").select(*docs.columns, (F.col("_number") * F.lit(1 << 40) + F.col("_place")).alias(ROW))


def _one_of_each(rows: DataFrame, grouped: DataFrame, group: str, chosen: Column) -> DataFrame:
    """Of the rows that grouped (ROW, group) puts together the one whose number is chosen.

    The numbers grow with the documents, so they are never broadcast, at no size.
    """
    told = grouped.select(ROW, F.col(group).alias("_group")).join(rows.select(ROW, "doc_id"), ROW)
    picked = _kit.written(told.groupBy("_group").agg(chosen.alias(ROW)).select(ROW), "chosen")
    return rows.join(picked.hint("merge"), ROW, "left_semi").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample holds.

    Rows without text stay as any others do that no model tells apart; of rows that repeat an id
    and text all have one verdict.  An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resampled(docs, fit(docs, labels)[0], kept="_kept").where("_kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; one row of it, and one without id only where none has any.

    A null text equals an empty one.  An empty table gives an empty one.
    """
    rows = _numbered(docs)
    return _one_of_each(rows, exact_dedup(rows, ROW), "keep_id", F.max_by(ROW, F.struct("doc_id", ROW)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id; one row of it, and one without id only where none has any.

    Texts without words are near nothing and all stay.  An empty table gives an empty one.
    """
    rows = _numbered(docs)
    return _one_of_each(rows, near_duplicates(rows, ROW), "component_id", F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, each at most once, so that the tokens' shares meet the mixture's.

    The volume is the largest at which they do.  Null values of source or language are values;
    rows without text are not drawn.  An empty table gives an empty one.
    """
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(_kit.text_of("text")))  # rows of one id, or of none, are drawn apart
    drawn = mix(docs.withColumn(ROW, own), ROW, power=POWER, least_share=LEAST_SHARE, most_copies=1, carried=docs.columns).where("copies > 0")
    return drawn.select("carried.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    done = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: The trained classifier, the signatures and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _kit.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
