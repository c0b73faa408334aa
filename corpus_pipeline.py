"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Decisions are taken for rows, not for doc_ids: a row is known by its doc_id (null too) and a hash of all its columns. Nulls, empty
and very long texts, repeated rows, ties and empty tables: see each stage. Extra columns of documents stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import Tables, fresh_path, table
from seriesloom.llm.decontamination import contaminated_texts, text_key
from seriesloom.llm.jaccard_join import shingle_components
from seriesloom.llm.mixing import mixture, row_hash
from seriesloom.llm.quality import THRESHOLD, quality_model, with_score
from seriesloom.llm.queries import tokenizer_path
from seriesloom.llm.token_files import read_token_shards, write_token_shards

#: Names that no column of documents has.
ROW, KEY, HELD, SCORE = "row of docs", "text of docs", "held by docs", "quality of docs"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones (operator 6). Null and empty texts are scored as empty; rows of one text share its fate."""
    scored = with_score(docs, quality_model(docs, table(spark, sf_dir, "labels")), SCORE)
    return scored.where(F.col(f"`{SCORE}`") >= THRESHOLD).drop(SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked ones stays: that of the least doc_id (nulls last), then of the least row hash (operator 9).

    Of rows that are the same in every column one stays. Rows without words all stay, as they link with nothing.
    """
    rows = docs.withColumn(ROW, row_hash(docs))
    keyed = rows.select("doc_id", F.col(f"`{ROW}`").alias("row"), "text")
    named = shingle_components(keyed, carry=("row",)).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = named.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    fate = named.groupBy("row").agg(F.count(F.lit(1)).alias("copies")).join(kept.withColumn("stays", F.lit(True)), "row", "left")
    gone = fate.where("stays is null").select(F.col("row").alias(HELD))
    again = fate.where("stays and copies > 1").select(F.col("row").alias(HELD))
    met = lambda keys, how: rows.join(keys, F.col(f"`{ROW}`") == F.col(f"`{HELD}`"), how)
    single = met(gone.unionByName(again), "left_anti").drop(ROW)
    repeated = met(again, "left_semi").dropDuplicates([ROW]).drop(ROW)
    return single.unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their doc_id (operator 5). Null and empty texts hold none and stay."""
    leaks = contaminated_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("row").alias(HELD)).distinct()
    return docs.withColumn(KEY, text_key()).join(leaks, F.col(f"`{KEY}`") == F.col(f"`{HELD}`"), "left_anti").drop(KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them (operator 1). Null, empty and blank texts have no tokens and go."""
    return mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture, read back (operator 2): one row per row, in ascending doc_id order."""
    folder = fresh_path(spark, "tokens")
    write_token_shards(docs, folder, tokenizer_path())
    return read_token_shards(spark, folder).drop("shard")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing", mix), ("token output", write_tokens)]

#: Covariances, permutations by hash and byte-level BPE can't be said in SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs, before, tables = table(spark, sf_dir, "documents"), None, Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            tables.drop(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    tables.drop(before)  # the token files hold all that the result needs
    return out
