"""The operators' queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import fresh_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_shards, write_token_shards

    folder = fresh_path(spark, "tokens")
    write_token_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_token_shards(spark, folder)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels marks as good; background: all others."""
    from .lm_scores import cross_entropy_difference

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotations import reply_order

    return reply_order(table(spark, sf_dir, "conversations"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import shingle_classes

    return shingle_classes(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows, by a checksum of their doc_id, are folded as if their text had been lower-cased."""
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damage that the query's contract states, and its repair."""
    from .repair import damaged, repair_report

    rows = table(spark, sf_dir, "conversations")
    return repair_report(rows, damaged(rows))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated_lines

    got = deduplicated_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_files, op3_fingerprints, op4_lm_scores, op5_decontamination, op6_quality, op7_html_text, op8_quotations, op9_jaccard_join, op10_token_counts, op11_merkle, op12_repair, op13_line_dedup)}

#: Operators that SQL expresses; tests/llm hold the others against brute-force versions.
ORACLE_SQL: dict[str, str] = {"op11_merkle": oracles.MERKLE, "op12_repair": oracles.REPAIR, "op13_line_dedup": oracles.LINE_DEDUP}
