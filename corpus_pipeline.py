"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and read again as the
next one's input.  All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe_codec import encoded_digests
from larkspur.llm.common import free_name, materialise, table
from larkspur.llm.decontaminate import decontaminate
from larkspur.llm.jaccard_join import drop_near_copies
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.toxicity import fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "__toxicity")
    return model.score(docs, out=score).where(F.col(score) < 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or is within one word of, go; every document stays."""
    return dedup_lines(docs, length_col="n_chars")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, one stays."""
    return drop_near_copies(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    Documents that lost all their words on the way, since others hold them, go."""
    return encoded_digests(without_emptied(docs, table(spark, sf_dir, "documents")))


def without_emptied(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``docs`` without those that have no word but had one in ``before``; what never had a word stays."""
    word = F.coalesce(F.col("text").rlike(r"[^ \t\r\n\f\x0B]"), F.lit(False))
    had = before.groupBy(F.col("doc_id").alias("had")).agg(F.bool_and(word).alias("all")).where("all").select("had")
    return docs.where(word).unionByName(docs.where(~word).join(had, F.col("doc_id").eqNullSafe(F.col("had")), "left_anti"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("bpe_codec", bpe_codec)]

#: SQL can't express the first stage; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
