"""The corpus pipeline: five stages over ``documents``, each a whole-table operator of ``meshspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
to the shared folder and reads it back as the next stage's input.

Defined for every stage but the last: all columns of ``docs`` come out, extra ones of any name too; an empty table
gives an empty one; rows are judged by their own text, whether their doc_id is null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.llm import decontam, mixing, neardup, quality, sharding
from meshspark.llm.common import materialize

#: Near-duplicates here share five-word shingles at a similarity of 0.8 or more.
SIMILAR = neardup.Similarity(80)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, learnt from ``labels``, rejects.

    Null texts are judged as empty ones; equal texts fall or stay together; a score of exactly 0.5 stays;
    where no label of a class is known every document of the other class' score stays (or falls).
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one of smallest id.

    Texts without words (null, blank) link with nothing and stay; rows without an id come after all others;
    of one id the text of smallest digest stays; of rows equal in id and text one.
    """
    return neardup.one_of_each(docs, SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and wordless texts hold none and stay; with an empty benchmark all stay; repeated rows fall or stay together.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document as many rows as the mix takes it.

    Null and blank texts are never taken; the null source is a source of its own; rows equal in id, source
    and text share what they are taken as evenly as whole rows allow.
    """
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row that is left.

    Null texts count as empty; equal texts share a shard; repeated rows get a slot each.
    """
    placed = sharding.shard(docs, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can't express the classifier or the seeded mix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
