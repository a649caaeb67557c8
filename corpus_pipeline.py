"""The corpus pipeline: five stages of the llm subpackage, each on all that the stage before it kept.

Toxic documents go, then exact copies, then near copies; the mix takes what is left to its sources' target weights, some
documents more than once; the last stage packs what the mix took into token windows. All stages but the last
return the columns of documents.

run() has no ORACLE_SQL: the classifier, the cube method and the packer are not expressible in SQL; tests hold
the pipeline against a brute-force version of its filters and the packer's own guarantees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import _common as C
from tidewright.llm import exact_dedup, jaccard_join, mixing, packing, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores every whole text by a model of this stage's own documents and the labels; scores of 0.5 or more go."""
    model = toxicity.fit(docs, C.read(spark, sf_dir, "labels"))
    score = C.fresh(docs, "_score")
    return toxicity.score(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again for the next one."""
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.as_table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
