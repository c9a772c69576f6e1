"""The corpus pipeline: five stages, each a DataFrame of documents in and out, stored as Parquet between them.

1. toxicity: documents that the FTRL classifier rejects go.
2. quality: documents that the compression classifier rejects go.
3. near duplicates: one document of each group of the n-gram Jaccard join stays.
4. mixing: every document stays as often as the flow to the source targets takes it, none to three times.
5. encoding: ids and digests of every document that is left.

All but the last return the columns of documents. Models learn only from labelled rows outside fold 0 of 5, as in the operators' own queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import flow_mix, forest_jaccard, ftrl_toxicity, prefix_bpe, zstd_quality
from pagemill.llm.common import fold, stored, table
from pagemill.llm.queries import pieces_path

#: Scores from which on a document counts as toxic, and as good.
TOXIC_FROM = 0.5
GOOD_FROM = 0.3

#: Fitted models can't be expressed in SQL; the pipeline is tested stage by stage against the operators and brute force.
ORACLE_SQL = None


def _use():
    return fold(F.col("doc_id"), 5) != 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ftrl_toxicity.train(docs, table(spark, sf_dir, "labels"), _use())
    return zstd_quality.keep_texts(docs, model, TOXIC_FROM, keep_above=False)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = zstd_quality.train(docs, table(spark, sf_dir, "labels"), _use())
    return zstd_quality.keep_texts(docs, model, GOOD_FROM, keep_above=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest_jaccard.one_of_each(docs, forest_jaccard.similar_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed, _ = flow_mix.mix_by_source(docs)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    again = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return mixed.where("__copies > 0").select(*kept, again).select(*kept)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_bpe.encoding_digests(docs, pieces_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
