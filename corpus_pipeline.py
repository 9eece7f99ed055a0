"""A corpus pipeline of the operators in ``millrace.llm``: filter, deduplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows to the shared folder and
reads them again for the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from millrace.llm.common import crc_mod, free_name, shared_dir, store, table
from millrace.shipping import ship


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where both are there."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, output=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that occurred before; none is dropped."""
    removed = free_name(docs, "removed")
    return _sized(line_dedup.dedupe_lines(docs, removed=removed).drop(removed))


def dedupe_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of their decoded bytes."""
    ship(spark)
    return byte_bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedupe_lines),
    ("n-gram Jaccard join", dedupe_near),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level BPE encoding and decoding", encode),
]

#: The learned toxicity stage has no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = store(stage(spark, docs, sf_dir), root, f"stage_{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
