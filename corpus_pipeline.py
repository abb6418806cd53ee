"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``.

Every stage keeps null and repeated rows unless its operator rejects them: a
null or empty text is scored like any other, links with nothing, contains no
benchmark item or secret, and packs as one end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import decontamination, minhash_dedup, packing, quality, secret_scan
from loomvec.llm.queries import vocabulary
from loomvec.plans.runtime import ship
from loomvec.plans.scratch import discard, keep

QUALITY_THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, score_col="loomvec_score")
    return scored.filter(F.col("loomvec_score") >= QUALITY_THRESHOLD).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that of least id, null ids last.

    Rows are judged each by its own text, also those that share an id or have none. Rows without a word link with nothing and all stay.
    """
    ship(spark)
    return minhash_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship(spark)
    found = decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits_col="loomvec_hits")
    return found.filter(F.size("loomvec_hits") == 0).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret masked and n_chars counted anew."""
    ship(spark)
    return secret_scan.redact(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, MinHash, edit matching, automata and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if number:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
