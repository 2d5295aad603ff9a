"""From documents to packed training sequences: five stages, each one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet to the shared folder and reads again as the next one's docs.
All but the last keep the columns of documents and drop the rows they reject.

In every stage rows are judged by their own id, text and language: other
columns, also ones whose names clash with a stage's own, pass through as they
are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, langid, neardup, packing, quality
from tessera.llm.common import save
from tessera.llm.queries import read, vocabulary


#: Rows of whole documents in a batch that Python workers get at once: with Spark's usual 10,000 the batches alone are a tenth of a small executor.
BATCH_ROWS = 2000


def light(spark: SparkSession) -> None:
    """Limits the session's batches, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limits of their language's trusted documents.

    Null, empty and blank texts go. A null language, or one without trusted
    documents, has the limits of all. Repeated rows fare alike; without any
    trusted document all texts but the blank ones stay.
    """
    light(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, most of them in one language; the model is learned from the given languages of those that aren't held out.

    Null texts and those without letters go; repeated rows fare alike. Null
    languages and ids aren't learned from; without any given language all go.
    """
    light(spark)
    model = langid.train(docs.filter(~langid.held_out(docs["doc_id"])).select("doc_id", "text", "lang"))
    return langid.keep_known(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id.

    Null and empty texts are no one's duplicates and stay, as do rows with a
    null id; of rows that repeat an id and its text one stays.
    """
    light(spark)
    return neardup.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages.

    Null and empty texts stay; repeated rows fare alike, and rows that share an
    id, or have none, are told apart by their texts. Without items all stay.
    """
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in training sequences.

    Null and empty texts are a sequence's end alone; repeated rows each are packed.
    """
    light(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("best-fit packing", packed),
]

#: Perplexities, labels and tokens are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
