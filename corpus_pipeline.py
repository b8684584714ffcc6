"""A training corpus from documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, and further ones that docs have, whatever
their names.

In every stage: rows with null or equal doc_ids are documents of their own, and an empty table gives an empty one.
Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import cut, ship
from sluice.llm.decontaminate import without_leaks
from sluice.llm.packing import pack_documents
from sluice.llm.simhash import keep_one_of_each
from sluice.llm.tokens import default_path
from sluice.llm.toxicity import without_toxic
from sluice.llm.word_repeats import without_repeats

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below the threshold.

    A null or empty text is scored like any other, as one without words. Equal texts have equal scores. Without labels of
    both classes every document has the sample's share of toxic ones as its score.
    """
    ship(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Texts without words, null ones too, are one group. Equal rows are copies. The smallest doc_id stays, a null one only
    where its group has no other; among equal ids the text with the smallest hash.
    """
    ship(spark)
    return keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that recur; texts that hold none stay as they are.

    All occurrences go, the first too, so equal rows that came this far lose their long passages alike. No row goes: a text
    that is one recurring passage is empty then. Null and empty texts stay.
    """
    ship(spark)
    left = without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("own.text"))
    own = {c: F.col("own").getField(c) for c in docs.columns}
    own["text"] = text
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(own["n_chars"])
    return left.select(*(c.alias(n) for n, c in own.items()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing. Items without words, null ones too, leak from no document.
    """
    ship(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens.

    A null or empty text is its end token alone. Equal rows are packed each by itself.
    """
    ship(spark)
    return pack_documents(docs, default_path(), end_id=1, length=2048, keep=300_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
