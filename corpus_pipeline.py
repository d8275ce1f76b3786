"""The training-data pipeline over documents: STAGES of the operators in tallystone.llm, and run().

A stage takes what the one before it has kept, as a table, and gives documents with the same columns, whatever
else they are called; the last one gives them with the shard that holds them. Null and empty texts are clean and
not toxic, are near copies of each other, and take no part in a mix; very long texts are taken whole; repeated
rows of an id pass all stages but near_dedup, which keeps one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import discard, fresh, scratch
from tallystone.llm.decontamination import decontaminate
from tallystone.llm.mixing import curriculum
from tallystone.llm.sharding import shard
from tallystone.llm.simhash import keep_first
from tallystone.llm.toxicity import judged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't take for toxic. Without labels of both kinds none is."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return judged(docs, labels).filter(F.col(fresh(docs, "predicted")) == 0).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows with null ids stay."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go. Without items nothing changes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = decontaminate(docs, items, columns=other)
    dropped, text, n_hit = (F.col(fresh(docs.drop("text"), c)) for c in ("dropped", "clean_text", "n_hit"))
    now = {"text": text, "n_chars": F.when(n_hit > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return rows.filter(~dropped).select(*[now[c].alias(c) if c in now else F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them; those without words are never taken."""
    return curriculum(docs).select(*[f"`{c}`" for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last version of a shard store with all documents, and the shard of each."""
    return shard(docs, scratch(spark, "corpus"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read is removed once the next one is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if read:
            discard(spark, read)
        read = out
    last = STAGES[-1][1](spark, docs, sf_dir)  # the store has its own files
    discard(spark, read)
    return last
