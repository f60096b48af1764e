"""From raw documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import bloom, language, near_duplicates, packing, pseudonyms
from tocsin.llm.common import noted, remove, settled, stage

#: Least score for a language: the labelled rows have 0.36 and more, junk and Polish, Turkish,
#: Finnish or Italian texts 0.18 to 0.30.  Near relatives (Dutch: 0.32 and more) may pass.
LEAST_SCORE = 0.35
#: Where the session names no key of its own.
KEY_SETTING, DEFAULT_KEY = "spark.tocsin.pseudonym.key", "tocsin"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names; texts in others, junk and texts without a letter go."""
    return language.keep_known(docs, language.train(docs), LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates; of rows with one id, one.
    Rows without an id stay.  A Bloom filter tells the rows whose id is surely not
    concerned; they stay where they are, and only the others' texts are shuffled."""
    groups = near_duplicates.groups(docs)
    copies = groups.where("not kept and doc_id is not null").select("doc_id").distinct().withColumn("goes", F.lit(True))
    again = groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(False).alias("goes"))
    concerned = stage(copies.unionByName(again).groupBy(F.col("doc_id").alias("of")).agg(F.max("goes").alias("goes")), "concerned")
    table, blocks = bloom.build(concerned, "of", concerned.count())
    marked = bloom.possible(docs.withColumn("_row", F.struct(*docs.columns)).select("_row"), F.col("_row.doc_id"), stage(table, "filter"), blocks)
    met = marked.where("maybe").join(concerned, F.col("_row.doc_id") == F.col("of"), "left")
    once = met.where("not goes").select("of", "_row").dropDuplicates(["of"])
    return marked.where("not maybe").select("_row.*").unionByName(met.where("goes is null").select("_row.*")).unionByName(once.select("_row.*"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms under the session's key."""
    return pseudonyms.with_pseudonyms(docs, spark.conf.get(KEY_SETTING, DEFAULT_KEY).encode())


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("personal_data", without_personal_data), ("packing", sequences)]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, fn in STAGES[:-1]:
        read = docs
        with noted() as written:
            docs = settled(spark, f"stage-{name}", lambda: fn(spark, read, sf_dir))  # noqa: B023
        remove(spark, before)  # the next stage reads this one's table only
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
