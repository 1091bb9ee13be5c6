"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next stage's docs.  Whatever the stage:

* documents have doc_id and text (and lang, source, n_chars); other columns may
  have any names and come through, even those named like a computed one;
* nulls may be in any column; texts may be empty or of any length;
* an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, jaccard, mixing, sharding, toxicity
from marketloom.llm.common import cleaned, fresh, n_words, packed, remove, scratch, shared_dir


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict toxic.

    The model is fit on labelled documents outside the held-out fifth.  A null
    or empty text stays unless the model finds most such texts toxic; repeated
    rows share their fate; without labels all rows stay.
    """
    model = toxicity.fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = fresh(docs, "toxicity"), fresh(docs, "toxic_terms")
    scored = toxicity.score(docs, model, names)
    return scored.where(F.col(names[0]) < 0.5).drop(*names)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: five-word shingles, Jaccard 0.8 or more.

    The one with the smallest doc_id stays, a repeated row once.  Documents
    without words all stay.  One with a null doc_id stays only if no other has
    its set.
    """
    return jaccard.deduplicated(docs, k=5, percent=80)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.  Null and empty texts
    stay; repeated rows share their fate; without items all rows stay."""
    name = fresh(docs, "leaks")
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.where(F.size(name) == 0).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.  Null is a
    source; a source without words is left out whole; of repeated rows that tie
    at the target any may be taken, the same on every run."""
    text = F.col("row.text").cast("string")
    mixed = mixing.mix(docs.select("doc_id", "source", packed(docs)), size=n_words(text), quality=mixing.quality_weight(text)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard (0 to 7) and their slot in it.  Repeated
    rows go different ways; shards are at most one row apart in size."""
    return sharding.shard(docs, shards=8)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_leaks),
    ("mixing_sources", mix_sources),
    ("sharding", shuffle_into_shards),
]

#: Several stages have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # what the stage stored goes when its table is written
            made = stage(spark, docs, sf_dir)
            with cleaned(spark):
                made.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
