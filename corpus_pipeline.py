"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage
before it kept, written as Parquet and read again. All but the last return the
columns of documents.

Defined results of the whole: a null or empty text, or one without letters, has
no language and goes in the first stage; a null language is filled in; a null
source is a source of its own; a null id groups, mixes and is written like any
other, first in order; of rows that repeat an id and a text one stays; documents
that the mix takes twice are written twice; columns that documents do not have
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, minhash_dedup, mixing, token_output
from lodestone.llm._shared import Scratch, null_safe_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR = 80  # per cent similarity at which two documents count as copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects (no letters, or too far from
    every language); a missing language is filled in."""
    d = docs.select(*COLUMNS).withColumn("known", F.col("lang"))
    found = language_id.identify(d, carry=("text", "known", "source", "n_chars")).where("NOT rejected")
    return found.select("doc_id", "text", F.coalesce("known", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the
    smallest id; of rows that repeat an id and its text, one stays."""
    docs = docs.select(*COLUMNS)
    groups = minhash_dedup.near_duplicates(docs, NEAR)
    stays = groups.where("kept AND first").select(null_safe_key("doc_id").alias("__id"), F.col("text_key").alias("__text"))
    d = docs.withColumn("__id", null_safe_key("doc_id")).withColumn("__text", F.xxhash64("text"))
    return d.join(stays, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A source's last block may end
    inside a document; that document is taken whole or not, by the larger part.
    Documents without words take part in no mix and are not repeated: they go."""
    docs = docs.select(*COLUMNS)
    rows = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    times = F.round(F.try_divide(F.col("taken"), F.col("size"))).cast("int")
    out = rows.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    files = Scratch(spark).save(token_output.pages(docs))
    return token_output.digest(files)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("token output", tokens),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all rows that the one before it kept."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(*kept)
        kept = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop(*kept)
    return out
