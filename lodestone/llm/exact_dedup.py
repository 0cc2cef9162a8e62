"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes; only
those rows shuffle, the rest pass straight through.

Defined results: null text counts as empty; a null id is smaller than any id;
of rows that tie on the largest id one stays; an empty table gives an empty
result; other columns are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Repeats, Scratch, ship


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the column that is compared (default:
    the text itself). Texts are read once, into a table of (id, row, digest);
    both passes and the grouping read that table. Pass one folds digests into a
    bitmap sized by the rows; pass two sends only rows whose cells were hit
    twice to the exact grouping. Up to 16 million rows the bitmap is broadcast;
    beyond that digests (not texts) go to the slices of the bitmap.
    """
    spark = docs.sparkSession
    ship(spark)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    scratch = Scratch(spark)
    prints = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest")))
    keyed = prints.withColumn("key", F.xxhash64("digest"))
    repeats = Repeats(scratch, keyed, "key", prints.count())
    tested = scratch.cut(repeats.flag(keyed, "key"))
    repeats.close()
    scratch.drop(prints)
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    maybe = tested.where("maybe")
    # among rows with the largest id, the first row stays; the groups are a
    # table, so that the join is between two plain sides and a hot text's rows
    # can be split
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("best")
    groups = scratch.cut(maybe.groupBy("digest").agg(best, F.count("*").alias("group_size")))
    shuffled = maybe.join(groups, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return alone.union(shuffled)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
